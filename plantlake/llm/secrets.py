"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantlake.llm.common import over_texts, texts_of

# fixed values: the base patterns of the contract
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "markov"]
# every match of HEX with 32 or more characters, found at its first character
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_LONG_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")

# what the models are asked about: runs of these characters, down to the length at which the ratio still tells them apart
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[^A-Za-z0-9]+")
IDENTIFIER = re.compile(r"[A-Za-z0-9_]{4,}")
ALPHABET = 64
# natural-log ratio per character, and in all, above which a string is a secret
RATE = 0.35
TOTAL = 12.0

_CODE = np.full(256, 63, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
    _CODE[ord(_c)] = _i + 1
SPANS = "array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class SecretModel:
    """Log-likelihood ratio (random against ordinary) of each pair of neighbouring characters; code 0 is the border.

    As in training, whatever no identifier holds is a border; two borders in a row say nothing.
    """

    ratio: np.ndarray

    def score(self, text: str) -> float:
        codes = np.concatenate([[0], _IDENTIFIER_CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)], [0]])
        return float(self.ratio[codes[:-1], codes[1:]].sum())


def _codes(text: str) -> np.ndarray:
    inner = _CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    return np.concatenate([[0], inner, [0]])


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of the base patterns, sorted."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _LONG_ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def train_secret_model(docs: DataFrame, smooth: float = 0.5) -> SecretModel:
    """Character-pair models from samples that the base patterns label, over all documents.

    Random strings: the values that base patterns find, if a digit is in them. Ordinary identifiers: the other runs of letters, digits and
    underscores, but for those that the models are asked about: a secret of unknown kind teaches neither class. Each task adds up its pairs in a table of 64 x 64 counts per class; Spark sums the tables, so the
    driver gets 8,192 numbers whatever the input. An empty table gives models that never tell anything apart.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((2, ALPHABET * ALPHABET), np.int64)
        for b in batches:
            ordinary = []
            for text in texts_of(b.column("text")):
                spans = base_spans(text)
                secret = [v for _, _, _, v in spans if _DIGIT.search(v)]
                _add(pairs[1], secret)
                cut = 0
                for start, _, end, _ in spans:
                    ordinary.append(text[cut:start])
                    cut = max(cut, end)
                ordinary.append(text[cut:])
            _add_text(pairs[0], CANDIDATE.sub(" ", "\n".join(ordinary)))
        kind, pair = np.nonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(pair), pa.array(pairs[kind, pair])], ["kind", "pair", "n"])

    counted = over_texts(docs.select(F.col("text").cast("string").alias("text")), count, "kind long, pair long, n long")
    # at most 2 x 64 x 64 rows
    rows = counted.groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((2, ALPHABET * ALPHABET))
    for r in rows:
        table[r["kind"], r["pair"]] += r["n"]
    ordinary, random = (_pair_model(t.reshape(ALPHABET, ALPHABET), smooth) for t in table)
    # secrets of kinds that no sample shows are drawn from all characters alike
    ratio = np.log(0.5 * random + 0.5 / ALPHABET) - np.log(ordinary)
    ratio[0, 0] = 0.0
    return SecretModel(ratio)


def _pair_model(counts: np.ndarray, smooth: float) -> np.ndarray:
    """P(next | character); a character that was hardly seen leans on the frequencies of all."""
    single = counts.sum(axis=0) + smooth
    single = single / single.sum()
    return (counts + 20.0 * single) / (counts.sum(axis=1, keepdims=True) + 20.0)


def _add(counts: np.ndarray, samples: list[str]) -> None:
    for s in samples:
        codes = _codes(s)
        np.add.at(counts, codes[:-1] * ALPHABET + codes[1:], 1)


def _add_text(counts: np.ndarray, text: str) -> None:
    """Pairs of all identifiers of a text at once; whatever stands between them is the border."""
    codes = _IDENTIFIER_CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    pairs = np.bincount(codes[:-1] * ALPHABET + codes[1:], minlength=ALPHABET * ALPHABET)
    pairs[0] = 0
    counts += pairs


# as _CODE, with everything that no identifier holds as border
_IDENTIFIER_CODE = np.where(_CODE == 63, 0, _CODE)
_IDENTIFIER_CODE[ord("_")] = 63


def _looks_random(model: SecretModel, text: str) -> tuple[bool, bool]:
    """Whether the ratio of a string, its signs left out, is high per character, and in all as well."""
    inner = _SIGN.sub("", text)
    score = model.score(inner) if inner else 0.0
    dense = bool(inner) and score >= RATE * len(inner)
    return dense, dense and score >= TOTAL


def markov_spans(text: str, model: SecretModel, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int]]:
    """Runs of 16 or more characters that look random, but for what base spans cover.

    What is left of a run beside a base span is scored on its own; if it is too short to tell, it goes by the whole run.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        begin, end = m.span()
        over = [(s, e) for s, _, e, _ in taken if s < end and e > begin]
        if not over:
            if _looks_random(model, m[0])[1]:
                found.append((begin, 3, end))
            continue
        whole, at = None, begin
        # base spans are sorted by start
        for s, e in [*over, (end, end)]:
            if s > at:
                dense, sure = _looks_random(model, text[at:s])
                if dense and not sure:
                    whole = _looks_random(model, m[0])[1] if whole is None else whole
                    sure = whole
                if sure:
                    found.append((at, 3, s))
            at = max(at, e)
    return found


def find_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """(doc_id, spans) for every row: kind, start and end in code points (end exclusive), by start, then kind.

    Kinds are assign, access and hex (base patterns) and markov (found by the models). Null and empty texts have no
    span, repeated rows are scanned one by one, other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in texts_of(b.column("text")):
                base = base_spans(text)
                spans = sorted([(s, k, e) for s, k, e, _ in base] + markov_spans(text, model, base))
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, f"doc_id long, spans {SPANS}")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: SecretModel, mark: str = "[SECRET]") -> DataFrame:
    """The same rows with every span of ``find_secrets`` replaced by ``mark``; overlapping spans become one."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, text in enumerate(texts):
                if not text:
                    continue
                base = base_spans(text)
                spans = sorted([(s, e) for s, _, e, _ in base] + [(s, e) for s, _, e in markov_spans(text, model, base)])
                if spans:
                    parts, at = [], 0
                    for s, e in spans:
                        if s >= at:
                            parts += [text[at:s], mark]
                        at = max(at, e)
                    texts[i] = "".join([*parts, text[at:]])
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return over_texts(docs, clean, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
