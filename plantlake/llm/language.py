"""Language by cross-parsing: a text is cut into the longest phrases that occur in the labelled text of each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantlake.llm.common import over_texts, texts_of

# code points of labelled text that the automata of all languages are built from, at most about: a documented bound
SAMPLE_CHARS = 131_072
# code points that are drawn into the sample together
PASSAGE = 512
# bytes of a text that are parsed in one piece; a phrase ends where a piece does
PIECE = 512
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def plain_bytes(text: str) -> bytes:
    """Small letters in UTF-8, one space between words, around them, and for everything else."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")


def suffix_automaton(data: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of ``data``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in data.tolist():
        new = len(moves)
        moves.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = new
    return moves


@dataclass(frozen=True)
class LanguageModel:
    """Automata of all languages in one table.

    ``table`` holds, for every state and byte class, the state after it; where no such phrase occurs, the state after the byte
    from the start, with ``CUT`` added. The last state of a language stands behind a byte that its sample does not hold: that byte is a
    phrase. ``starts`` has the start state and ``bits`` the cost of a phrase of each language.
    """

    names: list[str]
    classes: np.ndarray
    width: int
    table: np.ndarray
    starts: np.ndarray
    bits: np.ndarray

    CUT = 1 << 30

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of every text in every language: (texts, languages)."""
        pieces = [(i, t[at : at + PIECE]) for i, t in enumerate(texts) for at in range(0, len(t), PIECE)]
        out = np.zeros((len(texts), len(self.names)), np.int64)
        if not pieces or not self.names:
            return out
        # longest first: a step takes those pieces that are as long
        pieces.sort(key=lambda p: -len(p[1]))
        lengths = np.array([len(p[1]) for p in pieces])
        flat = self.classes[np.frombuffer(b"".join(p[1] for p in pieces), np.uint8)]
        begin = np.cumsum(lengths) - lengths
        state = np.repeat(self.starts[:, None], len(pieces), axis=1)
        count = np.zeros(state.shape, np.int32)
        for step in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -step, side="left"))
            after = self.table[state[:, :live] * self.width + flat[begin[:live] + step]]
            count[:, :live] += after >= self.CUT
            state[:, :live] = after & (self.CUT - 1)
        # the phrase that the end of a piece cuts
        np.add.at(out, np.array([p[0] for p in pieces]), (count + 1).T)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of every text: the language of fewest bits a byte, and how far the next one is."""
        letters = np.array([has_letter(t) for t in texts], bool)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        data = [plain_bytes(t) if ok else b"" for t, ok in zip(texts, letters, strict=True)]
        size = np.maximum(1, np.array([len(d) for d in data]))
        cost = self.phrases(data) * self.bits / size[:, None]
        best = np.argmin(cost, axis=1)
        lowest = cost[np.arange(len(texts)), best]
        others = cost.copy()
        others[np.arange(len(texts)), best] = np.inf
        second = others.min(axis=1)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, second / (second + lowest))
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def train_language_model(docs: DataFrame, train: Column, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Suffix automata of the languages in ``lang``, from the rows of ``docs`` that ``train`` selects.

    Texts are cut into passages of 512 code points; of each language passages are drawn by a hash of doc_id and place, as many
    as make its equal share of about ``sample_chars`` (all, if it has fewer). That bounds the automata, which go to every task.
    Languages are taken by code point; a thousand of them would share the sample, and it is refused where a language would be
    left with less than one passage. Rows with null text or lang teach nothing, equal rows teach as often as they occur.
    """
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    last = F.greatest(F.lit(0), F.floor((F.length("text") - 1) / PASSAGE)).cast("int")
    # how many passages each language has: one row per language
    sizes = known.groupBy("lang").agg(F.sum(last + 1).alias("n")).orderBy("lang").limit(sample_chars // PASSAGE + 1).collect()
    if len(sizes) * PASSAGE > sample_chars:
        raise ValueError("more languages than passages in the sample")
    if not sizes:
        return LanguageModel([], np.zeros(256, np.int64), 1, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    share = sample_chars // PASSAGE // len(sizes)
    rates = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.25 * share / r["n"]))])
    places = F.filter(F.sequence(F.lit(0), last), lambda i: F.pmod(F.xxhash64("doc_id", i, F.lit("lang")), F.lit(1 << 30)) < rates[F.col("lang")] * (1 << 30))
    drawn = known.select("lang", F.xxhash64("doc_id").alias("h"), "text", F.explode(places).alias("i"))
    drawn = drawn.select("lang", "h", "i", F.substr("text", F.col("i") * PASSAGE + 1, F.lit(PASSAGE)).alias("passage"))

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["h"].to_pylist(), table["i"].to_pylist(), table["passage"].to_pylist()), key=lambda r: (hash_order(r), r[2]))[:share]
        data = b"".join(plain_bytes(r[2]) for r in rows)
        moves = suffix_automaton(np.frombuffer(data, np.uint8))
        width = np.array([len(m) for m in moves], np.int32)
        keys = np.array([k for m in moves for k in m], np.uint8)
        to = np.array([v for m in moves for v in m.values()], np.int32)
        values = [[table["lang"][0].as_py()], [len(data)], [width.tobytes()], [keys.tobytes()], [to.tobytes()]]
        return pa.table(values, schema=pa.schema([("lang", pa.string()), ("size", pa.int64()), ("width", pa.binary()), ("keys", pa.binary()), ("to", pa.binary())]))

    # about 1.25 times a language's share of the sample meets in a group
    found = drawn.groupBy("lang").applyInArrow(build, "lang string, size long, width binary, keys binary, to binary").collect()
    return _joined(sorted(found, key=lambda r: r["lang"]))


def hash_order(row: tuple) -> int:
    """Order of passages that depends on neither length nor content."""
    return ((row[0] ^ (row[1] * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) % (1 << 64)


def _joined(found: list) -> LanguageModel:
    """One table of all automata; bytes that occur in none of them share a class that ends every phrase."""
    keys = [np.frombuffer(r["keys"], np.uint8) for r in found]
    seen = np.unique(np.concatenate(keys))
    classes = np.zeros(256, np.int64)
    classes[seen] = np.arange(1, len(seen) + 1)
    width, tables, starts, first = len(seen) + 1, [], [], 0
    for r, k in zip(found, keys, strict=True):
        counts, to = np.frombuffer(r["width"], np.int32), np.frombuffer(r["to"], np.int32)
        table = np.full((len(counts) + 1, width), -1, np.int32)
        table[np.repeat(np.arange(len(counts)), counts), classes[k]] = to + first
        table[0] = np.where(table[0] >= 0, table[0], first + len(counts))
        tables.append(np.where(table >= 0, table, table[0] + LanguageModel.CUT).astype(np.int32))
        starts.append(first)
        first += len(table)
    return LanguageModel(
        [r["lang"] for r in found], classes, width, np.concatenate([t.ravel() for t in tables]), np.array(starts, np.int64),
        np.array([np.log2(max(2, r["size"])) for r in found]),
    )


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every row of ``docs``, from its text alone.

    A text is parsed greedily: each phrase is the longest one from its place on that occurs in the language's sample, and costs
    the bits of a place in that sample; the language of fewest bits a byte wins, ties go to the first by code point. The score is
    between 0.5 and 1: the cost of the second best against both. ``und`` with score 0 is given to null texts, texts without a
    letter, and where no language was learned. Long texts are parsed in pieces of 512 bytes. Columns of these two names are
    replaced, others pass through; equal texts get equal answers, an empty table stays empty.
    """
    kept = [(c, t) for c, t in docs.dtypes if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, (c, _) in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("_text"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = shared.value.predict(texts_of(b.column("_text")))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(names, pa.string()), pa.array(score)], [*b.schema.names[: len(kept)], "lang_pred", "score"])

    schema = ", ".join([*(f"_{i} {t}" for i, (_, t) in enumerate(kept)), "lang_pred string, score double"])
    made = over_texts(source, fold, schema, "_text")
    return made.select(*[F.col(f"_{i}").alias(c) for i, (c, _) in enumerate(kept)], "lang_pred", "score")
