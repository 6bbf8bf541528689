"""Toxicity by a noisy channel: written-over words are decoded under a character language model, then the text is scored."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
import functools
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantlake.llm.common import SMALL_SLICE, crc_fold, most_frequent, once, over_texts, texts_of

# labelled rows that the classifier is fitted on, at most about: a documented bound
TRAIN_ROWS = 200_000
# features of the lexicon at most, and the documents a feature needs
LEXICON = 65_536
LEAST_DOCS = 4
LEAST_WEIGHT = 1.5
# symbols of the language model: 0 is the border, 1-26 the letters, 27 every other letter; four in a row
SYMBOLS = 28
BEAM = 48
LONGEST = 40
# tokens whose weight a worker remembers
CACHE = 150_000

# fixed values: what a sign may stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
KEEP, CHANGE, REPEAT, SPACE = math.log(0.9), math.log(0.1), math.log(0.3), math.log(0.05)
_EDGE = ".,;:?\"'`[]{}<>()!#%&*~^|=/\\-_+"
_NOISY = re.compile(r"(?=.*[^\W\d_])(?:.*[0-9@$!|+(€£]|.*([^\W\d_])\1\1)")
_SIGNS = "@$!|+(€£"
_SPACED = re.compile(rf"(?<!\S)(?:(?:[^\W_]|[{_SIGNS}])[ .\-_*]+){{2,}}(?:[^\W_]|[{_SIGNS}])(?![^\s.,!?;:])")
_BETWEEN = re.compile(r"[ .\-_*]+")
_LONG_RUN = re.compile(r"(.)\1{3,}")
_RUNS = re.compile(r"(.)\1+")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_DRAWN = re.compile(r"([^\W\d_])\1\1")
FEATURES = ("log_sum", "best", "log_count", "share")


def _codes(text: str) -> np.ndarray:
    """Symbol of every code point of a lower-case text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(points), np.int32)
    letters = (points >= 97) & (points <= 122)
    out[letters] = points[letters] - 96
    # letters beyond ASCII: from Latin-1 on, but for its two arithmetic signs
    out[(points >= 0xC0) & (points != 0xD7) & (points != 0xF7) & (points < 0x2000)] = SYMBOLS - 1
    return out


@functools.lru_cache(maxsize=65_536)
def symbol(char: str) -> int:
    return int(_codes(char)[0])


def _letters(char: str) -> list[tuple[str, float]]:
    """What a character may stand for, and its cost."""
    return [(x, CHANGE - math.log(len(LEET[char]))) for x in LEET[char]] if char in LEET else [(char, KEEP)]


def _edge(char: str) -> list[tuple[str, float]]:
    """A sign at the edge of a word: nothing, or what it may stand for."""
    return [("", KEEP), *_letters(char)]


@functools.lru_cache(maxsize=65_536)
def _edge_signs(outside: str) -> str:
    """The signs beside a word that may stand for letters, each run of one sign as one."""
    return _RUNS.sub(r"\1", "".join(c for c in outside if c in LEET))


@dataclass(frozen=True)
class CharModel:
    """log P(symbol | three before it), flat over 28^4."""

    logp: np.ndarray

    def decode(self, options: list[list[tuple[str, float]]]) -> str:
        """Most likely text of a lattice: per place the characters it may stand for ('' none, ' ' a border) and their cost.

        Viterbi over the last three symbols; of equal scores the first in order of the options stays.
        """
        paths: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
        for choices in [*options, [(" ", 0.0)]]:
            after: dict[tuple[int, int, int], tuple[float, str]] = {}
            for (a, b, c), (score, text) in paths.items():
                for char, cost in choices:
                    if not char:
                        state, new, out = (a, b, c), score + cost, text
                    else:
                        d = symbol(char)
                        new = score + cost + float(self.logp[((a * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS + d])
                        state, out = ((b, c, d) if d else (0, 0, 0)), text + char
                    if state not in after or after[state][0] < new:
                        after[state] = (new, out)
            paths = after if len(after) <= BEAM else dict(sorted(after.items(), key=lambda x: -x[1][0])[:BEAM])
        return max(paths.values(), key=lambda x: x[0])[1].strip()

    def restore(self, token: str, lead: str = "", trail: str = "") -> str:
        """A lower-case word without its leet signs and drawn-out letters; the signs around it may be letters of it."""
        options: list[list[tuple[str, float]]] = []
        for i, char in enumerate(token):
            found = _letters(char)
            if i and token[i - 1] == char:
                found.append(("", REPEAT))
            options.append(found)
        return self.decode([*map(_edge, lead), *options, *map(_edge, trail)])

    def join(self, spaced: str) -> str:
        """Single characters with signs between them as the words they spell."""
        places = _BETWEEN.split(spaced)
        options: list[list[tuple[str, float]]] = []
        for i, char in enumerate(places):
            if i:
                options.append([("", KEEP), (" ", SPACE)])
            # a sign at the end may be punctuation
            options.append(_edge(char) if char in _SIGNS and i in (0, len(places) - 1) else _letters(char))
        return self.decode(options)


def train_char_model(docs: DataFrame) -> CharModel:
    """Character model over all texts; counts are added up per task, then by Spark: 28^4 numbers at most come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**4, np.int64)
        for b in batches:
            codes = _codes("   " + "   ".join(texts_of(b.column("text"))).lower() + "   ")
            # runs of borders become three of them, so that every word starts from the empty state
            border = codes == 0
            keep = ~border | np.concatenate([[True], ~border[:-1]])
            words = codes[keep]
            spread = np.zeros(len(words) + 2 * int((words == 0).sum()), np.int32)
            spread[np.arange(len(words), dtype=np.int32) + 2 * np.cumsum(words == 0, dtype=np.int32)] = words
            gram = ((spread[:-3] * SYMBOLS + spread[1:-2]) * SYMBOLS + spread[2:-1]) * SYMBOLS + spread[3:]
            counts += np.bincount(gram, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["gram", "n"])

    rows = over_texts(docs.select(F.col("text").cast("string").alias("text")), count, "gram long, n long", chars=SMALL_SLICE)
    total = rows.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**4)
    counts[total["gram"].to_numpy(np.int64)] = total["n"].to_numpy(np.float64)
    grams = counts.reshape([SYMBOLS] * 4)
    # each order leans on the one below it
    model = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(1, 5):
        n = grams.sum(axis=tuple(range(4 - order))) if order < 4 else grams
        model = (n + 2.0 * np.broadcast_to(model, n.shape)) / (n.sum(axis=-1, keepdims=True) + 2.0)
    return CharModel(np.log(model).astype(np.float32).ravel())


def word_features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 7 characters."""
    return [f"={word}", *(word[:n] for n in range(4, min(8, len(word))))]


class Reader:
    """Restored words of texts, each distinct token decoded once per worker while the cache holds it.

    ``lexicon`` has the weight of each feature that counts; None lets all features count, without weights.
    """

    def __init__(self, model: CharModel, lexicon: dict[str, float] | None) -> None:
        self.model, self.lexicon = model, lexicon
        self.seen: dict[str, float] = {}
        self.held: dict[str, tuple[str, ...]] = {}
        words = {f[1:] for f in lexicon or () if f.startswith("=")}
        # doubled letters alone are common; they are looked into where the word without them is in the lexicon
        self.short = {_RUNS.sub(r"\1", w) for w in words}
        # a word that begins like no feature has none
        self.heads = None if lexicon is None else {w[:4] for w in words} | {f[:4] for f in lexicon if not f.startswith("=")}

    def word(self, token: str) -> str:
        core = token.strip(_EDGE)
        if len(core) > LONGEST:
            # however far a word is drawn out, three of a run say as much
            short = _LONG_RUN.sub(r"\1\1\1", core)
            if len(short) > LONGEST:
                return core
            core, token = short, _LONG_RUN.sub(r"\1\1\1", token)
        if not core or core.isdigit():
            return core
        lead = trail = ""
        if len(core) < len(token):
            at = token.index(core)
            lead, trail = _edge_signs(token[:at]), _edge_signs(token[at + len(core) :])
        if not core.isalpha():
            return self.model.restore(core, lead, trail) if _NOISY.match(core) or ((lead or trail) and self.edged(core, lead, trail)) else core
        if (run := _DOUBLE.search(core)) is not None:
            if _DRAWN.search(core, run.start()):
                return self.model.restore(core, lead, trail)
            if self.short and _RUNS.sub(r"\1", core) in self.short and f"={core}" not in self.lexicon:
                return self.model.restore(core, lead, trail)
        if (lead or trail) and self.edged(core, lead, trail):
            return self.model.restore(core, lead, trail)
        return core

    def edged(self, core: str, lead: str, trail: str) -> bool:
        """Whether the word with letters for signs at its edges may have a feature that counts; many signs are not tried one by one."""
        if self.heads is None or len(lead) + len(trail) > 3:
            return True
        for signs in itertools.product(*(("", *LEET[c]) for c in lead + trail)):
            if any(signs):
                word = "".join(signs[: len(lead)]) + core + "".join(signs[len(lead) :])
                if (word[:4] in self.heads and any(f in self.lexicon for f in word_features(word))) or _RUNS.sub(r"\1", word) in self.short:
                    return True
        return False

    def found(self, token: str) -> tuple[str, ...]:
        """The features of the restored token that count."""
        out = self.held.get(token)
        if out is None:
            words, heads = self.word(token).split(), self.heads
            if heads is None:
                out = tuple(f for w in words for f in word_features(w))
            else:
                out = tuple(f for w in words if w[:4] in heads for f in word_features(w) if f in self.lexicon)
            if len(self.held) >= CACHE:
                self.held.clear()
            self.held[token] = out
        return out

    def weight(self, token: str) -> float:
        """The strongest evidence among the features of the restored token; 0 for none."""
        words, heads, lexicon = self.word(token).split(), self.heads, self.lexicon
        return max((lexicon.get(f, 0.0) for w in words if w[:4] in heads for f in word_features(w)), default=0.0)

    def tokens(self, text: str) -> list[str]:
        """Lower-case tokens; spelled-out words are put together first."""
        text = text.lower()
        if _SPACED.search(text):
            # signs alone spell nothing
            text = _SPACED.sub(lambda m: self.model.join(m[0]) if any(map(str.isalnum, m[0])) else m[0], text)
        return text.split()

    def features(self, text: str) -> tuple[float, float, float, float]:
        tokens, seen = self.tokens(text), self.seen
        new = set(tokens).difference(seen)
        if len(seen) + len(new) > CACHE:
            self.seen = seen = {t: seen[t] for t in set(tokens).intersection(seen)}
        for t in new:
            seen[t] = self.weight(t)
        hits = [w for w in map(seen.__getitem__, tokens) if w]
        total = sum(hits)
        return math.log1p(total), max(hits, default=0.0), math.log1p(len(hits)), total / (1.0 + len(tokens)) * 10.0


@dataclass(frozen=True)
class ToxicModel:
    chars: CharModel
    lexicon: dict[str, float]
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ self.weights[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fold_of(key: Column) -> Column:
    return crc_fold(key, 5)


def train_toxic_model(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicModel:
    """Character model over all texts, lexicon and logistic weights from labelled documents outside fold 0.

    About ``train_rows`` labelled documents are taken by a hash of their id (all, if fewer); that bounds the table of
    labels that is broadcast and the fitting on the driver. Folds 2 to 4 give the lexicon: features of documents
    labelled 1 are counted first, then the same features in those labelled 0. Fold 1 gives the weights. Rows
    without a label teach nothing; with both labels a document counts as 1. Without documents of both labels the score is constant.
    """
    chars = train_char_model(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, train_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # about train_rows rows of 16 bytes
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    taught = taught.withColumn("fold", fold_of(F.col("doc_id")))
    for_lexicon = taught.where("fold <> 1")
    sizes = {r["toxic"]: r["n"] for r in for_lexicon.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    lexicon: dict[str, float] = {}
    if ones and zeros:
        toxic = once(_feature_documents(for_lexicon.where("toxic = 1"), chars, None).where(F.col("n") >= LEAST_DOCS), "features")
        seen = {r["feature"]: r["n"] for r in most_frequent(toxic, LEXICON).collect()}
        clean = {r["feature"]: r["n"] for r in _feature_documents(for_lexicon.where("toxic = 0"), chars, set(seen)).collect()}
        odds = {f: math.log((n + 0.5) / (ones + 1)) - math.log((clean.get(f, 0) + 0.5) / (zeros + 1)) for f, n in seen.items()}
        lexicon = {f: w for f, w in odds.items() if w >= LEAST_WEIGHT}
    rows = _doc_features(taught.where("fold = 1").select("doc_id", "text", "toxic"), chars, lexicon, ["toxic"]).toPandas()
    x = rows[list(FEATURES)].to_numpy(np.float64).reshape(-1, len(FEATURES))
    return ToxicModel(chars, lexicon, _logistic(x, rows["toxic"].to_numpy(np.float64), ones / max(1, ones + zeros)))


def _feature_documents(docs: DataFrame, chars: CharModel, only: set[str] | None) -> DataFrame:
    """(feature, n): documents that hold each feature, or each of a given set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = Reader(chars, None if only is None else dict.fromkeys(only, 0.0)), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])

        for b in batches:
            for text in texts_of(b.column("text")):
                counts.update({f for t in set(reader.tokens(text)) for f in reader.found(t)})
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    return over_texts(docs.select("text"), count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _doc_features(docs: DataFrame, chars: CharModel, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(chars, lexicon)
        for b in batches:
            values = np.array([reader.features(t) for t in texts_of(b.column("text"))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(v) for v in values.T)], [*keep, *FEATURES])

    kinds = dict(docs.dtypes)
    return over_texts(docs, features, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{f} double" for f in FEATURES)]))


def _logistic(x: np.ndarray, y: np.ndarray, base: float) -> np.ndarray:
    """Newton steps on the ridge logistic loss; without both labels only the base rate."""
    if len(set(y.tolist())) < 2:
        rate = min(max(base, 1e-3), 1 - 1e-3)
        return np.array([math.log(rate / (1 - rate)), *[0.0] * len(FEATURES)])
    a, w = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-6, *[0.1] * x.shape[1]])
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_texts(docs: DataFrame, model: ToxicModel, name: str = "score") -> DataFrame:
    """Add the score (0 to 1, higher: toxic) to every row of ``docs``, from its text alone.

    The new column is called ``name`` and takes the place of an old one of that name. Null text counts as empty. Equal texts
    score alike, other columns pass through, an empty table stays empty.
    """
    kept = [(c, t) for c, t in docs.dtypes if c != name]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.chars, model.lexicon)
        for b in batches:
            values = np.array([reader.features(t) for t in texts_of(b.column("text"))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(values))], [*b.schema.names, name])

    return over_texts(docs.select(*[f"`{c}`" for c, _ in kept]), score, ", ".join([*(f"`{c}` {t}" for c, t in kept), f"`{name}` double"]))
