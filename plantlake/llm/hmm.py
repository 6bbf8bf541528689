"""Hidden Markov language model over words: Baum-Welch across partitions, exact likelihood by the scaled forward recursion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plantlake.llm.common import lists, most_frequent, once, over_texts

STATES = 8
ITERATIONS = 3
# words that are symbols of their own, and classes (by their last two bytes) for all others
OWN = 4_096
CLASSES = 256
# most frequent words whose counts are sent to the tasks; all others are joined
SENT = 150_000
# most frequent symbols that the start of training clusters by their neighbours
SEED_SYMBOLS = 256
# symbols in one block of the forward and backward recursion
BLOCK = 300_000


def _tokens(text: str | None) -> list[bytes]:
    """Words of a text; bytes.lower and bytes.split know ASCII letters and ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def word_counts(docs: DataFrame, is_train: Column) -> DataFrame:
    """(word, class, n) over training texts; counts are added up per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([_class(w) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "class", "n"]
            )

        for b in batches:
            for text in b.column("text").to_pylist():
                counts.update(_tokens(text))
            if len(counts) > 400_000:
                yield out()
                counts.clear()
        yield out()

    texts = docs.where(is_train).select(F.col("text").cast("string").alias("text"))
    return over_texts(texts, count, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words with their symbols and logs; what is left of every class; totals of training."""

    index: dict[bytes, int]
    symbol: np.ndarray
    log_count: np.ndarray
    inner: np.ndarray
    class_log: np.ndarray
    end_log: float
    total: int
    log_total: float

    @property
    def end(self) -> int:
        return OWN + CLASSES


def vocabulary(counts: DataFrame, train_docs: int) -> Vocabulary:
    """The most frequent words, SENT at most, and the totals of all; the driver holds nothing that grows with the corpus."""
    top = most_frequent(counts, SENT).toArrow()
    words, n, classes = top.column("word").to_pylist(), top.column("n").to_numpy(), top.column("class").to_numpy().astype(np.int64)
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n, classes = [words[i] for i in order], n[order], classes[order]
    # CLASSES rows
    per = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    class_n, class_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    class_n[per["class"].to_numpy(np.int64)] = per["n"].to_numpy(np.int64)
    class_v[per["class"].to_numpy(np.int64)] = per["v"].to_numpy(np.int64)
    total, distinct = int(class_n.sum()) + train_docs, int(class_v.sum()) + (train_docs > 0)
    own = min(OWN, len(words))
    np.subtract.at(class_n, classes[:own], n[:own])
    np.subtract.at(class_v, classes[:own], 1)
    class_log = np.log10(class_n + 0.5 * (class_v + 1))
    symbol = np.where(np.arange(len(words)) < own, np.arange(len(words)), OWN + classes)
    log_count = np.log10(n + 0.5)
    inner = np.where(np.arange(len(words)) < own, 0.0, log_count - class_log[classes])
    return Vocabulary(
        {w: i for i, w in enumerate(words)}, symbol.astype(np.int16), log_count, inner, class_log, float(np.log10(train_docs + 0.5)),
        total, float(np.log10(total + 0.5 * (distinct + 1))),
    )


ENCODED = (
    "row long, doc_id long, train boolean, n_tokens long, n_known long, base double, inner double, symbols binary, "
    "rare array<binary>, times array<int>"
)


def encode(docs: DataFrame, vocabulary_: Vocabulary, is_train: Column) -> DataFrame:
    """Symbols of every text, the sums that frequent words give, and the other words with how often they stand in it."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row = sent.value, TaskContext.get().partitionId() << 33
        find = v.index.get
        for b in batches:
            texts = [_tokens(t) for t in b.column("text").to_pylist()]
            lengths = np.array([len(t) for t in texts], np.int64)
            flat = [w for t in texts for w in t]
            at = np.array([find(w, -1) for w in flat], np.int64)
            known = at >= 0
            symbols, base, inner = np.zeros(len(flat), np.int16), np.zeros(len(flat)), np.zeros(len(flat))
            if len(v.symbol):
                symbols[known], base[known], inner[known] = v.symbol[at[known]], v.log_count[at[known]], v.inner[at[known]]
            others = np.flatnonzero(~known)
            classes = np.array([_class(flat[i]) for i in others.tolist()], np.int64)
            symbols[others] = OWN + classes
            inner[others] = -v.class_log[classes]
            ends = np.cumsum(lengths)
            total = lambda x: np.concatenate([[0], np.cumsum(x)])[ends] - np.concatenate([[0], np.cumsum(x)])[ends - lengths]
            cuts = np.searchsorted(others, np.concatenate([[0], ends]))
            rare = [Counter(flat[i] for i in others[s:e].tolist()) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            end, stream = np.array([v.end], np.int16).tobytes(), symbols.tobytes()
            columns = {
                "row": row + np.arange(len(texts)), "doc_id": b.column("doc_id"), "train": b.column("train"), "n_tokens": lengths + 1,
                "n_known": total(known.astype(np.int64)), "base": total(base), "inner": total(inner),
                "symbols": pa.array([stream[2 * (e - n) : 2 * e] + end for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.binary()),
                "rare": _binary_lists(rare), "times": lists(np.array([k for c in rare for k in c.values()], np.int32), np.array([len(c) for c in rare]), pa.int32()),
            }
            row += len(texts)
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), is_train.alias("train"))
    return over_texts(rows, run, ENCODED)


def _binary_lists(words: list[Counter]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in words])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([w for c in words for w in c], pa.binary()))


@dataclass(frozen=True)
class HiddenMarkov:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _blocks(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Sequences of like length side by side: (their places, padded symbols by step, how many are still running)."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        mine = order[at : at + max(1, BLOCK // max(1, longest))]
        at += len(mine)
        lengths = np.array([len(sequences[i]) for i in mine])
        padded = np.zeros((longest, len(mine)), np.int64)
        for k, i in enumerate(mine):
            padded[: lengths[k], k] = sequences[i]
        yield mine, padded, np.searchsorted(-lengths, -np.arange(longest), side="left")


def forward(model: HiddenMarkov, padded: np.ndarray, running: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Natural-log likelihood of every sequence; with ``keep`` also the scaled states and scales of each step."""
    steps, width = padded.shape
    states = len(model.start)
    loglik = np.zeros(width)
    alphas = np.zeros((steps, width, states)) if keep else None
    scales = np.ones((steps, width)) if keep else None
    emit = np.ascontiguousarray(model.emit.T)
    alpha = np.broadcast_to(model.start, (width, states))
    for t in range(steps):
        n = running[t]
        alpha = (alpha[:n] if t == 0 else alpha[:n] @ model.move) * emit[padded[t, :n]]
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        loglik[:n] += np.log(scale)
        if keep:
            alphas[t, :n], scales[t, :n] = alpha, scale
    return loglik, alphas, scales


def expected_counts(model: HiddenMarkov, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts, moves and emissions of the sequences, and their log-likelihood."""
    states, symbols = model.emit.shape
    starts, moves, emits, total = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols)), 0.0
    emit = np.ascontiguousarray(model.emit.T)
    for _, padded, running in _blocks(sequences):
        steps, width = padded.shape
        loglik, alphas, scales = forward(model, padded, running, keep=True)
        total += float(loglik.sum())
        gammas, ahead = np.zeros((steps, width, states)), np.zeros((steps, width, states))
        beta = np.ones((width, states))
        for t in range(steps - 1, -1, -1):
            n = running[t]
            gammas[t, :n] = alphas[t, :n] * beta[:n]
            ahead[t, :n] = emit[padded[t, :n]] * beta[:n] / scales[t, :n, None]
            if t:
                beta[:n] = ahead[t, :n] @ model.move.T
        live = np.arange(width)[None, :] < running[:, None]
        flat = padded[live]
        for k in range(states):
            emits[k] += np.bincount(flat, gammas[:, :, k][live], minlength=symbols)
        moves += model.move * np.einsum("tbi,tbj->ij", alphas[:-1], ahead[1:], optimize=True)
        starts += gammas[0].sum(axis=0)
    return starts, moves, emits, total


def _sums(rows: DataFrame, fold: Callable[[list[np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """Add up one vector per task: Spark sums (place, value), ``size`` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            seqs = [np.frombuffer(s, np.int16) for s in b.column("symbols").to_pylist()]
            if seqs:
                total += fold(seqs)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "value"])

    got = rows.select("symbols").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[got.column("place").to_numpy()] = got.column("value").to_numpy()
    return out


def seed_model(rows: DataFrame, states: int, symbols: int) -> HiddenMarkov:
    """Starting point: symbols clustered by their neighbours, from pair counts of all training texts."""
    chosen = np.concatenate([np.arange(SEED_SYMBOLS), np.arange(OWN, OWN + CLASSES)])
    place = np.full(symbols, -1)
    place[chosen] = np.arange(len(chosen))
    m = len(chosen)

    def count(seqs: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(m * m + symbols)
        flat = np.concatenate(seqs)
        total[m * m :] = np.bincount(flat, minlength=symbols)
        left, right = place[flat[:-1]], place[flat[1:]]
        both = (left >= 0) & (right >= 0)
        total[: m * m] = np.bincount(left[both] * m + right[both], minlength=m * m)
        return total

    counted = _sums(rows, count, m * m + symbols)
    pairs, single = counted[: m * m].reshape(m, m), counted[m * m :]
    pairs = pairs + pairs.T
    share = pairs.sum(axis=1)
    lift = np.log1p(pairs * max(1.0, pairs.sum()) / np.maximum(np.outer(share, share), 1.0)) * (share > 0)[:, None]
    u, s, _ = np.linalg.svd(lift)
    points = u[:, :states] * s[:states]
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    # farthest-first centres, then rounds of k-means, weighted by frequency
    centres = points[[int(np.argmax(share))]]
    while len(centres) < states:
        far = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1) * np.sqrt(share)
        centres = np.vstack([centres, points[int(np.argmax(far))]])
    for _ in range(20):
        own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(states):
            weight = share * (own == k)
            if weight.sum():
                centres[k] = (points * weight[:, None]).sum(axis=0) / weight.sum()
    emit = np.tile((single + 0.5) / (single + 0.5).sum(), (states, 1))
    for k in range(states):
        emit[k, chosen[own == k]] *= 6.0
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return HiddenMarkov(np.full(states, 1.0 / states), move, emit)


def baum_welch(rows: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> HiddenMarkov:
    """Train on the ``symbols`` of all rows; every iteration is one pass whose expected counts Spark adds up."""
    symbols = OWN + CLASSES + 1
    model = seed_model(rows, states, symbols)
    for _ in range(iterations):
        sent = rows.sparkSession.sparkContext.broadcast(model)
        counts = _sums(rows, lambda seqs: np.concatenate([x.ravel() for x in expected_counts(sent.value, seqs)[:3]]), states + states**2 + states * symbols)
        starts, moves, emits = np.split(counts, [states, states + states**2])
        # a state gives unseen symbols the share they have overall
        emits = emits.reshape(states, symbols)
        prior = (emits.sum(axis=0) + 0.5) / (emits.sum() + 0.5 * symbols)
        emit = (emits + 20.0 * prior) / (emits.sum(axis=1, keepdims=True) + 20.0)
        moves = moves.reshape(states, states) + 0.5
        model = HiddenMarkov((starts + 0.5) / (starts + 0.5).sum(), moves / moves.sum(axis=1, keepdims=True), emit)
        sent.unpersist()
    return model


def likelihoods(rows: DataFrame, model: HiddenMarkov) -> DataFrame:
    """Every row with ``hidden``: log10 of the exact likelihood of its symbols."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [np.frombuffer(s, np.int16) for s in b.column("symbols").to_pylist()]
            out = np.zeros(len(seqs))
            for mine, padded, running in _blocks(seqs):
                out[mine] = forward(sent.value, padded, running, keep=False)[0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out / np.log(10))], [*names, "hidden"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", hidden double")


def score_texts(docs: DataFrame, is_train: Column, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """Log10 probability of every text under the hidden Markov model and under smoothed word frequencies.

    Returns doc_id, train, n_tokens (words and one end), n_known, train_tokens, base_score, score. A word is a symbol of
    its own if it is among the most frequent, else one of its class; inside a class words have their smoothed frequency. So the
    model is a distribution over the same words as the base, which is the case of one state. Counts of the SENT
    most frequent words travel to the tasks (a fixed number), those of rarer words are joined, after each document has
    added up its own. Null text is one end token; a null train flag is not training; repeated rows are scored each;
    without training texts both scores follow the smoothing alone; an empty table gives no rows.
    """
    is_train = F.coalesce(is_train, F.lit(False))
    train_docs = docs.where(is_train).count()
    counts = once(word_counts(docs, is_train), "words")
    words = vocabulary(counts, train_docs)
    rows = once(encode(docs, words, is_train), "symbols")
    model = baum_welch(rows.where("train"), states, iterations)
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    found = rare.join(counts.select("word", "n"), "word").groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)))).alias("more"), F.sum("times").alias("seen"),
    )
    scored = likelihoods(rows.select("row", "doc_id", "train", "n_tokens", "n_known", "base", "inner", F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x).alias("others"), "symbols"), model)
    joined = scored.join(found, "row", "left")
    more = F.col("others") * F.log10(F.lit(0.5)) + F.coalesce("more", F.lit(0.0))
    known = F.col("n_known") + F.coalesce("seen", F.lit(0)) + F.lit(1 if train_docs else 0)
    return joined.select(
        "doc_id", "train", "n_tokens", known.cast("long").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + more + F.lit(words.end_log) - F.col("n_tokens") * F.lit(words.log_total)).alias("base_score"),
        (F.col("hidden") + F.col("inner") + more).alias("score"),
    )
