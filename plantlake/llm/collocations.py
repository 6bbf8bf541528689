"""Phrases whose words keep company: n-gram counts by marginalising the longest windows, scores by the weakest cut."""

from __future__ import annotations

from collections.abc import Iterator
import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W
import xxhash

from plantlake.joins import join_sized
from plantlake.llm.common import once, over_texts, texts_of

LONGEST = 4
LEAST = 30
# a longer phrase with this share (percent) of the occurrences takes a phrase's place
COVER = 80
TOP = 2_000
# floor(2 * SCALE * a / (l + r))
SCALE = 1_000_000
UNKNOWN = "und"
# counters that travel together, and words whose windows a task adds up together
BLOCK = 65_536
TOGETHER = 1_500_000
# code points after which a text is cut at the end of the next piece
LONG = 4_000_000

# fixed rule: small letters, blanks, and the signs that end a piece
_RULE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
_END = re.compile(r"[.,;:!?\n-\r]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Lead:
    """Words of many texts as numbers, and which words follow which within a piece; filled by language until flushed."""

    def __init__(self) -> None:
        self.data: dict[str, list[bytes]] = {}
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        self.data.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
        self.size += len(text) // 6 + 1

    def flush(self) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
        """Per language: distinct words, the number of every word in order, and its piece."""
        for lang, texts in self.data.items():
            flat = b"\n".join(texts).translate(_RULE)
            # every byte that split() cuts at is a blank or a line break by now
            words = flat.split()
            if not words:
                continue
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            del words
            signs = np.frombuffer(flat, np.uint8)
            blank = (signs == 32) | (signs == 10)
            begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
            yield lang, list(number), ids, np.cumsum(signs == 10, dtype=np.int32)[begins]
        self.data, self.size = {}, 0


def _slots(lang: str, words: list[bytes], ids: np.ndarray, piece: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place with ``width`` words from it on: whether they lie in one piece, and the counter of them all."""
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words)) + np.uint64(digest(lang.encode("utf-8", "surrogatepass")))
    n = max(0, len(ids) - width + 1)
    x = h[ids[:n]]
    for k in range(1, width):
        x = x * _ODD ^ h[ids[k : k + n]]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return piece[width - 1 :][:n] == piece[:n], (x >> np.uint64(64 - bits)).astype(np.int64)


def _held(filters: list[bytes], lang: str, words: list[bytes], ids: np.ndarray, piece: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each filter of words, pairs and so on: the places whose words it lets pass, up to the last word."""
    out = []
    for width, packed in enumerate(filters, 1):
        inside, slot = _slots(lang, words, ids, piece, width, bits)
        bit = np.frombuffer(packed, np.uint8)[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1
        out.append(np.concatenate([inside & (bit > 0), np.zeros(len(ids) - len(slot), bool)]))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    held = Lead()
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), texts_of(b.column("text")), strict=True):
            for part in _parts(text):
                held.add(lang, part)
                if held.size >= TOGETHER:
                    yield from held.flush()
    yield from held.flush()


def _parts(text: str) -> Iterator[str]:
    """A very long text in parts that end where a piece ends."""
    at = 0
    while len(text) - at > LONG and (end := _END.search(text, at + LONG)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:] if at else text


def counter_bits(texts: DataFrame) -> int:
    """As many counters as the texts have words, about, between 2^16 and 2^27 of one byte."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(27, max(16, (size // 16).bit_length()))


def gram_filters(texts: DataFrame, filters: list[bytes], more: int, least: int, bits: int) -> list[bytes]:
    """``filters`` and ``more`` filters of phrases that are longer by a word each, from one pass over the texts.

    A filter has one bit per counter of phrases: whether they occur ``least`` times or more. Those of a task that are not zero travel compressed. Counters are added up per task and block
    of counters, saturated at ``least`` (at most 255), so 2^bits bytes a task and filter are held and at most 2^bits / 8 bytes come back, whatever
    the input. Phrases that share a counter can only set its bit, never clear it; phrases that hold a part which the last of
    the given filters rules out are not counted.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be between 1 and 255")
    block = min(BLOCK, 1 << bits)
    shared = texts.sparkSession.sparkContext.broadcast(filters)
    widths = range(len(filters) + 1, len(filters) + 1 + more)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [np.zeros(1 << bits, np.uint8) for _ in widths]
        for lang, words, ids, piece in _rows(batches):
            last = _held(shared.value, lang, words, ids, piece, bits)[-1] if filters else None
            for width, held in zip(widths, counters, strict=True):
                keep, slot = _slots(lang, words, ids, piece, width, bits)
                for k in range(width - len(filters) + 1 if filters else 0):
                    keep = keep & last[k : len(slot) + k]
                at, n = np.unique(slot[keep], return_counts=True)
                held[at] = np.minimum(held[at] + n, least)
        for width, held in zip(widths, counters, strict=True):
            for i, part in enumerate(held.reshape(-1, block)):
                if part.any():
                    data = np.packbits(part > 0).tobytes() + part[part > 0].tobytes()
                    held = pa.compress(data, codec="zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (width, i, len(data))), pa.array([held], pa.binary())], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for width, i, size, part in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                data = np.frombuffer(pa.decompress(part, size, codec="zstd"), np.uint8)
                held = np.zeros(block, np.uint16)
                held[np.unpackbits(data[: block // 8]) > 0] = data[block // 8 :]
                total[width, i] = np.minimum(total.get((width, i), 0) + held, least).astype(np.uint8)
        for (width, i), part in total.items():
            bits_of = np.packbits(part >= least).tobytes()
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (width, i, len(bits_of))), pa.array([bits_of], pa.binary())], names)

    names = ["width", "block", "size", "held"]
    schema = "width int, block int, size int, held binary"
    out = np.zeros((more, max(1, (1 << bits) // block), block // 8), np.uint8)
    for r in over_texts(texts, count, schema).repartition("width", "block").mapInArrow(add, schema).collect():
        out[r["width"] - widths[0], r["block"]] = np.frombuffer(r["held"], np.uint8)
    return filters + [f.tobytes() for f in out]


def windows(texts: DataFrame, filters: list[bytes], bits: int) -> DataFrame:
    """(lang, w1 to w4, n): the longest window that leads at each word, padded with empty strings, counted over all texts.

    A window ends with its piece, or before two or three words that can not occur often enough together. Words that are too
    rare themselves are counted without a name.
    """
    shared = texts.sparkSession.sparkContext.broadcast(filters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids, piece in _rows(batches):
            held = _held(shared.value, lang, words, ids, piece, bits)
            # 0 pads; words are numbered from 1
            lead = [ids + 1]
            go = np.ones(len(ids), bool)
            for k in range(1, LONGEST):
                # the k-th word after this one ends a pair, from two on a triple as well
                for width, good in enumerate(held, 1):
                    if k + 1 >= width > 1:
                        go = go & np.concatenate([good[k + 1 - width :], np.zeros(min(len(ids), k + 1 - width), bool)])
                after = np.zeros(len(ids), np.int64)
                after[:-k] = lead[0][k:]
                lead.append(np.where(go, after, 0))
            wide = len(words) + 1
            single = lead[1] == 0
            # rare words only count as words, whichever they are
            n = np.bincount(np.where(held[0], lead[0], 0)[single], minlength=wide)
            alone = np.flatnonzero(n)
            columns, counts = [alone, *[np.zeros(len(alone), np.int64)] * (LONGEST - 1)], n[alone]
            if not single.all():
                more = [c[~single] for c in lead]
                front, back = more[0] * wide + more[1], more[2] * wide + more[3]
                order = np.lexsort((back, front))
                front, back = front[order], back[order]
                new = np.flatnonzero(np.concatenate([[True], (front[1:] != front[:-1]) | (back[1:] != back[:-1])]))
                columns = [np.concatenate([c, m[order][new]]) for c, m in zip(columns, more, strict=True)]
                counts = np.concatenate([counts, np.diff(new, append=len(front))])
            yield from _crates(lang, words, columns, counts, crates)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, rows, size, held in zip(*(b.column(c).to_pylist() for c in ("lang", "n", "size", "held")), strict=True):
                data = pa.decompress(held, size, codec="zstd", asbytes=True)
                counts = np.frombuffer(data, np.uint8, 4 * rows).reshape(4, rows).T.copy().view("<u4").ravel().astype(np.int64)
                phrases = pa.array(data[4 * rows :].split(b"\n"), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * rows, pa.string()), phrases, pa.array(counts)], ["lang", "phrase", "n"])

    # as many crates as a task's windows fill well; they grow with the texts
    crates = max(4, bits - 17)
    packed = over_texts(texts, count, "crate int, lang string, n int, size int, held binary")
    # a crate holds all rows of its windows, so each window leaves it as one row
    rows = packed.repartition("crate").mapInArrow(unpack, "lang string, phrase string, n long")
    rows = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    parts = F.split("phrase", " ")
    return rows.select("lang", *[F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(w) for k, w in enumerate(_WORDS)], "n")


def _crates(lang: str, words: list[bytes], columns: list[np.ndarray], counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Windows dealt over 2^bits crates by a hash of their words, each crate in the order of the words and compressed.

    A crate holds its counts, the lowest bytes first, then its windows, one a line. What crosses the network is some bytes a
    window instead of a row with all its words.
    """
    digest = xxhash.xxh3_64_intdigest
    h = np.concatenate([np.zeros(1, np.uint64), np.fromiter(map(digest, words), np.uint64, len(words))])
    x = h[columns[0]]
    for c in columns[1:]:
        x = x * _ODD ^ h[c]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    crate = (x >> np.uint64(64 - bits)).astype(np.int64)
    place = np.zeros(len(words) + 1, np.int64)
    place[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64) + 1] = np.arange(1, len(words) + 1)
    order = np.lexsort((*(place[c] for c in reversed(columns)), crate))
    crate, counts = crate[order], counts[order]
    columns = [c[order] for c in columns]
    named = [b"", *words]
    edges = np.flatnonzero(np.concatenate([[True], crate[1:] != crate[:-1]])).tolist() + [len(crate)]
    for at, end in zip(edges[:-1], edges[1:], strict=True):
        lines = [b" ".join([named[i] for i in row if i]) for row in zip(*(c[at:end].tolist() for c in columns), strict=True)]
        data = counts[at:end].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + b"\n".join(lines)
        held = pa.compress(data, codec="zstd", asbytes=True)
        yield pa.RecordBatch.from_pydict({
            "crate": pa.array([int(crate[at])], pa.int32()), "lang": [lang], "n": pa.array([end - at], pa.int32()), "size": pa.array([len(data)], pa.int32()),
            "held": pa.array([held], pa.binary()),
        })


def phrase_counts(texts: DataFrame, least: int = LEAST, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, width, f) of all words and phrases of up to four words that occur ``least`` times, and (lang, n) of all words.

    ROLLUP over the windows gives them all: the sum over all windows with the same first k words is the count of those words
    as a phrase, since wherever a phrase occurs it leads exactly one window. Windows of one word need no roll-up.
    """
    bits = counter_bits(texts) if bits is None else bits
    # words and pairs, then the triples of pairs that pass
    filters = gram_filters(texts, gram_filters(texts, [], 2, least, bits), 1, least, bits)
    # each window is there once; the roll-ups only move different windows
    counted = once(windows(texts, filters, bits), "windows")
    parts = [counted.where("w1 <> '' AND w2 = ''").select("lang", F.col("w1").alias("phrase"), F.lit(1).alias("width"), F.col("n").alias("f"))]
    for k in range(2, LONGEST + 1):
        # padding is not rolled up: windows of k words give phrases of k words and less
        rolled = texts.sparkSession.sql(
            f"""SELECT lang, array_join(array({", ".join(_WORDS[:k])}), ' ') AS phrase, {k} - bit_count(grouping_id()) AS width, sum(n) AS f
                FROM {{windows}} GROUP BY lang, ROLLUP({", ".join(_WORDS[:k])}) HAVING width > 0""",
            windows=counted.where(f"w{k} <> ''" + (f" AND w{k + 1} = ''" if k < LONGEST else "")),
        )
        parts.append(rolled)
    found = functools.reduce(DataFrame.unionByName, parts).groupBy("lang", "phrase", "width").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return once(found, "phrases"), counted.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, bits: int | None = None) -> DataFrame:
    """The first ``top`` phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` needs lang (null: und) and text (null: empty); other columns are not read. A phrase occurs ``least`` times at
    least; its score is that of its weakest cut, floor(2,000,000 * a / (l + r)), ties to the first cut; it is left out where a
    longer phrase around it has ``cover`` percent of its occurrences. Order: score, a, then the phrase's bytes. Repeated rows count as
    often as they occur; an empty table, and one without such phrases, gives no row. ``bits`` says how many counters (2^bits; None:
    by the size of the texts) thin the windows out before they are shuffled; it never changes the result.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    counts, totals = phrase_counts(texts, least, bits)
    wide = counts.where("width > 1").select("lang", "phrase", "width", F.col("f").alias("a"))
    cuts = wide.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("width") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - width)"))
    cuts = join_sized(cuts, counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"], "inner")
    cuts = join_sized(cuts, counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], "inner")
    score = F.expr(f"(cast({2 * SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("width") - 1), lambda w: F.transform(
        F.sequence(F.lit(0), F.col("width") - w), lambda s: F.array_join(F.slice(words, s + 1, w), " "))))
    longer = wide.where("width > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = join_sized(scored, longer, ["lang", "phrase"])
    kept = kept.where(F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * cover))
    kept = once(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # a language is cut in parts first, so many that a part and what the parts leave are about as long
    parts = F.pmod(F.xxhash64("phrase"), F.lit(math.isqrt(kept.count() // top) + 1))
    best = kept.withColumn("part", parts)
    best = best.withColumn("place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return join_sized(best, totals, ["lang"], "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
