"""Near-duplicate join: Jaccard similarity of word n-grams by a blocked sparse product of documents and n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
import functools
import hashlib
import itertools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from plantlake.joins import fits_broadcast, join_hot, join_sized
from plantlake.llm.common import aside, drop_table, most_frequent, once, over_texts
from plantlake.llm.graph import components

N = 5
# frequent n-grams that are put last in the order of prefixes, at most; seen this often among COUNTED n-grams
COMMON = 262_144
OFTEN = 3
# n-grams that a task counts together
COUNTED = 4_000_000
# classes of a shared n-gram that all its others are held against first
STARS = 8
# classes of a column from which all leads are used, three below
LONG = 64
# classes of a column, its largest component aside, that one task holds against the column
HOT_COLUMN = 50_000
# 64-bit words of the parity of a set
PARITY = 4
# documents of one block of the product
BLOCK_DOCS = 2_048

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finish of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of word n-grams; each distinct word of a slice is hashed once."""

    def __init__(self, n: int = N) -> None:
        self.n = n

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        lengths = [len(ws) for ws in words]
        number = _Numbers()
        flat = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(words)), np.int64, sum(lengths))
        codes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in number), "<u8")[flat]
        del words, number
        # windows of the whole slice at once; those that cross a border between texts are never looked at
        windows, out, at = _windows(codes, self.n), [], 0
        for length in lengths:
            h = windows[at : at + length - self.n + 1] if length >= self.n else _windows(codes[at : at + length], length)
            at += length
            h = np.sort(h.view(np.int64))
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h)
        return out


class _Numbers(dict):
    """Numbers of words in the order they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each ``width`` consecutive codes."""
    count = max(0, len(codes) - width + 1) if width else 0
    h = np.full(count, width, np.uint64)
    for k in range(width):
        h = _mix(h * _MULTIPLIER + codes[k : k + count])
    return h


def parity(shingles: np.ndarray) -> np.ndarray:
    """Four 64-bit words; every hash turns one of the 256 bits. Two sets differ in at least as many hashes as their words in bits."""
    turned = np.bincount((shingles.view(np.uint64) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(turned.astype(bool)).view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=8).digest()


def _key(shingles: np.ndarray) -> int:
    return int.from_bytes(set_key(shingles), "little", signed=True)


def sketch(shingles: np.ndarray) -> bytes:
    """How many hashes fall into each equal part of the hash range, one byte a part; empty where a byte is not enough."""
    bits = max(6, int(np.ceil(np.log2(max(1, len(shingles))))))
    counts = np.bincount((shingles.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def shared_at_most(a: np.ndarray, b: np.ndarray) -> int:
    """No more hashes than this are in both sets of two sketches."""
    while len(a) != len(b):
        if len(a) > len(b):
            a, b = b, a
        b = b.reshape(-1, 2).sum(axis=1, dtype=np.int64)
    return int(np.minimum(a, b).sum(dtype=np.int64))


def prefix_length(size: int, percent: int) -> int:
    """N-grams of which two sets of the wanted similarity share at least one, whatever the common order."""
    return size - -(-percent * size // 100) + 1


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = N, stars: int = STARS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Documents are sets of distinct n-word hashes (a shorter text is one n-gram of all its words); two link when
    100 * shared >= percent * united. Equal sets are one class from the start, whatever their number. Two sets that link
    share an n-gram among the first of each (its prefix) in any common order; n-grams that are frequent come last in
    it, the most frequent at the very end. The columns of the incidence matrix that are kept are those of prefixes.
    They are multiplied block by block:

    * first the classes of a column are held against ``stars`` of them only, and what links joins components;
    * columns whose classes are one component by then have nothing left to say; from the others all pairs of
      different components follow, so nothing is missed. The largest component of a column is held against the others,
      never against itself, and a column of many classes is spread over several tasks.

    The first n-gram that two sets share stands at a place in each; what follows it bounds the overlap, and pairs that
    this rules out in a column go at once (a pair that links stays in the column of its first shared n-gram). Then go those whose
    parities differ in too many bits, and those whose sketches (counts of hashes by range) leave too little room; the sets of the others meet in blocks of ``block_docs`` by ``block_docs`` classes. Nulls and empty texts have no n-gram and stay alone (component is their own doc_id);
    equal rows are equal classes; rows with a null doc_id take part and never name a component; an empty table gives no rows.
    """
    return _named(docs, percent, n, stars, block_docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _named(docs: DataFrame, percent: int, n: int, stars: int, block_docs: int) -> DataFrame:
    """(doc_id, text_hash, key, n, component, component_id) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    classes, common = _classes(texts, n)
    columns = _columns(texts, common, percent, n)
    sizes = once(classes.where("n > 0").groupBy("key").agg(F.max("n").alias("n"), F.min("text_hash").alias("text_hash"), *[F.max(w).alias(w) for w in _WORDS]), "sizes")
    sketches = classes.where("n > 0 and sketch is not null").select("key", "sketch")
    pairs = _held_against(columns, stars)
    fit = once(_fitting(pairs.where(_room(percent)), percent), "pairs")
    links = once(verified(texts, sizes, sketches, fit, percent, n, block_docs), "verified")
    member = components(links)
    known = member.withColumnRenamed("node", "key")
    now = columns.join(F.broadcast(known) if fits_broadcast(known) else known, "key", "left")
    now = once(now.withColumn("component", F.coalesce("component", "key")), "state")
    mixed = once(_mixed(now.where("hot")).join(sizes.select("key", *_WORDS), "key"), "mixed")
    near = _across(mixed, percent, functools.partial(join_hot, rows=HOT_COLUMN)).where(_alike(percent))
    # a column of a rare n-gram is one task's work: its classes meet where they were brought together, their parities later
    rare = _fitting(_across(_mixed_rare(now.where("not hot")), percent, DataFrame.join), percent)
    for end, tail in (("a", ""), ("b", "_b")):
        rare = rare.join(sizes.select(F.col("key").alias(end), F.col("n").alias(f"n{tail}"), *[F.col(w).alias(f"{w}{tail}") for w in _WORDS]), end)
    rest = rare.where(_alike(percent)).select("a", "b").unionByName(_fitting(near, percent)).distinct()
    rest = once(rest.join(fit, ["a", "b"], "left_anti"), "pairs")
    for scratch in (columns, now, mixed):
        drop_table(texts.sparkSession, scratch)
    if not rest.isEmpty():
        # the components found so far stand for the links that made them
        stars_found = member.select(F.col("node").alias("a"), F.col("component").alias("b"))
        member = components(stars_found.unionByName(once(verified(texts, sizes, sketches, rest, percent, n, block_docs), "verified")))
    joined = classes.join(member.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    # many rows of one class or component meet as one partial minimum per task
    first = joined.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return joined.join(first, "component", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def one_of_each(docs: DataFrame, percent: int = 80, n: int = N) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    Rows without an n-gram all stay. A row without doc_id stays only where no other of its component has one; of equal
    rows one stays. Columns are those of ``docs``, whatever their names.
    """
    names, docs = docs.columns, aside(docs, ("doc_id", "text"))
    found = _named(docs, percent, n, STARS, BLOCK_DOCS)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = found.where("n > 0").groupBy("component").agg(F.min(order).alias("first"))
    row = lambda c: F.xxhash64(F.col(f"{c}doc_id").isNull(), F.col(f"{c}doc_id"), F.col(f"{c}text_hash"))
    stay = once(best.select(row("first.").alias("_row")).unionByName(found.where("n = 0").select(row("").alias("_row"))).distinct(), "stay")
    keyed = docs.withColumn("_row", F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    kept = join_sized(keyed, stay, ["_row"], "left_semi")
    again = once(found.where("n > 0").groupBy(row("").alias("_row")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_row"), "again")
    if not again.isEmpty():
        kept = kept.join(again, "_row", "left_anti").unionByName(kept.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return kept.select(*docs.columns).toDF(*names)


_WORDS = [f"p{k}" for k in range(PARITY)]
CLASS_ROWS = "doc_id long, key long, n long, text_hash long, sketch binary, is_doc boolean, " + ", ".join(f"{w} long" for w in _WORDS)


def _class_rows(doc_id, key, n, text_hash, sketches: list[bytes | None], parities: np.ndarray, is_doc: bool) -> pa.RecordBatch:
    rows = {"doc_id": doc_id, "key": key, "n": n, "text_hash": text_hash, "sketch": pa.array(sketches, pa.binary()), "is_doc": np.full(len(key), is_doc)}
    return pa.RecordBatch.from_pydict(rows | {w: parities[:, k] for k, w in enumerate(_WORDS)})


def _room(percent: int) -> Column:
    """Whether two sets can have the similarity whose first shared n-gram is at place ``at`` of one and ``at_b`` of the other."""
    most = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    return (100 + percent) * most >= percent * (F.col("n") + F.col("n_b"))


def _alike(percent: int) -> Column:
    """Whether two sets can have the similarity by the bits in which their parities differ."""
    apart = functools.reduce(operator.add, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_b"))) for w in _WORDS])
    return (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n_b"))


def _fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of (key, n, key_b, n_b) whose sizes allow the similarity."""
    fit = pairs.where("key <> key_b").where(100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
    return fit.select(F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b")).distinct()


def _held_against(columns: DataFrame, stars: int) -> DataFrame:
    """Pairs of a class of a column and a class that leads in it.

    The classes of a column fall into ``stars`` parts by hash; of each part the one nearest the middle of its copies leads.
    The columns of rare n-grams are brought together once; those of frequent ones, of any length, are summed up first, and a
    row of a partial sum holds one lead, not one for each part.
    """
    mine = lambda k: F.pmod(F.xxhash64("key"), F.lit(stars)) == k
    found = [F.max(F.when(mine(k), F.struct("plain", "key", "n", "at"))) for k in range(stars)]
    leads = lambda best: F.transform(F.array_compact(F.array(*best)), lambda x: F.struct(*[x[c].alias(c) for c in ("key", "n", "at")]))
    column, frequent = W.partitionBy("shingle"), columns.where("hot")
    several = frequent.groupBy("shingle").agg(leads(found).alias("leads"), F.count(F.lit(1)).alias("size"))
    # dealt out before the leads are formed: else each row would travel with a lead of its own
    rare = columns.where("not hot").repartition("shingle")
    rare = rare.withColumn("leads", leads([f.over(column) for f in found])).withColumn("size", F.count(F.lit(1)).over(column))
    rows = [d.select("key", "n", "at", "leads", "size") for d in (frequent.join(several, "shingle"), rare)]
    # a short column needs few leads
    few = F.when(F.col("size") > LONG, F.col("leads")).otherwise(F.slice("leads", 1, 3))
    pairs = rows[0].unionByName(rows[1]).select("key", "n", "at", F.explode(few).alias("lead"))
    return pairs.select("key", "n", "at", *[F.col(f"lead.{c}").alias(f"{c}_b") for c in ("key", "n", "at")])


def _mixed(state: DataFrame) -> DataFrame:
    """The rows of columns with several components, and the largest of them as ``main``."""
    parts = state.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c"))
    parts = parts.groupBy("shingle").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"))
    return state.join(parts.where("parts > 1").drop("parts"), "shingle").select("shingle", "main", "key", "n", "at", "component")


def _mixed_rare(state: DataFrame) -> DataFrame:
    """The same for columns that one task can hold: their rows are brought together once."""
    column, part = W.partitionBy("shingle"), W.partitionBy("shingle", "component")
    rows = state.withColumn("lo", F.min("component").over(column)).withColumn("hi", F.max("component").over(column)).where("lo <> hi")
    rows = rows.withColumn("c", F.count(F.lit(1)).over(part)).withColumn("main", F.max(F.struct("c", "component")).over(column)["component"])
    return rows.select("shingle", "main", "key", "n", "at", "component")


def _across(mixed: DataFrame, percent: int, join: Callable) -> DataFrame:
    """Pairs of different components of a column; one of them at least is not its largest."""
    left = mixed.where("component <> main").drop("main")
    right = mixed.select("shingle", "main", *[F.col(c).alias(f"{c}_b") for c in left.columns if c != "shingle"])
    once_each = (F.col("component_b") == F.col("main")) | (F.col("component") < F.col("component_b"))
    return join(left, right, ["shingle"], how="inner").where(once_each & _room(percent))


def _classes(texts: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """One row (doc_id, key, n, text_hash, sketch, parity) per document, and the frequent n-grams with their counts; both from one pass over the texts.

    ``key`` is a 64-bit hash of the set. Only the first of the copies that a task meets has a sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, seen = Shingler(n), [], set()

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            often, many = values[counts >= OFTEN], counts[counts >= OFTEN]
            held.clear()
            seen.clear()
            return _class_rows(pa.nulls(len(often), pa.int64()), often, many, pa.nulls(len(often), pa.int64()), [None] * len(often), np.zeros((len(often), PARITY), np.int64), False)

        for b in batches:
            sets = shingler.sets(b.column("text").to_pylist())
            keys = np.array([_key(s) for s in sets], np.int64)
            # copies count once, or every n-gram of a copied text were frequent
            sketches = []
            for k, s in zip(keys.tolist(), sets, strict=True):
                fresh = len(s) and k not in seen
                sketches.append(sketch(s) if fresh else None)
                if fresh:
                    seen.add(k)
                    held.append(s)
            if sum(map(len, held)) > COUNTED:
                yield frequent()
            parities = np.array([parity(s) for s in sets]).reshape(len(sets), PARITY)
            yield _class_rows(b.column("doc_id"), keys, np.array([len(s) for s in sets], np.int64), b.column("text_hash"), sketches, parities, True)
        yield frequent()

    both = once(over_texts(texts, run, CLASS_ROWS), "classes")
    frequent = most_frequent(both.where("not is_doc").groupBy("key").agg(F.sum("n").alias("n")), COMMON)
    return both.where("is_doc").drop("is_doc"), frequent.select(F.col("key").alias("shingle"), F.col("n").alias("seen"))


def _columns(texts: DataFrame, common: DataFrame, percent: int, n: int) -> DataFrame:
    """(shingle, key, at, n, plain, hot): the prefix of every class, but for n-grams that one class alone has there, and their places in it.

    ``n`` is the size of the set, ``plain`` how many 255ths of it are frequent n-grams: more for texts near the middle of a
    group of copies. Both travel with the prefix, so that no later step has to fetch them by class.

    Rare n-grams come first, by hash; then the frequent ones, by how often they were seen, then by hash. The frequent n-grams, at most COMMON of them, are sent to the tasks. Their rows are dealt over many groups, so that a
    column of any length is never one task's work.
    """
    last = common.toPandas().sort_values("shingle")
    rank = np.unique(last["seen"].to_numpy(np.int64), return_inverse=True)[1].astype(np.int32) + 1
    sent = texts.sparkSession.sparkContext.broadcast((last["shingle"].to_numpy(np.int64), rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (late, rank), seen = Shingler(n), sent.value, set()
        for b in batches:
            parts, places, keys, about, hot = [], [], [], [], []
            for s in shingler.sets(b.column("text").to_pylist()):
                if not len(s):
                    continue
                key = _key(s)
                if key in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                at = np.minimum(np.searchsorted(late, s), max(0, len(late) - 1))
                turn = np.where(late[at] == s, rank[at], 0) if len(late) else np.zeros(len(s), np.int32)
                order = np.argsort(turn, kind="stable")[: prefix_length(len(s), percent)]
                parts.append(s[order])
                places.append(np.arange(len(order), dtype=np.int32))
                hot.append(turn[order] > 0)
                keys.append(np.full(len(order), key, np.int64))
                about.append(np.full(len(order), 256 * len(s) + 255 * np.count_nonzero(turn) // len(s), np.int64))
            if parts:
                yield pa.RecordBatch.from_pydict({"shingle": np.concatenate(parts), "key": np.concatenate(keys), "about": np.concatenate(about), "at": np.concatenate(places), "hot": np.concatenate(hot)})

    rows = over_texts(texts.select("text"), run, "shingle long, key long, about long, at int, hot boolean")
    # 0 for the others
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(1024)) + 1).otherwise(F.lit(0)).cast("short"))
    column = W.partitionBy("shingle", "salt")
    shared = rows.drop("hot").withColumn("lo", F.min("key").over(column)).withColumn("hi", F.max("key").over(column))
    # with the salt kept, equal rows already are in one task
    shared = shared.where("salt > 0 or lo <> hi").select("shingle", "salt", "key", "about", "at").distinct()
    size = [F.shiftright("about", 8).alias("n"), F.col("about").bitwiseAND(255).cast("short").alias("plain"), (F.col("salt") > 0).alias("hot")]
    return once(shared.select("shingle", "key", "at", *size), "columns")


def verified(texts: DataFrame, sizes: DataFrame, sketches: DataFrame, pairs: DataFrame, percent: int, n: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity: first by what their sketches allow, then by the sets themselves."""
    both = lambda p: p.select(F.col("a").alias("key")).unionByName(p.select(F.col("b").alias("key"))).distinct()
    ends = once(both(pairs), "ends")
    # of every class in a pair one sketch; those of all others stay where they are
    drawn = sketches.join(F.broadcast(ends) if fits_broadcast(ends) else ends, "key").groupBy("key").agg(F.first("sketch").alias("data"))
    pairs = once(_product(pairs, drawn, _bound(percent), 8 * block_docs), "allowed")
    sets = _sets(texts, both(pairs).join(sizes, "key").select("key", "text_hash"), n)
    return _product(pairs, sets.select("key", F.col("shingles").alias("data")), _overlap(percent), block_docs)


def _product(pairs: DataFrame, data: DataFrame, judge: Callable, block_docs: int) -> DataFrame:
    """The pairs that ``judge`` keeps, cell by cell.

    The classes that stand in pairs are dealt into blocks by hash; a cell is a block of left and a block of right
    classes. The data of a class goes once to each cell that has a pair of it.
    """
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    blocks = max(1, -(-ends.count() // block_docs))
    cell = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(9)), F.lit(blocks)).cast("long")
    placed = pairs.withColumn("cell", cell("a") * blocks + cell("b"))
    wanted = placed.select(F.col("cell").alias("place"), F.col("a").alias("key")).unionByName(placed.select(F.col("cell").alias("place"), F.col("b").alias("key"))).distinct()
    rows = wanted.join(data, "key").select("place", "key", "data")

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        column = right.column("data").combine_chunks()
        values = [column[int(i)].as_py() for i in order]
        keys = keys[order]
        a = np.searchsorted(keys, left.column("a").to_numpy())
        b = np.searchsorted(keys, left.column("b").to_numpy())
        turn = np.lexsort((b, a))
        a, b = a[turn], b[turn]
        kept = judge(values, a, b)
        return pa.table({"a": keys[a[kept]], "b": keys[b[kept]]})

    return placed.groupBy("cell").cogroup(rows.groupBy("place")).applyInArrow(multiply, "a long, b long")


def _bound(percent: int) -> Callable:
    """Pairs whose sketches leave room for the similarity."""

    def judge(values: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sketches = [np.frombuffer(v, np.uint8) for v in values]
        sizes = [int(s.sum(dtype=np.int64)) for s in sketches]
        kept = np.ones(len(a), bool)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            if len(sketches[i]) and len(sketches[j]):
                most = shared_at_most(sketches[i], sketches[j])
                kept[k] = 100 * most >= percent * (sizes[i] + sizes[j] - most)
        return kept

    return judge


def _overlap(percent: int) -> Callable:
    """Pairs whose sets have the similarity; overlaps add up n-gram by n-gram, one row of the product at a time."""

    def judge(values: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lengths = np.array([len(v) // 8 for v in values], np.int64)
        _, code = np.unique(np.frombuffer(b"".join(values), np.int64), return_inverse=True)
        starts = np.cumsum(lengths) - lengths
        mark = np.zeros(int(code.max()) + 1 if len(code) else 0, bool)
        linked = np.zeros(len(a), bool)
        edges = np.flatnonzero(np.diff(a, prepend=-1, append=-1))
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            i = a[s]
            row = code[starts[i] : starts[i] + lengths[i]]
            mark[row] = True
            for at in range(s, e, 512):
                some = b[at : min(e, at + 512)]
                counts = lengths[some]
                ends = np.cumsum(counts)
                place = np.repeat(starts[some] - (ends - counts), counts) + np.arange(ends[-1])
                shared = np.add.reduceat(mark[code[place]].astype(np.int64), ends - counts)
                linked[at : at + len(some)] = 100 * shared >= percent * (lengths[i] + counts - shared)
            mark[row] = False
        return linked

    return judge


def _sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, shingles) of the wanted (key, text_hash), made again from one text each: sets are never stored for all documents."""
    wanted = once(wanted, "wanted")
    chosen = texts.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, "text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for b in batches:
            sets = shingler.sets(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])

    # equal texts give equal sets
    return over_texts(chosen.select("key", "text"), run, "key long, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
