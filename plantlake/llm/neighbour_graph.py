"""Approximate nearest neighbours: NN-descent builds a neighbour graph by joins, queries search it greedily."""

from __future__ import annotations

from collections.abc import Iterator
import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plantlake.joins import join_sized
from plantlake.llm.common import drop_table, lists, once
from plantlake.llm.vectors import matrix, vector_classes

# neighbours of a node in the graph, and nodes that name it which it looks at beside them
NEAR = 24
NAMED = 24
# nodes that are compared with each other at the start, and starts
LEAF = 192
STARTS = 4
ROUNDS = 6
# share of changed neighbours below which the graph is done
SETTLED = 0.02
# candidates that a query keeps, those it opens in one round, and rounds at most
KEPT = 200
OPENED = 48
STEPS = 40
# random nodes that a walk may start from beside its own, about, and how many of them it starts from
ENTRIES = 512
ENTERED = 16
# nodes that the middle of a random direction is taken from, about
MIDDLE = 4_096
# bytes of the queries that are compared with all vectors in one pass
EXACT_BYTES = 16 * 1024 * 1024
# rows that travel to a Python worker at once: each may carry the codes of all neighbours of a node
BATCH_ROWS = 500
# found pairs that a task holds before it keeps the best of each node, and pairs kept that it hands on
FOUND_PAIRS = 500_000
KEPT_PAIRS = 375_000


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables written inside travel in batches of ``BATCH_ROWS`` rows, which bounds the buffers of both ends."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    # a caller's smaller or unbounded (not positive) number of rows
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _codes_of(vectors: DataFrame) -> DataFrame:
    """(cid, code): vectors in single precision, for work on the graph; results use the vectors themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [v.values.to_numpy(zero_copy_only=False).astype(np.float32).tobytes() for v in b.column("vec")]
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array(codes, pa.binary())], ["cid", "code"])

    return once(vectors.select("cid", "vec").mapInArrow(run, "cid long, code binary"), "codes")


def _codes(column: pa.Array) -> np.ndarray:
    """Codes as a matrix in double precision, so that near copies far from the origin stay apart; all codes of a column have one length."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float32).reshape(len(parts), -1).astype(np.float64) if parts else np.zeros((0, 0))


def _pair_distances(x: np.ndarray) -> np.ndarray:
    # the origin plays no part, and close to one of the vectors the squares of a tight group lose nothing
    x = x - x[:1]
    square = (x * x).sum(axis=1)
    out = square[:, None] + square[None, :] - 2.0 * (x @ x.T)
    return np.maximum(out, 0.0)


def _best(node: np.ndarray, near: np.ndarray, dist: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` nearest different neighbours of every node, by node, then distance, then neighbour."""
    order = np.lexsort((near, node))
    node, near, dist = node[order], near[order], dist[order]
    fresh = np.concatenate([[True], (node[1:] != node[:-1]) | (near[1:] != near[:-1])]) if len(node) else np.zeros(0, bool)
    node, near, dist = node[fresh], near[fresh], dist[fresh]
    order = np.lexsort((near, dist, node))
    node, near, dist = node[order], near[order], dist[order]
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    top = rank < keep
    return node[top], near[top], dist[top]


def _rows(node: np.ndarray, near: np.ndarray, dist: np.ndarray) -> pa.Table:
    """One row per node from sorted flat lists."""
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(node)))
    return pa.table({"node": pa.array(node[starts], pa.int64()), "near": lists(near, counts, pa.int64()), "dist": lists(dist, counts, pa.float64())})


LISTS = "node long, near array<long>, dist array<double>"


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """One list per node from several: the nearest ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, dist = b.column("near"), b.column("dist")
            counts = near.value_lengths().to_numpy(zero_copy_only=False)
            out = _best(np.repeat(b.column("node").to_numpy(), counts), near.flatten().to_numpy(), dist.flatten().to_numpy(), keep)
            yield from _rows(*out).to_batches()

    grouped = found.groupBy("node").agg(F.flatten(F.collect_list("near")).alias("near"), F.flatten(F.collect_list("dist")).alias("dist"))
    return grouped.mapInArrow(run, LISTS)


def _some(codes: DataFrame, number: int, total: int, seed: int) -> list:
    """About ``number`` nodes (cid, code), chosen by a hash: all, if there are fewer."""
    return codes.where(F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(max(1, total))) < number).select("cid", "code").limit(2 * number).collect()


def _first_graph(codes: DataFrame, near: int, leaf: int, starts: int, total: int) -> DataFrame:
    """Neighbours inside small cells: sides of random directions around the middle of the vectors, cut into groups of bounded size.

    One more deal into random cells gives every node neighbours from anywhere, however few share its other cells.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, total) / leaf))))
    middle = _codes(pa.array([r["code"] for r in _some(codes, MIDDLE, total, 1)], pa.binary()))
    planes = [np.random.default_rng(7 + s).standard_normal((middle.shape[1], bits)) for s in range(starts)]
    middles = [np.median(middle @ p, axis=0) if len(middle) else np.zeros(bits) for p in planes]
    anywhere = max(1, int(np.ceil(total / leaf)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _codes(b.column("code"))
            for s in range(starts):
                plane = planes[s] if len(middle) else np.zeros((x.shape[1], bits))
                cell = ((x @ plane) > middles[s]) @ (1 << np.arange(bits)) if bits else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), s, np.int32)), pa.array(cell.astype(np.int64)), b.column("cid"), b.column("code")], ["turn", "cell", "cid", "code"])

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("cid")
        ids = group.column("cid").to_numpy()
        d = _pair_distances(_codes(group.column("code")))
        np.fill_diagonal(d, np.inf)
        k = min(near, len(ids) - 1)
        if k < 1:
            return _rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        return _rows(np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(d, at, 1).ravel())

    dealt = codes.mapInArrow(sign, "turn int, cell long, cid long, code binary")
    dealt = dealt.unionByName(codes.select(F.lit(starts).alias("turn"), F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(anywhere)).alias("cell"), "cid", "code"))
    sizes = dealt.groupBy("turn", "cell").agg(F.ceil(F.count(F.lit(1)) / (4 * leaf)).cast("int").alias("parts"))
    # a crowded cell is cut at random, so that no group is larger than a few leaves
    dealt = join_sized(dealt, sizes, ["turn", "cell"], "inner").withColumn("part", F.pmod(F.xxhash64("cid", "turn"), F.col("parts")))
    return _merged(dealt.groupBy("turn", "cell", "part").applyInArrow(compare, LISTS), near)


def _members(graph: DataFrame, codes: DataFrame, named: int, seed: int) -> DataFrame:
    """(center, member, fresh, code, worst): the neighbours of every node and some of those that name it, with their codes.

    A node that very many name looks at about ``named`` of them, chosen by a hash; counts are added up before the shuffle.
    """
    flat = graph.select("node", F.explode(F.arrays_zip("near", "fresh")).alias("e")).select("node", F.col("e.near").alias("near"), F.col("e.fresh").alias("fresh"))
    degree = flat.groupBy("near").agg(F.count(F.lit(1)).alias("degree"))
    back = flat.join(degree, "near").where(F.pmod(F.xxhash64("near", "node", F.lit(seed)), F.col("degree")) < named)
    both = flat.select(F.col("node").alias("center"), F.col("near").alias("member"), "fresh").unionByName(
        back.select(F.col("near").alias("center"), F.col("node").alias("member"), "fresh")
    )
    both = both.groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
    facts = graph.select(F.col("node").alias("cid"), F.element_at("dist", -1).alias("worst"), F.size("near").alias("k")).join(codes, "cid")
    return both.join(facts.withColumnRenamed("cid", "member"), "member").select("center", "member", "fresh", "code", "worst", "k")


def _improve(members: DataFrame, near: int) -> DataFrame:
    """Neighbours of neighbours: the members of a node are compared with each other; each hands on what is nearer than its worst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                yield from _rows(*_best(*(np.concatenate(c) for c in zip(*held, strict=True)), near)).to_batches(5_000)

        for b in batches:
            for ids, fresh, worst, codes in zip(b.column("member"), b.column("fresh"), b.column("worst"), b.column("code"), strict=True):
                ids, fresh, worst = ids.values.to_numpy(), fresh.values.to_numpy(zero_copy_only=False), worst.values.to_numpy()
                d = _pair_distances(_codes(codes.values))
                useful = (fresh[:, None] | fresh[None, :]) & (d < worst[:, None])
                np.fill_diagonal(useful, False)
                i, j = np.nonzero(useful)
                held.append((ids[i], ids[j], d[i, j]))
                size += len(i)
                if size > FOUND_PAIRS:
                    kept = _best(*(np.concatenate(c) for c in zip(*held, strict=True)), near)
                    held[:], size = [kept], 0
                    if len(kept[0]) > KEPT_PAIRS:
                        yield from out()
                        held.clear()
        yield from out()

    worst = F.when(F.col("k") < near, F.lit(float("inf"))).otherwise(F.col("worst"))
    grouped = members.withColumn("worst", worst).groupBy("center").agg(*[F.collect_list(c).alias(c) for c in ("member", "fresh", "worst", "code")])
    return grouped.mapInArrow(run, LISTS)


def neighbour_graph(codes: DataFrame, near: int = NEAR, named: int = NAMED, rounds: int = ROUNDS, leaf: int = LEAF, starts: int = STARTS) -> DataFrame:
    """(node, near, dist, fresh): about the ``near`` nearest nodes of every node, by NN-descent.

    From a start inside random cells, each round joins neighbours with neighbours of neighbours; only pairs with one member
    that is new to its list are compared. It ends when few lists change. Every round is written and the one before removed.
    """
    spark = codes.sparkSession
    total = codes.count()
    first = _first_graph(codes, near, leaf, starts, total).withColumn("fresh", F.transform("near", lambda _: F.lit(True)))
    # a node that met nobody still belongs to the graph
    empty = codes.select(F.col("cid").alias("node"), F.array().cast("array<long>").alias("near"), F.array().cast("array<double>").alias("dist"), F.array().cast("array<boolean>").alias("fresh"))
    graph = once(first.unionByName(empty.join(first.select("node"), "node", "left_anti")), "graph")
    for turn in range(rounds):
        found = _improve(_members(graph.where(F.size("near") > 0), codes, named, turn), near)
        merged = _merged(found.unionByName(graph.select("node", "near", "dist")), near)
        old = graph.select(F.col("node").alias("cid"), F.col("near").alias("before"))
        after = merged.join(old, merged["node"] == old["cid"]).select("node", "near", "dist", F.transform("near", lambda x: ~F.array_contains("before", x)).alias("fresh"))
        after = once(after, "graph")
        changed = after.agg(F.sum(F.size(F.filter("fresh", lambda x: x))).alias("n")).first()["n"] or 0
        drop_table(spark, graph)
        graph = after
        if changed <= SETTLED * total * near:
            break
    return graph


def _leading(ranked: list[tuple[float, int]], kept: int) -> list[tuple[float, int]]:
    """The first ``kept`` candidates and all that are as near as the last of them."""
    end = min(kept, len(ranked))
    while 0 < end < len(ranked) and ranked[end][0] == ranked[end - 1][0]:
        end += 1
    return ranked[:end]


STATE = "qid long, code binary, seen array<long>, near array<long>, dist array<double>, opened array<boolean>"


def search(codes: DataFrame, graph: DataFrame, queries: DataFrame, named: int = NAMED, kept: int = KEPT, opened: int = OPENED, steps: int = STEPS) -> DataFrame:
    """(qid, near): the ``kept`` best nodes, and their ties, that a greedy walk finds, for (qid) nodes of the graph.

    A walk starts from the query's own node and from the nearest of some random nodes, so that a closed group does not end it. A round opens the best nodes not opened yet: they are joined with the lists of the graph, which carry the codes of the
    neighbours, so that only nodes and distances travel back to the query. A walk ends when its best nodes are all opened.
    """
    spark = codes.sparkSession
    around = once(_members(graph.where(F.size("near") > 0), codes, named, 0).groupBy("center").agg(F.collect_list("member").alias("member"), F.collect_list("code").alias("codes")), "around")
    pool = _some(codes, ENTRIES, codes.count(), 3)
    pool_ids, pool_codes = np.array([r["cid"] for r in pool], np.int64), _codes(pa.array([r["code"] for r in pool], pa.binary()))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, dist = [], []
            for qid, code in zip(b.column("qid").to_pylist(), b.column("code").to_pylist(), strict=True):
                d = ((pool_codes - np.frombuffer(code, np.float32).astype(np.float64)) ** 2).sum(axis=1) if len(pool_ids) else np.zeros(0)
                others = [i for i in np.argsort(d, kind="stable")[: ENTERED + 1] if pool_ids[i] != qid][:ENTERED]
                near.append([qid, *pool_ids[others].tolist()])
                dist.append([0.0, *d[others].tolist()])
            ids = pa.array(near, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("qid"), b.column("code"), ids, ids, pa.array(dist, pa.list_(pa.float64())), pa.array([[False] * len(n) for n in near], pa.list_(pa.bool_()))],
                ["qid", "code", "seen", "near", "dist", "opened"],
            )

    state = once(queries.join(codes, queries["qid"] == codes["cid"]).select("qid", "code").mapInArrow(enter, STATE), "walks")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, dist = [], []
            for code, member, codes_ in zip(b.column("code"), b.column("member"), b.column("codes"), strict=True):
                x = _codes(codes_.values)
                q = np.frombuffer(code.as_py(), np.float32).astype(np.float64)
                near.append(member.values.to_numpy())
                dist.append(((x - q) ** 2).sum(axis=1))
            if not near:
                continue
            counts = np.array([len(n) for n in near])
            yield pa.RecordBatch.from_arrays(
                [b.column("qid"), lists(np.concatenate(near), counts, pa.int64()), lists(np.concatenate(dist), counts, pa.float64())], ["qid", "near", "dist"]
            )

    def step(walk: pa.Table, found: pa.Table) -> pa.Table:
        # every front belongs to a walk
        row = walk.slice(0, 1).to_pylist()[0]
        best = sorted((d, n) for d, n, o in zip(row["dist"], row["near"], row["opened"], strict=True) if not o)[:opened]
        done = {n for n, o in zip(row["near"], row["opened"], strict=True) if o} | {n for _, n in best}
        seen = set(row["seen"])
        new: dict[int, float] = {}
        for ns, ds in zip(found.column("near").to_pylist(), found.column("dist").to_pylist(), strict=True):
            new.update((n, d) for n, d in zip(ns, ds, strict=True) if n not in seen)
        ranked = _leading(sorted([*zip(row["dist"], row["near"], strict=True), *((d, n) for n, d in new.items())]), kept)
        return pa.table({
            "qid": [row["qid"]], "code": pa.array([row["code"]], pa.binary()), "seen": pa.array([sorted(seen | set(new))], pa.list_(pa.int64())),
            "near": pa.array([[n for _, n in ranked]], pa.list_(pa.int64())), "dist": pa.array([[d for d, _ in ranked]], pa.list_(pa.float64())),
            "opened": pa.array([[n in done for _, n in ranked]], pa.list_(pa.bool_())),
        })

    closed = F.filter(F.arrays_zip("dist", "near", "opened"), lambda x: ~x["opened"])
    for _ in range(steps):
        front = state.select("qid", "code", F.explode(F.slice(F.array_sort(closed), 1, opened)).alias("e")).select("qid", "code", F.col("e.near").alias("center"))
        if front.isEmpty():
            break
        # the front is measured: broadcast while it is small, joined by node beyond
        met = join_sized(around, front, ["center"], "inner").select("qid", "code", "member", "codes").mapInArrow(look, "qid long, near array<long>, dist array<double>")
        left, right = state.alias("l"), met.withColumnRenamed("qid", "walk")
        after = once(left.groupBy("qid").cogroup(right.groupBy("walk")).applyInArrow(lambda w, f: step(w, f), STATE), "walks")
        drop_table(spark, state)
        state = after
    return state.select("qid", "near")


def _exact(classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, score, vec_id): the ``k`` nearest of all rows for each of (query_id, query), and some more.

    The queries go through all vectors in blocks of bounded size; a task keeps the nearest ``k`` vectors of each that hold another id.
    """
    width = F.sum(8 * F.size("query") + 64).alias("bytes")
    size = asked.agg(width).first()["bytes"] or 0
    blocks = max(1, -(-size // EXACT_BYTES))
    out = None
    for block in range(blocks):
        questions = [(r["query_id"], np.array(r["query"])) for r in asked.where(F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(blocks)) == block).collect()]

        def run(batches: Iterator[pa.RecordBatch], questions: list = questions) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[float, int, list[int]]]] = [[] for _ in questions]
            for b in batches:
                if not b.num_rows:
                    continue
                x, ids = matrix(b.column("vec")), b.column("ids").to_pylist()
                first, second = np.array([i[0] for i in ids]), np.array([i[1] if len(i) > 1 else -1 for i in ids])
                lone = np.array([len(i) == 1 for i in ids])
                for at, (own, query) in enumerate(questions):
                    d = np.sqrt(((query - x) ** 2).sum(axis=1))
                    usable = np.flatnonzero(~(lone & (first == own)))
                    smallest = np.where(first == own, second, first)[usable]
                    top = usable[np.lexsort((smallest, d[usable]))[:k]]
                    found = [(float(d[i]), ids[i][0] if ids[i][0] != own else ids[i][1], ids[i]) for i in top]
                    best[at] = sorted(best[at] + found)[:k]
            for (own, _), found in zip(questions, best, strict=True):
                rows = [(d, i) for d, _, members in found for i in members if i != own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own] * len(rows), pa.int64()), pa.array([d for d, _ in rows], pa.float64()), pa.array([i for _, i in rows], pa.int64())], ["query_id", "score", "vec_id"]
                )

        part = classes.select("vec", "ids").mapInArrow(run, "query_id long, score double, vec_id long")
        out = part if out is None else out.unionByName(part)
    return out


def nearest(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): about the ``k`` nearest rows of every query row, nearest first, ties to smaller vec_id.

    ``is_query`` is a condition on vec_id; candidates are all rows but the query's own vec_id. Score is the Euclidean distance
    in double precision on the vectors given. Vectors that are null, zero or hold null or non-finite components take
    no part, nor do rows without vec_id. Equal vectors are one node of the graph and come back with their smallest ids. An empty
    table gives no rows. All vectors have one length. A query that the graph leaves short of ``k`` rows is compared with all rows.
    """
    with _small_batches(vectors.sparkSession):
        best = _nearest(vectors, is_query, k)
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _nearest(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """(query_id, best): the ``k`` nearest found of every query."""
    classes = vector_classes(vectors.where("vec_id is not null"), k + 1)
    codes = _codes_of(classes)
    graph = neighbour_graph(codes)
    asked = once(
        vectors.where(is_query).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec")).distinct()
        .join(classes.select("vec", "cid"), "vec").select("query_id", F.col("cid").alias("qid"), F.col("vec").alias("query")), "queries",
    )
    found = search(codes, graph, asked.select("qid").distinct())
    pairs = asked.join(found.select("qid", F.explode("near").alias("cid")), "qid").join(classes.select("cid", "vec", "ids"), "cid")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.sqrt(((matrix(b.column("query")) - matrix(b.column("vec"))) ** 2).sum(axis=1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("ids"), pa.array(d)], ["query_id", "ids", "score"])

    scored = pairs.select("query_id", "query", "vec", "ids").mapInArrow(measure, "query_id long, ids array<long>, score double")
    rows = scored.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    # at most KEPT and their ties, times k + 1, rows a query
    best = once(_top(rows, k), "nearest")
    full = best.where(F.size("best") >= k).select("query_id")
    short = once(asked.select("query_id", "query").join(full, "query_id", "left_anti"), "short")
    if not short.isEmpty():
        best = best.where(F.size("best") >= k).unionByName(once(_top(_exact(classes, short, k), k), "exact"))
    return best


def _top(rows: DataFrame, k: int) -> DataFrame:
    return rows.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
