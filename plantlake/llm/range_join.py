"""Exact metric range join: vectors are dealt to the cells of pivots, borders are copied by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantlake.llm.common import once
from plantlake.llm.graph import components
from plantlake.llm.vectors import matrix, vector_classes

# vectors of a cell that the number of pivots aims at, pivots at most, and vectors that one task holds of either side
CELL = 8_192
PIVOTS = 1_024
BLOCK = 8_192
# doubt of a product in single precision; inside it the double-precision value decides
DOUBT = 1e-5


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of unit vectors to the pivots, and the nearest pivot of each."""
    d = np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0))
    return d, d.argmin(axis=1)


def _roots(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Merge linked places: the smallest place that links lead to; ``root`` holds earlier merges."""
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (before == root).all():
            break
    return root


def range_join(vectors: DataFrame, least: float = 0.9, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs of rows with cosine >= ``least``.

    n_links counts the other rows linked directly, component_id is the smallest vec_id that links lead to, kept says that it
    is the row's own. Equal vectors are one class, joined once and counted as often as there are rows. On unit vectors the cosine is a
    distance of at most e = sqrt(2 - 2 * least). Each class is at home in the cell of its nearest pivot and visits every cell
    that may hold a partner: with d the distance to a pivot, the triangle inequality gives d(visited) <= radius of
    the cell + e, and the distance to the border between the pivots at most e. Cells join on their own; a cell is cut into
    blocks of home and of all its vectors, so a task holds two blocks however crowded a cell is. Links become counts and a
    spanning forest inside each task; pairs are never written.

    Vectors that are null, zero or hold null or non-finite components link with nothing (n_links 0, own component); a row
    without vec_id takes part and never names a component; vectors of different lengths don't link. An empty table gives no rows.
    """
    classes = vector_classes(vectors, 1).withColumn("width", F.size("vec"))
    per_width = classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()
    counts, links = None, None
    for row in sorted(per_width, key=lambda r: r["width"]):
        found = _join_cells(classes.where(F.col("width") == row["width"]), row["n"], least, cell, block)
        ours = found.where("link is null").groupBy("cid").agg(F.sum("n").alias("n_links"))
        theirs = found.where("link is not null").select(F.col("cid").alias("a"), F.col("link").alias("b"))
        counts, links = (ours, theirs) if counts is None else (counts.unionByName(ours), links.unionByName(theirs))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    member = components(links)
    named = classes.select("cid", "vec", F.col("ids")[0].alias("first")).join(member.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("component", F.coalesce("component", "cid"))
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    facts = named.join(lowest, "component").join(counts, "cid", "left").select("vec", F.coalesce("n_links", F.lit(0)).alias("n"), "lowest")
    joined = rows.join(facts, "vec", "left")
    component = F.coalesce("lowest", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


FOUND = "cid long, n long, link long"


def _join_cells(classes: DataFrame, total: int, least: float, cell: int, block: int) -> DataFrame:
    """(cid, n, null): rows linked to each class, in parts; (cid, null, link): links that hold the components together."""
    reach = float(np.sqrt(2.0 - 2.0 * least)) + 1e-9
    wanted = max(1, min(PIVOTS, -(-total // cell)))
    # a bounded number of pivots, chosen by a hash
    chosen = classes.orderBy(F.xxhash64("cid"), "cid").limit(wanted).select("vec").collect()
    pivots = _unit(np.array([r["vec"] for r in chosen], np.float64))
    apart = np.sqrt(np.maximum(2.0 - 2.0 * (pivots @ pivots.T), 1e-12))
    sent = classes.sparkSession.sparkContext.broadcast((pivots, apart))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d, own = _nearest(_unit(matrix(b.column("vec"))), sent.value[0])
                yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("n"), b.column("vec"), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(d)), own])], ["cid", "n", "vec", "home", "away"])

    homes = once(classes.select("cid", "n", "vec").mapInArrow(home, "cid long, n long, vec array<double>, home int, away double"), "homes")
    # as many rows as pivots
    facts = {r["home"]: (r["radius"], r["n"]) for r in homes.groupBy("home").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    radius = np.array([facts.get(j, (-np.inf, 0))[0] for j in range(wanted)])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots_, apart_ = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            d, _ = _nearest(_unit(matrix(b.column("vec"))), pivots_)
            own = b.column("home").to_numpy()
            mine = d[np.arange(len(d)), own]
            border = (d * d - (mine * mine)[:, None]) / (2.0 * apart_[own])
            go = (d <= radius[None, :] + reach) & (border <= reach)
            go[np.arange(len(d)), own] = True
            row, to = np.nonzero(go)
            yield from pa.Table.from_batches([b.take(pa.array(row))]).append_column("cell", pa.array(to.astype(np.int32))).to_batches()

    placed = homes.mapInArrow(visits, "cid long, n long, vec array<double>, home int, away double, cell int")
    crowd = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    # blocks of each cell: home side and all of it; as many rows as pivots
    blocks = classes.sparkSession.createDataFrame(
        [(j, max(1, -(-facts.get(j, (0, 0))[1] // block)), max(1, -(-crowd.get(j, 0) // block))) for j in range(wanted)], "cell int, homes int, alls int"
    )
    dealt = placed.join(F.broadcast(blocks), "cell")
    pick = lambda parts, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(parts)).cast("int")
    grid = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    at_home = dealt.where("home = cell").select("cell", pick("homes", 1).alias("a"), grid("alls").alias("b"), "cid", "n", "vec", F.lit(True).alias("at_home"))
    everyone = dealt.select("cell", grid("homes").alias("a"), pick("alls", 2).alias("b"), "cid", "n", "vec", F.lit(False).alias("at_home"))

    def compare(group: pa.Table) -> pa.Table:
        at_home_ = group.column("at_home").to_numpy()
        ids, n = group.column("cid").to_numpy(), group.column("n").to_numpy()
        unit = _unit(matrix(group.column("vec").combine_chunks()))
        left, right = np.flatnonzero(at_home_), np.flatnonzero(~at_home_)
        # a class meets itself in one block only; its own other rows are counted there
        sums = np.zeros(len(left), np.int64)
        names = np.unique(ids)
        root = np.arange(len(names))
        where = np.searchsorted(names, ids)
        single = unit.astype(np.float32)
        for s in range(0, len(left), 512):
            some = left[s : s + 512]
            cos = single[some] @ single[right].T
            i, j = np.nonzero(cos >= least - DOUBT)
            near = np.flatnonzero(cos[i, j] <= least + DOUBT)
            sure = np.ones(len(i), bool)
            sure[near] = np.einsum("ij,ij->i", unit[some[i[near]]], unit[right[j[near]]]) >= least
            i, j = i[sure], j[sure]
            same = ids[some[i]] == ids[right[j]]
            sums[s : s + len(some)] += np.bincount(i, n[right[j]] - same, minlength=len(some)).astype(np.int64)
            root = _roots(where[some[i[~same]]], where[right[j[~same]]], root)
        moved = np.flatnonzero(root != np.arange(len(root)))
        linked = np.flatnonzero(sums)
        return pa.table({
            "cid": pa.array(np.concatenate([ids[left[linked]], names[moved]])),
            "n": pa.array([*sums[linked].tolist(), *[None] * len(moved)], pa.int64()),
            "link": pa.array([*[None] * len(linked), *names[root[moved]].tolist()], pa.int64()),
        })

    return once(at_home.unionByName(everyone).groupBy("cell", "a", "b").applyInArrow(compare, FOUND), "found")
