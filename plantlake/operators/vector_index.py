"""Stored indexes for approximate nearest chunks: an inverted file of coarse cells, and hashed buckets.

Chunks are stored partitioned by the cell they fall into, so that a search reads the cells it visits and no others. There
are about as many cells as the square root of the chunks. How many cells a question visits is not a constant: when the index
is built, a bounded sample of the stored vectors asks for its exact neighbours, and as many cells are visited as the
wanted share of those neighbours needs. Cells that a distance bound rules out are left out of the visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import json
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plantlake.operators.neighbours import (
    CHUNK_BLOCK, GROUPS_A_CORE, K, LEAST_CHUNKS, PAIRS, bits_of, completed, exact_top_k, matrix_of, top_k_in_runs, vectors_of,
)
from plantlake.session import scratch_path, settle

# rows per cell that the centres, or the borders of the buckets, are fitted on
SAMPLE_PER_CELL = 64
# stored vectors that ask for their neighbours when the index is built
QUESTIONS = 256
# share of the true neighbours that the visited cells should hold
TARGET = 0.95
CELLS_AT_MOST = 65_536
# distances of vectors to cells that a task holds at a time
DISTANCES = 1 << 18
# questions that a task holds, by their number and by the values of their vectors
QUESTION_BLOCK = 1 << 17
QUESTION_VALUES = 1 << 23
# cells of a run
RUN_CELLS = 4_096
KINDS = ("cells", "hashes")


@dataclass(frozen=True)
class Centres:
    """Cells around centres; ``reach`` is the distance of the farthest vector of each cell, NaN for an empty one."""

    centres: np.ndarray
    reach: np.ndarray | None = None

    @property
    def cells(self) -> int:
        return len(self.centres)

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def far(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ self.centres.T) + (self.centres * self.centres).sum(axis=1)[None, :]
        return np.sqrt(np.maximum(square, 0.0))

    def place(self, x: np.ndarray) -> np.ndarray:
        """(vectors, 1): the cell of each vector, ties to the smaller number."""
        return np.argmin(self.far(x), axis=1)[:, None]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What cells are visited by, nearest first, and how near their vectors may be at best."""
        far = self.far(x)
        return far, np.maximum(0.0, far - np.nan_to_num(self.reach, nan=-np.inf))


@dataclass(frozen=True)
class Hashes:
    """Buckets of joined hashes: per table some orthogonal directions, each cut at the median of the data along it.

    The bits of all directions of a table make one key; ``tables`` of them are searched together.
    """

    directions: np.ndarray
    cuts: np.ndarray
    used: np.ndarray | None = None

    @property
    def cells(self) -> int:
        return len(self.cuts) << self.cuts.shape[1]

    @property
    def width(self) -> int:
        return self.directions.shape[2]

    def along(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, directions): signed distance to each cut."""
        return np.einsum("nd,tmd->ntm", x, self.directions) - self.cuts[None]

    def place(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables): the bucket of each vector in each table."""
        tables, m = self.cuts.shape
        return ((self.along(x) > 0) << np.arange(m)).sum(axis=2) + (np.arange(tables) << m)[None, :]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distance to the region of each bucket: directions are orthogonal, so no vector in it is nearer."""
        tables, m = self.cuts.shape
        along = self.along(x)
        sides = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(bool)
        square = along * along
        # a bucket on the other side of a cut is at least as far away as the cut
        above, below = np.where(along > 0, square, 0.0), np.where(along > 0, 0.0, square)
        far = np.sqrt(np.einsum("ntm,bm->ntb", above, ~sides) + np.einsum("ntm,bm->ntb", below, sides)).reshape(len(x), tables << m)
        return (far if self.used is None else np.where(self.used[None, :], far, np.inf)), far


@dataclass(frozen=True)
class Runs:
    """Cells in runs of neighbouring numbers with about as many chunks; a cell with more is dealt over ``parts`` runs of its own.

    By cell: its first run (-1 when it is empty), how many it has, its place there. ``cells`` is the number of cells by run.
    """

    first: np.ndarray
    parts: np.ndarray
    at: np.ndarray
    cells: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, rows: int) -> Runs:
        first, parts, at = np.full(len(sizes), -1), np.ones(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        cells: list[int] = []
        held = rows
        for c in np.flatnonzero(sizes).tolist():
            n = int(sizes[c])
            if held + n > rows or cells[-1] >= RUN_CELLS:
                held = 0
                first[c], parts[c] = len(cells), max(1, -(-n // rows))
                cells += [1] * int(parts[c])
            else:
                first[c], at[c] = len(cells) - 1, cells[-1]
                cells[-1] += 1
            held = rows if parts[c] > 1 else held + n
        return cls(first, parts, at, np.array(cells, np.int64))

    def visits(self, order: np.ndarray) -> pa.Array:
        """(run, cells) of each question: the runs that it visits, and a bit for each of their cells; -1 is no visit."""
        asking, place = np.nonzero((order >= 0) & (self.first[order] >= 0))
        cell = order[asking, place]
        often = self.parts[cell]
        asking, cell = np.repeat(asking, often), np.repeat(cell, often)
        part = np.arange(len(cell)) - np.repeat(np.cumsum(often) - often, often)
        met, at = np.unique(asking * len(self.cells) + self.first[cell] + part, return_inverse=True)
        asking, run = np.divmod(met, max(1, len(self.cells)))
        start = np.concatenate([[0], np.cumsum(-(-self.cells[run] // 8))])
        data = np.zeros(start[-1], np.uint8)
        np.bitwise_or.at(data, start[at] + (self.at[cell] >> 3), np.left_shift(1, self.at[cell] & 7).astype(np.uint8))
        bits = pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(data)])
        values = pa.StructArray.from_arrays([pa.array(run, pa.int32()), bits], ["run", "cells"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(asking, np.arange(len(order) + 1)), pa.int32()), values)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _cells_for(n: int) -> int:
    return max(1, min(CELLS_AT_MOST, math.isqrt(n)))


def _fit(kind: str, sample: DataFrame, cells: int, tables: int, metric: str, seed: int, max_iter: int) -> Centres | Hashes:
    if kind == "cells":
        data = settle(sample.withColumn("_vec", array_to_vector(F.col("embedding").cast("array<double>"))), "index-sample")
        model = KMeans(featuresCol="_vec", k=cells, seed=seed, maxIter=max_iter).fit(data) if cells > 1 else None
        centres = np.vstack(model.clusterCenters()) if model else vectors_of(data.limit(1).toPandas()["embedding"])
        return Centres(centres)
    # SAMPLE_PER_CELL rows a cell at most; the cuts need no more than a few thousand of them
    x = vectors_of(sample.orderBy("_h").limit(4096).toPandas()["embedding"])
    x = _unit(x) if metric == "cosine" else x
    m = min(x.shape[1], max(1, round(math.log2(max(2, cells)))))
    rng = np.random.default_rng(seed)
    directions = np.stack([np.linalg.qr(rng.normal(size=(x.shape[1], m)))[0].T for _ in range(tables)])
    return Hashes(directions, np.median(np.einsum("nd,tmd->ntm", x, directions), axis=0))


class VectorIndex:
    """An index in a folder: ``chunks`` (partitioned by cell), ``cells`` (how many chunks each has), ``model``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        row = spark.read.parquet(f"{path}/model").first()
        self.kind, self.metric, self.probes, self.n = row["kind"], row["metric"], row["probes"], row["n"]
        self.schema = T.StructType.fromJson(json.loads(row["schema"]))
        self.model: Centres | Hashes = pickle.loads(row["model"])
        self.sizes = np.zeros(self.model.cells, np.int64)
        # one row per cell
        for r in spark.read.parquet(f"{path}/cells").collect():
            self.sizes[r["cell"]] = r["n"]

    @classmethod
    def build(
        cls, chunks: DataFrame, path: str, kind: str = "cells", metric: str = "l2", *, cells: int | None = None, tables: int = 1, k: int = K,
        target: float = TARGET, questions: int = QUESTIONS, sample_per_cell: int = SAMPLE_PER_CELL, seed: int = 42, max_iter: int = 10,
        probes: int | None = None,
    ) -> VectorIndex:
        """Store ``chunks(chunk_id, embedding)`` by cell under ``path``, which must not exist yet; null vectors stay out.

        Centres or cuts are fitted on ``sample_per_cell`` rows per cell at most, chosen by a hash of chunk_id; every chunk is
        stored. ``questions`` stored vectors measure how many cells hold the share ``target`` of their ``k`` nearest others,
        unless ``probes`` says how many to visit. Cosine compares vectors scaled to length one.
        """
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        if metric not in ("l2", "cosine"):
            raise ValueError("the approximate indexes measure l2 or cosine")
        spark = chunks.sparkSession
        stored = settle(chunks.select("chunk_id", "embedding"), "index-input").where(F.col("embedding").isNotNull())
        n = stored.count()
        cells = min(_cells_for(n) if cells is None else cells, max(1, n))
        mark = F.pmod(F.xxhash64(F.lit(seed), "chunk_id"), F.lit(1 << 31)).alias("_h")
        share = min(1.0, sample_per_cell * cells / max(1, n))
        seen = stored.select("embedding", mark).where(F.col("_h") < int(share * (1 << 31)))
        if metric == "cosine" and kind == "cells":
            length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
            seen = seen.withColumn("embedding", F.transform("embedding", lambda v: F.when(length > 0, v / length).otherwise(0.0)))
        if seen.isEmpty():
            seen = stored.select("embedding", mark).limit(sample_per_cell * cells)
        model = _fit(kind, seen, cells, tables, metric, seed, max_iter) if n else Centres(np.zeros((1, 1)))
        shared = spark.sparkContext.broadcast((model, metric))

        @F.pandas_udf("array<struct<cell:bigint,far:double>>")
        def place(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            fitted, by = shared.value
            step, out = max(1, DISTANCES // max(1, fitted.cells)), []
            for i in range(0, len(vectors), step):
                x = vectors_of(vectors[i : i + step])
                x = _unit(x) if by == "cosine" else x
                at = fitted.place(x)
                far = np.linalg.norm(x - fitted.centres[at[:, 0]], axis=1)[:, None] if isinstance(fitted, Centres) else np.zeros(at.shape)
                out += [[{"cell": int(c), "far": float(f)} for c, f in zip(a, b)] for a, b in zip(at, far)]
            return pd.Series(out)

        placed = stored.withColumn("_p", F.explode(place("embedding"))).select("chunk_id", "embedding", F.col("_p.cell").alias("cell"), F.col("_p.far").alias("far"))
        placed.repartition("cell").write.partitionBy("cell").parquet(f"{path}/chunks")
        schema = T.StructType([*stored.schema.fields, T.StructField("far", T.DoubleType()), T.StructField("cell", T.LongType())])
        counts = spark.read.schema(schema).parquet(f"{path}/chunks").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("reach"))
        counts.write.parquet(f"{path}/cells")
        facts = spark.read.parquet(f"{path}/cells").collect()
        reach, used = np.full(model.cells, np.nan), np.zeros(model.cells, bool)
        for r in facts:
            reach[r["cell"]], used[r["cell"]] = r["reach"], True
        model = Centres(model.centres, reach) if isinstance(model, Centres) else Hashes(model.directions, model.cuts, used)

        def save(visits: int) -> VectorIndex:
            row = [(kind, metric, visits, n, schema.json(), pickle.dumps(model))]
            spark.createDataFrame(row, "kind string, metric string, probes int, n long, schema string, model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
            return cls(spark, path)

        if probes is not None or not n:
            return save(max(1, min(probes or 1, model.cells)))
        index = save(model.cells)
        asked = stored.select(F.col("chunk_id").alias("question_id"), "embedding", mark).orderBy("_h", "question_id").limit(questions).drop("_h")
        return save(index._needed(settle(asked, "index-questions"), stored, k, target))

    def _needed(self, asked: DataFrame, stored: DataFrame, k: int, target: float) -> int:
        """The least number of visited cells that hold the share ``target`` of the true neighbours of the sample."""
        truth = exact_top_k(asked, stored, k + 1, self.metric).where("question_id <> chunk_id")
        at = self.chunks().select("chunk_id", "cell").join(F.broadcast(truth), "chunk_id")
        # questions x (k + 1) rows
        found = at.groupBy("question_id", "chunk_id").agg(F.collect_set("cell").alias("cells")).toPandas()
        if not len(found):
            return 1
        rows = asked.toPandas()
        number = {q: i for i, q in enumerate(rows["question_id"])}
        order = self._visits(vectors_of(rows["embedding"]), prune=False)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :].repeat(len(order), axis=0), axis=1)
        ranks = np.sort([rank[number[q]][cells].min() for q, cells in zip(found["question_id"], found["cells"])])
        return int(ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)]) + 1

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/chunks")

    def _visits(self, x: np.ndarray, prune: bool = True, k: int = K, probes: int | None = None) -> np.ndarray:
        """Cells in the order of their visits, cut at ``probes``; with ``prune`` -1 for those that can hold none of the k nearest."""
        return _order(self.model, self.sizes, self.metric, x, self.probes if probes is None else probes, k) if prune else np.argsort(
            self.model.bounds(_unit(x) if self.metric == "cosine" else x)[0], axis=1, kind="stable")

    def search(self, questions: DataFrame, k: int = K, probes: int | None = None) -> DataFrame:
        """(question_id, rank, chunk_id, distance): the k nearest of the chunks in the visited cells.

        Only the folders of visited cells are read. A question that finds fewer than k chunks is answered exactly. Null
        questions get no row.
        """
        if k < 1:
            raise ValueError("k must be positive")
        if not self.n:
            return exact_top_k(questions, self.chunks().select("chunk_id", "embedding"), k, self.metric)
        visits = max(1, min(self.probes if probes is None else probes, self.model.cells))
        # vectors may be expensive columns
        questions = settle(questions.select("question_id", "embedding").where(F.col("embedding").isNotNull()), "questions")
        many, stored = questions.count(), int(self.sizes.sum())
        wanted = min(GROUPS_A_CORE * self.spark.sparkContext.defaultParallelism, 1 + many * stored // PAIRS)
        # a vector is copied least when questions and chunks are cut into pieces of like size
        cuts = max(1, round(math.sqrt(wanted * many / stored)))
        block = max(1, min(QUESTION_BLOCK, QUESTION_VALUES // max(1, self.model.width), -(-many // cuts)))
        rows = -(-stored * -(-many // block) // wanted)
        runs = Runs.of(self.sizes, max(LEAST_CHUNKS, min(CHUNK_BLOCK, rows)))
        asked = self._routed(questions, runs, k, visits)
        asking, cells = self._visited(asked, runs)
        blocks = F.broadcast(self.spark.createDataFrame([(r, -(-n // block)) for r, n in asking.items()], "run int, blocks int"))
        # one row per cell
        places = F.broadcast(self.spark.createDataFrame([(c, int(runs.first[c]), int(runs.parts[c]), int(runs.at[c])) for c in cells], "cell long, first int, parts int, at int"))
        left = asked.withColumn("visit", F.explode("visits")).select("question_id", "embedding", "visit.run", F.col("visit.cells").alias("visits"))
        left = left.join(blocks, "run").withColumn("block", F.pmod(F.xxhash64("question_id"), F.col("blocks")).cast("int"))
        right = self.read(cells).join(places, "cell").withColumn("run", F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"))
        right = right.join(blocks, "run").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = sum(asking.values()) * stored // len(runs.cells)
        tasks = min(sum(-(-n // block) for n in asking.values()) or 1, 4 * wanted, 1 + pairs // PAIRS)
        found = top_k_in_runs(left, right, k, self.metric, tasks)
        whole = self.chunks().select("chunk_id").distinct().limit(k).count()
        return completed(found, questions, self.chunks().select("chunk_id", "embedding").dropDuplicates(["chunk_id"]), k, self.metric, whole)

    def _routed(self, questions: DataFrame, runs: Runs, k: int, probes: int) -> DataFrame:
        """(question_id, embedding, visits), one row per question with the runs and cells that it visits."""
        shared = self.spark.sparkContext.broadcast((self.model, self.sizes, self.metric, probes, k, runs))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            *fitted, most, wanted, layout = shared.value
            # blocks bound the matrix of questions and cells
            step = max(1, DISTANCES // max(1, fitted[0].cells))
            for b in batches:
                x = matrix_of(b.column("embedding"))
                for i in range(0, len(x), step):
                    part = b.slice(i, step)
                    columns = [part.column("question_id"), part.column("embedding"), layout.visits(_order(*fitted, x[i : i + step], most, wanted))]
                    yield pa.RecordBatch.from_arrays(columns, ["question_id", "embedding", "visits"])

        visits = T.ArrayType(T.StructType([T.StructField("run", T.IntegerType()), T.StructField("cells", T.BinaryType())]))
        schema = T.StructType([questions.schema["question_id"], questions.schema["embedding"], T.StructField("visits", visits)])
        return settle(questions.mapInArrow(route, schema), "visits")

    def _visited(self, asked: DataFrame, runs: Runs) -> tuple[dict[int, int], list[int]]:
        """How many questions visit each run, and the cells that any of them visits."""

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count: dict[int, int] = {}
            seen: dict[int, np.ndarray] = {}
            for b in batches:
                run, n = b.column("run").to_numpy(), b.column("n").to_numpy()
                for r in np.unique(run).tolist():
                    count[r] = count.get(r, 0) + int(n[run == r].sum())
                    bits = np.bitwise_or.reduce(bits_of(b.column("cells").filter(pa.array(run == r))), axis=0)
                    seen[r] = seen[r] | bits if r in seen else bits
            if count:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(count), pa.int32()), pa.array(count.values(), pa.int64()), pa.array([s.tobytes() for s in seen.values()], pa.binary())], ["run", "n", "cells"])

        each = asked.select(F.explode("visits").alias("visit")).select("visit.run", F.lit(1).cast("long").alias("n"), "visit.cells")
        kinds = "run int, n long, cells binary"
        # one row per run
        rows = each.mapInArrow(tally, kinds).repartition("run").mapInArrow(tally, kinds).collect()
        bits = {r["run"]: int.from_bytes(r["cells"], "little") for r in rows}
        cells = [c for c in np.flatnonzero(runs.first >= 0).tolist() if bits.get(int(runs.first[c]), 0) >> int(runs.at[c]) & 1]
        return {r["run"]: r["n"] for r in rows}, cells

    def visits(self, questions: DataFrame, k: int = K, probes: int | None = None) -> DataFrame:
        """(question_id, embedding, cell), one row per visit."""
        model, sizes, metric = self.model, self.sizes, self.metric
        shared = self.spark.sparkContext.broadcast((model, sizes, metric, self.probes if probes is None else probes, k))

        @F.pandas_udf("array<bigint>")
        def near_cells(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            *fitted, visits, wanted = shared.value
            # blocks bound the matrix of questions and cells
            step = max(1, DISTANCES // max(1, fitted[0].cells))
            rows = [r[r >= 0] for i in range(0, len(vectors), step) for r in _order(*fitted, vectors_of(vectors[i : i + step]), visits, wanted)]
            return pd.Series(rows)

        asked = questions.select("question_id", "embedding").where(F.col("embedding").isNotNull())
        return settle(asked.withColumn("cell", F.explode(near_cells("embedding"))), "visits")

    def read(self, cells: list[int]) -> DataFrame:
        """(chunk_id, embedding, cell) of some cells; the folders of all others stay unread."""
        return self.chunks().where(F.col("cell").isin([int(c) for c in cells])).select("chunk_id", "embedding", "cell")


def _order(model: Centres | Hashes, sizes: np.ndarray, metric: str, x: np.ndarray, probes: int, k: int) -> np.ndarray:
    """The first ``probes`` cells of each question; -1 where a nearer cell is sure to hold k nearer chunks.

    A cell with k chunks, all of which are within some distance, makes cells that begin beyond it useless. Buckets have no
    known reach and rule nothing out.
    """
    x = _unit(x) if metric == "cosine" else x
    far, least = model.bounds(x)
    order = np.argsort(far, axis=1, kind="stable")[:, :probes]
    if isinstance(model, Centres):
        full = np.where((sizes >= k) & ~np.isnan(model.reach), model.reach, np.inf)
        sure = (far + full[None, :]).min(axis=1)
        # rounding must not rule out a cell on the border
        drop = np.take_along_axis(least, order, axis=1) > sure[:, None] * (1 + 1e-9)
        drop |= sizes[order] == 0
        order = np.where(drop, -1, order)
    return order



def cell_top_k(questions: DataFrame, chunks: DataFrame, k: int = K, metric: str = "l2", *, cells: int | None = None, probes: int | None = None, seed: int = 42) -> DataFrame:
    """Approximate k nearest by coarse cells, through an index in the scratch folder.

    Without ``probes`` as many cells are visited as the sample needs; with as many as there are cells the result is exact.
    """
    path = scratch_path(chunks.sparkSession, "cells")
    return VectorIndex.build(chunks, path, "cells", metric, cells=cells, probes=probes, k=k, seed=seed).search(questions, k)


def hashed_top_k(questions: DataFrame, chunks: DataFrame, k: int = K, metric: str = "l2", *, tables: int = 1, probes: int | None = None, seed: int = 42) -> DataFrame:
    """Approximate k nearest by hashed buckets, through an index in the scratch folder; see ``cell_top_k``."""
    path = scratch_path(chunks.sparkSession, "hashes")
    return VectorIndex.build(chunks, path, "hashes", metric, tables=tables, probes=probes, k=k, seed=seed).search(questions, k)
