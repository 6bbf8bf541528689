"""Nearest chunks for a whole table of question vectors: exact, or within cells that were chosen before.

No (question, chunk) pair ever becomes a row. Vectors meet in blocks of bounded size, each block keeps
only its best k per question, and a window over those few rows gives the final rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from plantlake.joins import BROADCAST_BYTES, join_sized
from plantlake.session import settle

METRICS = ("l2", "cosine", "dot")
K = 3
# questions that a task holds, and chunks of a group, which a task reads one batch after the other
QUESTION_BLOCK = 65_536
CHUNK_BLOCK = 262_144
# a crowded cell is cut until there are about so many groups for each core, but not below so many chunks
GROUPS_A_CORE = 6
LEAST_CHUNKS = 4_096
# pairs that are worth a task
PAIRS = 5_000_000
# questions and chunks compared at once inside a block, which bounds the matrix of distances
STEP = 1_024
PIECE = 2_048
# relative width within which block scores in double precision are taken as possibly equal and compared again directly
NEAR = 1e-9
# values of a vector that are compared directly at a time, and pairs found before they are ranked
VALUES = 1 << 20
HELD = 1 << 18
# share of the pairs of a piece that single precision may leave to compare directly
LOOSE = 0.02
# larger values are not squared in single precision
LARGE = 1e15
# rows of a cell that are compared at once
CELL_ROWS = 4_096


def _check(metric: str, k: int) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be positive")


def _direct(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of questions and vectors, row by row; smaller is nearer. Twelve digits, so equal is equal."""
    if metric == "l2":
        d = ((x - q) ** 2).sum(axis=1)
    elif metric == "dot":
        d = -(x * q).sum(axis=1)
    else:
        scale = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1))
        d = 1.0 - np.divide((x * q).sum(axis=1), scale, out=np.zeros(len(x)), where=scale > 0)
    return np.round(d, 12)


def _sides(q: np.ndarray, metric: str, single: bool, chunks: bool) -> np.ndarray:
    """Vectors with one more column, so that the product of both sides gives distances without the part of the question alone.

    The column of the chunks is lowered by their share of the rounding of the product; ``_cut`` allows for that of the questions.
    """
    eps = _rounding(q.shape[1], single)
    if metric == "cosine":
        size = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, size, out=np.zeros_like(q), where=size > 0)
    square = np.einsum("nd,nd->n", q, q)
    if not chunks:
        left, right = (-2.0 if metric == "l2" else -1.0) * q, np.ones(len(q))
    else:
        left, right = q, square * (1.0 - eps) if metric == "l2" else -eps * square
    return np.hstack([left, right[:, None]]).astype(np.float32 if single else np.float64)


def _rounding(width: int, single: bool) -> float:
    """Bound of the rounding of a product of two vectors, relative to half the sum of their squares, with those of its parts."""
    return 2.0 * (width + 8) * (2.0**-24 if single else 2.0**-53)


class Leaders:
    """The ``k`` nearest chunks of every question of a block; chunks come in batches, and a batch is not kept.

    Most pairs are ruled out by one matrix product in single precision and the distance of the k-th nearest chunk so far. What
    is within its rounding is compared directly in double precision, so results do not depend on it.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str) -> None:
        self.q, self.k, self.metric = q, k, metric
        self.square = np.einsum("nd,nd->n", q, q)
        # distance of the k-th nearest so far
        self.limit = np.full(len(q), np.inf)
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.small = bool((np.abs(q) <= LARGE).all())
        self.left = _sides(q, metric, True, False) if self.small else None

    def add(self, cid: np.ndarray, x: np.ndarray) -> None:
        cid, x = _of_copies(cid, x, self.k)
        if not len(cid):
            return
        single = self.small and bool((np.abs(x) <= LARGE).all())
        right = _sides(x, self.metric, single, True)
        for s in range(0, len(self.q), STEP):
            self._step(s, cid, x, right, single)

    def _cut(self, rows: slice | np.ndarray, single: bool, limit: np.ndarray | None = None) -> np.ndarray:
        """Products above this belong to chunks that are farther away than the limit, or else the k-th nearest so far."""
        limit, eps = self.limit[rows] if limit is None else limit, _rounding(self.q.shape[1], single)
        own = 1.0 - eps if self.metric == "cosine" else self.square[rows] * ((1.0 - eps) if self.metric == "l2" else -eps)
        cut = limit - own + NEAR * np.abs(limit) + 1e-11
        return np.nextafter(cut.astype(np.float32), np.float32(np.inf)) if single else cut

    def _step(self, s: int, cid: np.ndarray, x: np.ndarray, right: np.ndarray, single: bool) -> None:
        rows = slice(s, s + STEP)
        q = self.q[rows]
        left = self.left[rows] if single else _sides(q, self.metric, False, False)
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for p in range(0, len(x), PIECE):
            piece = x[p : p + PIECE]
            rough = left @ right[p : p + PIECE].T
            if len(piece) >= self.k and np.isinf(self.limit[rows]).any():
                self.limit[rows] = np.minimum(self.limit[rows], self._first_limit(q, piece, rough))
            flat = np.flatnonzero(rough <= self._cut(rows, single)[:, None])
            if single and len(flat) > LOOSE * rough.size + self.k * len(q):
                rough = _sides(q, self.metric, False, False) @ _sides(piece, self.metric, False, True).T
                flat = np.flatnonzero(rough <= self._cut(rows, False)[:, None])
            for at, near, d in self._measured(flat, q, piece):
                good = d <= self.limit[rows][at]
                new.append((at[good], cid[p + near[good]], d[good]))
                held += len(new[-1][0])
                if held > HELD:
                    self._rank(s, new)
                    new, held = [], 0
        if held:
            self._rank(s, new)

    def _measured(self, flat: np.ndarray, q: np.ndarray, piece: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        pairs = max(1, VALUES // max(1, q.shape[1]))
        for i in range(0, len(flat), pairs):
            at, near = np.divmod(flat[i : i + pairs], len(piece))
            yield at, near, _direct(q[at], piece[near], self.metric)

    def _first_limit(self, q: np.ndarray, piece: np.ndarray, rough: np.ndarray) -> np.ndarray:
        """Any k chunks bound the distance of the k-th nearest; those with the smallest products bound it well."""
        some = np.argpartition(rough, self.k - 1, axis=1)[:, : self.k]
        flat = (np.arange(len(q))[:, None] * len(piece) + some).ravel()
        far = np.concatenate([d for _, _, d in self._measured(flat, q, piece)]).reshape(some.shape).max(axis=1)
        return np.where(np.isnan(far), np.inf, far)

    def _rank(self, s: int, new: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Keep the k nearest of each question; equal distances go to the smaller id."""
        before = [self.found[s]] if s in self.found else []
        at, cid, d = (np.concatenate(c) for c in zip(*before, *new, strict=True))
        order = np.lexsort((cid, d, at))
        at, cid, d = at[order], cid[order], d[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        best = rank < self.k
        self.found[s] = at[best], cid[best], d[best]
        last = rank == self.k - 1
        self.limit[s + at[last]] = np.minimum(self.limit[s + at[last]], d[last])

    def rows(self, qid: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(question_id, chunk_id, distance), one batch for each step of the questions."""
        for s, (at, cid, d) in sorted(self.found.items()):
            columns = [qid.take(pa.array(s + at)), pa.array(cid, kind, from_pandas=True), pa.array(d, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["question_id", "chunk_id", "distance"])


class CellLeaders(Leaders):
    """The ``k`` nearest chunks of every question of a block among the cells that it visits; cells come one after the other.

    ``visits`` has one bit per cell for each question. The k-th distance so far holds for all later cells. Of each cell a
    question takes its k nearest rows at most, and keeps a chunk that it meets again once.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str, visits: np.ndarray) -> None:
        super().__init__(q, k, metric)
        # one row per eight cells
        self.visits = np.ascontiguousarray(visits.T)
        self.near, self.ids, self.held = np.full((len(q), k), np.inf), None, np.zeros(len(q), np.int64)

    def add_cell(self, cell: int, cid: np.ndarray, x: np.ndarray) -> None:
        asking = np.flatnonzero(self.visits[cell >> 3] >> (cell & 7) & 1)
        cid, x = _of_copies(cid, x, self.k)
        if not len(asking) or not len(cid):
            return
        single = self.small and bool((np.abs(x) <= LARGE).all())
        right = _sides(x, self.metric, single, True)
        for s in range(0, len(asking), STEP):
            self._meet(asking[s : s + STEP], cid, x, right, single)

    def _meet(self, rows: np.ndarray, cid: np.ndarray, x: np.ndarray, right: np.ndarray, single: bool) -> None:
        q = self.q[rows]
        rough = (self.left[rows] if single else _sides(q, self.metric, False, False)) @ right.T
        limit = self.limit[rows]
        if len(x) >= self.k and np.isinf(limit).any():
            # rows of one cell bound what is taken of it, but a chunk may be among them twice
            limit = np.minimum(limit, self._first_limit(q, x, rough))
        flat = np.flatnonzero(rough <= self._cut(rows, single, limit)[:, None])
        if single and len(flat) > LOOSE * rough.size + self.k * len(q):
            rough = _sides(q, self.metric, False, False) @ _sides(x, self.metric, False, True).T
            flat = np.flatnonzero(rough <= self._cut(rows, False, limit)[:, None])
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at, near, d in self._measured(flat, q, x):
            good = d <= limit[at]
            new.append((at[good], near[good], d[good]))
            if sum(len(a) for a, _, _ in new) > HELD:
                new = [self._of_cell(new, cid)]
        if any(len(a) for a, _, _ in new):
            at, near, d = self._of_cell(new, cid)
            self._keep(rows[at], cid[near], d)

    def _of_cell(self, new: list[tuple[np.ndarray, np.ndarray, np.ndarray]], cid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest rows of one cell for each question."""
        at, near, d = (np.concatenate(c) for c in zip(*new, strict=True))
        order = np.lexsort((cid[near], d, at))
        order = order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < self.k]
        return at[order], near[order], d[order]

    def _keep(self, rows: np.ndarray, cid: np.ndarray, d: np.ndarray) -> None:
        """Put what a cell gave among the k nearest different chunks so far; equal distances go to the smaller id."""
        if self.ids is None:
            self.ids = np.zeros(self.near.shape, cid.dtype)
        elif self.ids.dtype != cid.dtype:
            self.ids = self.ids.astype(np.result_type(self.ids, cid))
        asking, at = np.unique(rows, return_inverse=True)
        before, place = np.nonzero(np.arange(self.k) < self.held[asking][:, None])
        at = np.concatenate([before, at])
        cid = np.concatenate([self.ids[asking[before], place], cid])
        d = np.concatenate([self.near[asking[before], place], d])
        order = np.lexsort((d, cid, at))
        at, cid, d = at[order], cid[order], d[order]
        # an id that is null has become NaN
        again = (at[1:] == at[:-1]) & ((cid[1:] == cid[:-1]) | ((cid[1:] != cid[1:]) & (cid[:-1] != cid[:-1])))
        first = np.concatenate([[True], ~again])
        at, cid, d = at[first], cid[first], d[first]
        order = np.lexsort((cid, d, at))
        at, cid, d = at[order], cid[order], d[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        best = rank < self.k
        at, cid, d, rank = at[best], cid[best], d[best], rank[best]
        self.ids[asking[at], rank], self.near[asking[at], rank] = cid, d
        self.held[asking] = np.bincount(at, minlength=len(asking))
        full = asking[at[rank == self.k - 1]]
        self.limit[full] = self.near[full, self.k - 1]

    def rows(self, qid: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(self.q), STEP):
            at, place = np.nonzero(np.arange(self.k) < self.held[s : s + STEP, None])
            if len(at):
                columns = [qid.take(pa.array(s + at)), pa.array(self.ids[s + at, place], kind, from_pandas=True), pa.array(self.near[s + at, place], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["question_id", "chunk_id", "distance"])


def _of_copies(cid: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors those with the ``k`` smallest ids: no other can be among the k nearest."""
    if len(x) <= k or not x.shape[1]:
        return cid, x
    _, group, counts = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True, return_counts=True)
    if counts.max() <= k:
        return cid, x
    order = np.lexsort((cid, group))
    kept = np.sort(order[np.arange(len(order)) - np.searchsorted(group[order], group[order]) < k])
    return cid[kept], x[kept]


def matrix_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows in double precision, without an object for each."""
    if not len(column):
        return np.zeros((0, 0))
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (widths != widths[0]).any():
        raise ValueError("vectors must have one length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), int(widths[0]))


def ids_of(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def vectors_of(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


def _schema(questions: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("question_id", questions.schema["question_id"].dataType),
        T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
        T.StructField("distance", T.DoubleType()),
    ])


def rank_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """(question_id, rank, chunk_id, distance), rank 1 is the nearest."""
    w = W.partitionBy("question_id").orderBy("distance", "chunk_id")
    ranked = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("question_id", "rank", "chunk_id", "distance")


def exact_top_k(
    questions: DataFrame, chunks: DataFrame, k: int = K, metric: str = "l2", *, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Exact k nearest chunks. ``questions(question_id, embedding)``, ``chunks(chunk_id, embedding)``.

    Few questions travel to the chunks and no chunk is shuffled; many questions meet them block by block.
    """
    _check(metric, k)
    asked = settle(questions.select("question_id", "embedding").where(F.col("embedding").isNotNull()), "questions")
    stored = chunks.select("chunk_id", "embedding")
    size = asked.agg(F.sum(8 * F.size("embedding") + 16)).first()[0] or 0
    if size > max_bytes:
        everything = F.lit(0).cast("long").alias("cell")
        # a vector may be an expensive column, so it is worked out once and only then looked at
        kept = settle(stored, "chunks").where(F.col("embedding").isNotNull())
        return top_k_in_cells(asked.select("*", everything), kept.select("*", everything), k, metric)
    table = asked.where(F.col("question_id").isNotNull()).toArrow().combine_chunks()
    if not table.num_rows:
        return questions.sparkSession.createDataFrame([], _ranked_schema(questions, chunks))
    ids, vectors = (pa.concat_arrays(table.column(c).chunks) for c in ("question_id", "embedding"))
    shared = asked.sparkSession.sparkContext.broadcast((ids, matrix_of(vectors)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        best, kind = None, None
        for b in batches:
            # a filter in front of the scan would work out a computed vector a second time
            b = b.filter(b.column("embedding").is_valid())
            if b.num_rows:
                best, kind = best or Leaders(q, k, metric), b.column("chunk_id").type
                best.add(ids_of(b.column("chunk_id")), matrix_of(b.column("embedding")))
        if best is not None:
            yield from best.rows(qid, kind)

    return rank_candidates(stored.mapInArrow(nearest, _schema(questions, chunks)), k)


def _ranked_schema(questions: DataFrame, chunks: DataFrame) -> T.StructType:
    q, c, d = _schema(questions, chunks).fields
    return T.StructType([q, T.StructField("rank", T.IntegerType()), c, d])


def top_k_in_cells(
    questions: DataFrame, chunks: DataFrame, k: int = K, metric: str = "l2", *,
    question_block: int = QUESTION_BLOCK, chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """k nearest among the chunks that share a ``cell`` with the question.

    A crowded cell is cut into question blocks and chunk blocks. Each pair of blocks is one group: a task holds its
    questions, whose number is bounded, and reads its chunks batch by batch behind them, so no group is held whole.
    """
    _check(metric, k)
    q_parts = questions.groupBy("cell").agg(F.count(F.lit(1)).alias("_m"), (F.floor(F.count(F.lit(1)) / question_block) + 1).alias("_qp"))
    c_parts = chunks.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), (F.floor(F.count(F.lit(1)) / chunk_block) + 1).alias("_cp"))
    parts = settle(q_parts.join(c_parts, "cell"), "cells")
    wanted = GROUPS_A_CORE * questions.sparkSession.sparkContext.defaultParallelism
    groups = F.sum(F.col("_qp") * F.col("_cp"))
    before = parts.agg(groups.alias("groups"), F.sum(F.col("_m").cast("double") * F.col("_n")).alias("pairs")).first()
    more = -(-wanted // max(1, before["groups"] or 0))
    finer = F.least(F.col("_cp") * more, F.floor(F.col("_n") / LEAST_CHUNKS) + 1)
    parts = parts.select("cell", "_qp", F.greatest("_cp", finer).alias("_cp"))
    tasks = min(parts.agg(groups).first()[0] or 1, 4 * wanted, 1 + int((before["pairs"] or 0) // PAIRS))

    def numbers(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    schema = _schema(questions, chunks)
    same = questions.schema["embedding"].dataType == chunks.schema["embedding"].dataType
    vector = F.col("embedding") if same else F.col("embedding").cast("array<double>")
    left = join_sized(questions, parts, ["cell"], "inner").select(
        "cell", F.pmod(F.xxhash64("question_id"), F.col("_qp")).alias("_qb"), numbers("_cp").alias("_cb"), F.lit(0).alias("_side"),
        "question_id", F.lit(None).cast(schema["chunk_id"].dataType).alias("chunk_id"), vector.alias("embedding"),
    )
    right = join_sized(chunks, parts, ["cell"], "inner").select(
        "cell", numbers("_qp").alias("_qb"), F.pmod(F.xxhash64("chunk_id"), F.col("_cp")).alias("_cb"), F.lit(1).alias("_side"),
        F.lit(None).cast(schema["question_id"].dataType).alias("question_id"), "chunk_id", vector.alias("embedding"),
    )
    order = ["_cb", "_qb", "cell"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, best, kind = None, [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = [ids_of(b.column(c)) for c in (*order, "_side")]
            kind = b.column("chunk_id").type
            turns = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
            for i, j in zip([0, *turns.tolist()], [*turns.tolist(), b.num_rows], strict=True):
                *group, side = (c[i] for c in keys)
                if group != now:
                    if best is not None:
                        yield from best[1].rows(best[0], kind)
                    now, asked, best = group, [], None
                part = b.slice(i, j - i)
                if side == 0:
                    asked.append((part.column("question_id"), matrix_of(part.column("embedding"))))
                elif asked:
                    if best is None:
                        best = pa.concat_arrays([a for a, _ in asked]), Leaders(np.vstack([v for _, v in asked]), k, metric)
                    best[1].add(ids_of(part.column("chunk_id")), matrix_of(part.column("embedding")))
        if best is not None:
            yield from best[1].rows(best[0], kind)

    met = left.unionByName(right).repartition(tasks, *order).sortWithinPartitions(*order, "_side")
    found = met.mapInArrow(nearest, schema)
    # a chunk can be met in several cells of the same question
    return rank_candidates(found.groupBy("question_id", "chunk_id").agg(F.min("distance").alias("distance")), k)


def bits_of(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def top_k_in_runs(asked: DataFrame, chunks: DataFrame, k: int, metric: str, tasks: int) -> DataFrame:
    """k nearest among the chunks of the cells that a question visits, where a task compares a block of questions and a run of cells.

    ``asked(question_id, embedding, run, block, visits)`` has one row per question and run with a visited cell, and a bit in
    ``visits`` for each cell of the run. ``chunks(chunk_id, embedding, run, block, at)`` says which of these cells a chunk is in.
    A vector travels once per run or block, however many cells are visited.
    """
    _check(metric, k)
    schema = _schema(asked, chunks)
    same = asked.schema["embedding"].dataType == chunks.schema["embedding"].dataType
    vector = F.col("embedding") if same else F.col("embedding").cast("array<double>")
    left = asked.select(
        "run", "block", F.lit(-1).alias("at"), "question_id", F.lit(None).cast(schema["chunk_id"].dataType).alias("chunk_id"), vector.alias("embedding"), "visits")
    right = chunks.select(
        "run", "block", "at", F.lit(None).cast(schema["question_id"].dataType).alias("question_id"), "chunk_id", vector.alias("embedding"), F.lit(None).cast("binary").alias("visits"))
    order = ["run", "block", "at"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, best, kind = None, [], None, None
        # rows of the cell that is being read
        cell, ids, vectors = -1, [], []

        def meet(whole: bool) -> None:
            nonlocal ids, vectors
            while sum(map(len, ids)) >= (1 if whole else CELL_ROWS):
                cid, x = np.concatenate(ids), np.vstack(vectors)
                best[1].add_cell(cell, cid[:CELL_ROWS], x[:CELL_ROWS])
                ids, vectors = [cid[CELL_ROWS:]], [x[CELL_ROWS:]]
            if whole:
                ids, vectors = [], []

        for b in batches:
            if not b.num_rows:
                continue
            keys = [ids_of(b.column(c)) for c in order]
            kind = b.column("chunk_id").type
            x = matrix_of(b.column("embedding"))
            turns = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
            for i, j in zip([0, *turns.tolist()], [*turns.tolist(), b.num_rows], strict=True):
                *group, at = (c[i] for c in keys)
                if group != now or at != cell:
                    meet(True)
                    cell = at
                if group != now:
                    if best is not None:
                        yield from best[1].rows(best[0], kind)
                    now, asked, best = group, [], None
                part = b.slice(i, j - i)
                if at < 0:
                    asked.append((part.column("question_id"), x[i:j], bits_of(part.column("visits"))))
                elif asked:
                    if best is None:
                        best = pa.concat_arrays([a for a, _, _ in asked]), CellLeaders(np.vstack([v for _, v, _ in asked]), k, metric, np.vstack([v for _, _, v in asked]))
                        # the leaders hold them now
                        asked = [None]
                    ids.append(ids_of(part.column("chunk_id")))
                    vectors.append(x[i:j])
                    meet(False)
        meet(True)
        if best is not None:
            yield from best[1].rows(best[0], kind)

    # rows of a cell by id, so that its pieces are the same whenever they are read
    met = left.unionByName(right).repartition(tasks, "run", "block").sortWithinPartitions(*order, "chunk_id")
    found = met.mapInArrow(nearest, schema)
    # a chunk can be met in several runs of the same question; what is dealt by question is not dealt again to be ranked
    return rank_candidates(found.repartition("question_id").groupBy("question_id", "chunk_id").agg(F.min("distance").alias("distance")), k)


def completed(found: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, metric: str = "l2", whole: int | None = None) -> DataFrame:
    """``found`` with the questions that are short of k chunks answered by exact search; ``whole`` chunks, up to k, are there at all."""
    found = settle(found, "found")
    whole = min(k, chunks.where(F.col("embedding").isNotNull()).limit(k).count()) if whole is None else whole
    enough = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= whole).select("question_id")
    short = settle(questions.where(F.col("embedding").isNotNull()).join(enough, "question_id", "left_anti").select("question_id", "embedding"), "short")
    if short.isEmpty():
        return found
    return found.join(short.select("question_id"), "question_id", "left_anti").unionByName(exact_top_k(short, chunks, k, metric))
