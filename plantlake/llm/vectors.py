"""Vectors of a table: the usable ones, with equal vectors as one class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantlake.llm.common import once


def usable(vector: Column) -> Column:
    """Whether a vector has no null or non-finite component and is neither null nor zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(wide, finite) & F.exists(wide, lambda x: x != 0.0), F.lit(False))


def vector_classes(vectors: DataFrame, members: int) -> DataFrame:
    """(cid, vec, n, ids): one row per different usable vector, how many rows have it, and its smallest vec_ids.

    Rows that share a vector, however many, are added up before the shuffle; at most ``members`` ids of them are kept.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where(usable(F.col("embedding")))
    per = rows.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    if members == 1:
        found = per.select("vec", "n", F.array("first").alias("ids"))
    else:
        # vectors that one row has need no second look
        many = per.where("n > 1").select("vec")
        smallest = rows.where("vec_id is not null").join(many, "vec", "left_semi").select("vec", "vec_id", F.lit(0).alias("_one"))
        ranked = smallest.groupBy("vec").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, members).alias("ids"))
        found = per.join(ranked, "vec", "left").select("vec", "n", F.coalesce("ids", F.array_compact(F.array("first"))).alias("ids"))
    return once(found.select(F.monotonically_increasing_id().alias("cid"), "vec", "n", "ids"), "vectors")


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of an Arrow list column of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)
