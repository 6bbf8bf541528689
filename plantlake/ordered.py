"""Ordered work over series of any length.

A window over one whole series is one task. While the longest series is short that is the best plan: one
shuffle by series. Beyond a measured length the rows are range partitioned by (series, order), so
that every chunk holds about the same number of rows however heavy a series is. Windows then run inside
(series, chunk), and a small table with one row per (series, chunk) carries the state over the borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plantlake.joins import BROADCAST_BYTES
from plantlake.session import settle, settle_sized

CHUNK = "_chunk"
ROW = "_row"
# rows of one series that a single task may sort
WINDOW_ROWS = 2_000_000
# rows of one chunk
CHUNK_ROWS = 10_000_000
# for a caller that has measured the length already
UNLIMITED = 2**62


def window_plan(df: DataFrame, keys: Sequence[str], window_rows: int = WINDOW_ROWS) -> tuple[bool, int | None]:
    """(short, chunks): whether every series fits one window, else how many chunks the rows need.

    One counting pass over the key columns.
    """
    if window_rows <= 0 or window_rows >= UNLIMITED:
        return window_rows > 0, None
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    longest, total = per.agg(F.max("_n"), F.sum("_n")).first()
    return (longest or 0) <= window_rows, chunks_for(df, total or 0)


def chunks_for(df: DataFrame, rows: int) -> int:
    """As many chunks as shuffle partitions, more when a chunk would get too long."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // CHUNK_ROWS))


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None) -> DataFrame:
    """Rows in (keys, order), cut into even chunks numbered in that order.

    ``order`` should identify a row within its series; rows equal in it stay together in one chunk.
    Rows without a series key belong to no series and are left out.
    """
    n = chunks or chunks_for(df, 0)
    by = [*keys, *order]
    rows = df.dropna(subset=list(keys)) if keys else df
    marked = (
        rows.repartitionByRange(n, *by)
        .sortWithinPartitions(*by)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn(CHUNK, F.shiftright("_mid", 33).cast("int"))
        .withColumn(ROW, F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )
    return settle(marked, "chunks")


def join_chunks(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one carry row per (keys, chunk); a (keys, chunk) group is bounded by the chunk size."""
    on = [*keys, CHUNK]
    carry, size = settle_sized(carry, "carry")
    right = F.broadcast(carry) if size <= BROADCAST_BYTES else carry
    return df.join(right, on, "left")


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], pos: str = "pos", total: str | None = None,
    window_rows: int = WINDOW_ROWS, chunks: int | None = None,
) -> DataFrame:
    """0-based position of each row in its series, and optionally the series' row count."""
    keys = list(keys)
    short, needed = window_plan(df, keys, window_rows)
    if short:
        rows = df.dropna(subset=keys) if keys else df
        series = W.partitionBy(*keys)
        numbered = rows.withColumn(pos, (F.row_number().over(series.orderBy(*order)) - 1).cast("long"))
        return numbered.withColumn(total, F.count(F.lit(1)).over(series)) if total else numbered
    cut = ordered_chunks(df, keys, order, chunks or needed)
    per = cut.groupBy(*keys, CHUNK).agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = per.select(
        *keys,
        CHUNK,
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        *([F.sum("_n").over(W.partitionBy(*keys)).alias(total)] if total else []),
    )
    joined = join_chunks(cut, carry, keys)
    return joined.withColumn(pos, (F.col(ROW) + F.col("_shift")).cast("long")).drop(CHUNK, ROW, "_shift")


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, name: str, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Inclusive running sum of ``weight`` along each series."""
    keys = list(keys)
    short, needed = window_plan(df, keys, window_rows)
    if short:
        rows = df.dropna(subset=keys) if keys else df
        return rows.withColumn(name, F.sum(weight).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    chunks = ordered_chunks(df.withColumn("_w", weight), keys, order, needed)
    per = chunks.groupBy(*keys, CHUNK).agg(F.sum("_w").alias("_s"))
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = per.select(*keys, CHUNK, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    local = W.partitionBy(*keys, CHUNK).orderBy(ROW).rowsBetween(W.unboundedPreceding, 0)
    summed = chunks.withColumn("_local", F.sum("_w").over(local))
    return (
        join_chunks(summed, carry, keys)
        .withColumn(name, F.col("_local") + F.col("_base"))
        .drop(CHUNK, ROW, "_w", "_local", "_base")
    )


def last_before(
    causes: DataFrame, effects: DataFrame, keys: Sequence[str], cause_time: str, effect_time: str,
    cause_id: str, effect_id: str, window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """For each effect the latest cause of the same keys with ``cause_time <= effect_time``.

    One sorted pass over both tables together: no pair is built. Equal cause times go to the largest id.
    Returns (keys, effect id, effect time, cause id, cause time) with nulls where no cause precedes.
    """
    keys = list(keys)
    rows = causes.select(
        *keys, F.col(cause_time).alias("_t"), F.lit(0).alias("_kind"), F.col(cause_id).alias("_cid"),
        F.lit(None).cast(effects.schema[effect_id].dataType).alias("_eid"),
    ).unionByName(
        effects.select(
            *keys, F.col(effect_time).alias("_t"), F.lit(1).alias("_kind"),
            F.lit(None).cast(causes.schema[cause_id].dataType).alias("_cid"), F.col(effect_id).alias("_eid"),
        )
    )
    rows = rows.where(F.col("_t").isNotNull()).dropna(subset=keys)
    order = ["_t", "_kind", "_cid", "_eid"]
    cause = F.when(F.col("_kind") == 0, F.struct(F.col("_t").alias("t"), F.col("_cid").alias("id")))

    def shape(found: DataFrame, best: Column) -> DataFrame:
        return found.select(
            *keys, F.col("_eid").alias(effect_id), F.col("_t").alias(effect_time),
            best["id"].alias(cause_id), best["t"].alias(cause_time),
        )

    short, needed = window_plan(rows, keys, window_rows)
    if short:
        upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        latest = rows.withColumn("_best", F.last(cause, ignorenulls=True).over(upto))
        return shape(latest.where(F.col("_kind") == 1), F.col("_best"))
    chunks = ordered_chunks(rows, keys, order, needed)
    per = chunks.groupBy(*keys, CHUNK).agg(F.max(cause).alias("_last"))
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = per.select(*keys, CHUNK, F.max("_last").over(before).alias("_carry"))
    local = W.partitionBy(*keys, CHUNK).orderBy(ROW).rowsBetween(W.unboundedPreceding, 0)
    found = chunks.withColumn("_local", F.last(cause, ignorenulls=True).over(local)).where(F.col("_kind") == 1)
    return shape(join_chunks(found, carry, keys), F.coalesce("_local", "_carry"))
