"""Calendar resampling with empty buckets kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plantlake.functions.calendar import parse_rule
from plantlake.functions.columns import number, numeric_columns
from plantlake.joins import join_sized
from plantlake.session import settle

# buckets made per generated block; a block is the unit of work when a grid is laid out
BLOCK = 4096


def resample_mean(
    df: DataFrame, ts: str, rule: str = "D", columns: Sequence[str] | None = None, *,
    series_cols: Sequence[str] = (), fill: bool = True, max_buckets: int | None = None,
) -> DataFrame:
    """Mean of each numeric column per calendar bucket and series.

    Every bucket between the first and the last of a series is returned; without a value it is null. The input is read once,
    by rules whose buckets start at the first row of a series twice.
    ``max_buckets`` lets a caller refuse series longer than that; by default there is no limit.
    """
    r = parse_rule(rule)
    series = list(series_cols)
    columns = numeric_columns(df, columns, skip=[ts, *series])
    if not columns:
        raise ValueError("no numeric columns to aggregate")
    rows = df.where(F.col(ts).isNotNull())
    if series:
        rows = rows.dropna(subset=series)
    unit = r.unit_no(F.col(ts))
    first = rows.groupBy(*series).agg(r.origin(F.min(unit)).alias("_o")) if r.anchored else None
    rows = rows.select(*series, unit.alias("_u"), *[number(c).alias(c) for c in columns])
    rows = rows.withColumn("_o", F.lit(0).cast("long")) if first is None else join_sized(rows, first, series, "inner")
    bucket = r.bucket(F.col("_u"), F.col("_o"))
    means = rows.groupBy(*series, "_o", bucket.alias("_b")).agg(*[F.avg(c).alias(c) for c in columns])
    if fill:
        # the first and last bucket come from the means, written once: the input is not read again for them
        means = settle(means, "means")
        span = means.groupBy(*series, "_o").agg(F.min("_b").alias("_from"), F.max("_b").alias("_to"))
        means = bucket_grid(span, [*series, "_o"], max_buckets).join(means, [*series, "_o", "_b"], "left")
    return means.select(*series, r.label(F.col("_b"), F.col("_o")).alias(ts), *columns)


def bucket_grid(span: DataFrame, keep: Sequence[str], max_buckets: int | None = None) -> DataFrame:
    """Rows (keep, _b) for every bucket number in [_from, _to], laid out block by block.

    The blocks of a long span are spread before they are filled, so no array holds a whole series.
    """
    size = F.col("_to") - F.col("_from") + 1
    guard = F.col("_from")
    if max_buckets is not None:
        guard = F.when(size > max_buckets, F.raise_error(F.format_string("%d buckets in one series", size)).cast("long")).otherwise(guard)
    blocks = span.select(
        *keep, "_to", F.explode(F.sequence(guard, F.col("_to"), F.lit(BLOCK).cast("long"))).alias("_start")
    ).repartition(*keep, "_start")
    stop = F.least(F.col("_start") + (BLOCK - 1), F.col("_to"))
    return blocks.select(*keep, F.explode(F.sequence(F.col("_start"), stop)).alias("_b"))
