"""Dataset summary, descriptive statistics, histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from plantlake.functions.columns import number, numeric_columns, to_long
from plantlake.joins import join_sized
from plantlake.operators.quantiles import exact_quantiles
from plantlake.ordered import window_plan

# values of one series that a percentile aggregate may hold
PERCENTILE_ROWS = 250_000


def overview(df: DataFrame, ts: str, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Shape, columns, time range and missing values per column; one pass over the data."""
    series = list(series_cols)
    columns = [c for c in df.columns if c not in {ts, *series}]
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def missing(c):
        gone = F.col(c).isNull()
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            gone = gone | F.isnan(c)
        return F.count_if(gone)

    facts = df.groupBy(*series).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(ts).alias("_start"), F.max(ts).alias("_end"),
        *[missing(c).alias(f"_m{i}") for i, c in enumerate(columns)],
    )
    pairs = [x for i, c in enumerate(columns) for x in (F.lit(c), F.coalesce(F.col(f"_m{i}"), F.lit(0)))]
    return facts.select(
        *series,
        F.array(F.col("_rows"), F.lit(len(columns)).cast("long")).alias("shape"),
        F.array(*[F.lit(c) for c in columns]).alias("columns"),
        F.struct(F.col("_start").alias("start"), F.col("_end").alias("end")).alias("time_range"),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,bigint>")).alias("missing"),
    )


def describe(
    df: DataFrame, columns: Sequence[str] | None = None, *, series_cols: Sequence[str] = (), approximate: bool = False,
    accuracy: int = 10_000, percentile_rows: int = PERCENTILE_ROWS,
) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column, one row per (series, column).

    Quartiles are exact: while no series holds more than ``percentile_rows`` values by Spark's own
    aggregate, which keeps the values of a series in memory, beyond by ``exact_quantiles``.
    """
    series = list(series_cols)
    columns = numeric_columns(df, columns, skip=series)
    if not columns:
        raise ValueError("no numeric columns, use describe_labels")
    cells = to_long(df, series, columns)
    keys = [*series, "column"]
    plain = [
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ]
    order = [*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    at = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    if approximate or window_plan(cells, keys, percentile_rows)[0]:
        quartiles = F.percentile_approx("value", at, F.lit(accuracy)) if approximate else F.percentile("value", at)
        stats = cells.groupBy(*keys).agg(*plain, quartiles.alias("_q"))
        return stats.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(["q25", "q50", "q75"])]).select(*order)
    quart = exact_quantiles(cells, keys, "value", [0.25, 0.5, 0.75], ["q25", "q50", "q75"], accuracy)
    same = F.struct(*keys).alias("_key")
    stats = cells.groupBy(*keys).agg(*plain).select("*", same)
    quart = quart.select(same, "q25", "q50", "q75")
    # a null key is equal to itself inside a struct; a series without values has no quartiles
    return stats.join(quart, "_key", "left").select(*order)


def describe_labels(df: DataFrame, columns: Sequence[str], *, series_cols: Sequence[str] = ()) -> DataFrame:
    """count, unique, top and freq of text columns, for data without a numeric column."""
    series = list(series_cols)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(*series, F.inline(cells)).where(F.col("value").isNotNull())
    counted = rows.groupBy(*series, "column", "value").agg(F.count(F.lit(1)).alias("_n"))
    # the most frequent value; the smallest one among equals
    return counted.groupBy(*series, "column").agg(
        F.sum("_n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("_n")).alias("m"), F.col("value").alias("v"))).alias("_top"),
    ).select(*series, "column", "count", "unique", F.col("_top.v").alias("top"), (-F.col("_top.m")).alias("freq"))


def summarize(df: DataFrame, ts: str) -> DataFrame:
    """Overview plus statistics as one nested row, the content of a dataset's summary file."""
    base = overview(df, ts)
    columns = numeric_columns(df, skip=[ts])
    if not columns:
        return base.withColumn("stats", F.lit(None).cast("map<string,map<string,double>>"))
    stat_names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    table = describe(df, columns)
    inner = F.create_map(*[x for s in stat_names for x in (F.lit(s), F.col(s).cast("double"))])
    # one entry per numeric column
    stats = table.agg(F.map_from_entries(F.collect_list(F.struct(F.col("column"), inner))).alias("stats"))
    return base.join(F.broadcast(stats), how="left", on=F.lit(True))


def histogram(df: DataFrame, column: str, bins: int = 10, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between minimum and maximum, empty bins included; the last bin is closed."""
    if bins < 1:
        raise ValueError("bins must be positive")
    series = list(series_cols)
    rows = df.select(*series, number(column).alias("_v")).where(F.col("_v").isNotNull())
    if series:
        rows = rows.dropna(subset=series)
    span = rows.groupBy(*series).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    joined = join_sized(rows, span, series, "inner")
    width = (F.col("_hi") - F.col("_lo")) / bins
    no = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))
    ).cast("int")
    counted = joined.groupBy(*series, no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.where(F.col("_lo").isNotNull()).select(
        *series, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    full = grid.join(counted, [*series, "bin"], "left")
    return full.select(
        *series, "bin", (F.col("_lo") + F.col("bin") * width).alias("from"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("to"), F.coalesce("n", F.lit(0)).alias("n"),
    )
