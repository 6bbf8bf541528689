"""Exact quantiles without sorting a whole series in one task.

First pass: a mergeable sketch per series gives for every probability a narrow value band that should
hold the wanted ranks. Second pass: rows below a band are only counted, rows inside it are counted per
distinct value. Both collapse on the map side, so the shuffle carries the bands, not the series. Where a band does not
hold its rank, the series goes through further rounds with bands that are wider each time.
"""

from __future__ import annotations

from collections.abc import Sequence
import functools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plantlake.joins import join_sized
from plantlake.ordered import WINDOW_ROWS, running_total
from plantlake.session import settle


# band number of a series that is counted as a whole
ALL = -1


def exact_quantiles(
    df: DataFrame, series: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str],
    accuracy: int = 10_000, window_rows: int = WINDOW_ROWS, slack: float | None = None,
) -> DataFrame:
    """One row per series with the linearly interpolated quantiles; nulls are skipped.

    ``slack`` is how far, in probability, a band reaches to both sides of its rank in the first round. A later round is sixteen
    times wider and takes the series that are left; from 1 on a band is the whole series, so the rounds end.

    A band of more than ``window_rows`` distinct values is summed up in chunks instead of one window. A null key is a
    series of its own: keys travel inside a struct, whose nulls are equal.
    """
    outer, series = list(series), ["_key"] if series else []
    key = [F.struct(*outer).alias("_key")] if outer else []
    rows = df.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"))
    slack = 5.0 / accuracy if slack is None else slack
    m = len(probs)
    edges = [min(1.0, max(0.0, e)) for e in [*(p - slack for p in probs), *(p + slack for p in probs)]]
    sketch = rows.groupBy(*series).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), F.lit(accuracy)).alias("_edges"),
    )
    # the end of the range next to probability 0 or 1 is open; a short series is one band for all probabilities
    short = F.col("_n") <= accuracy
    bands = sketch.select(
        *series, "_n", short.alias("_short"),
        *[(F.col("_min") if p - slack <= 0 else F.col("_edges")[i]).alias(f"_lo{i}") for i, p in enumerate(probs)],
        *[(F.col("_max") if p + slack >= 1 else F.col("_edges")[m + i]).alias(f"_hi{i}") for i, p in enumerate(probs)],
    )
    joined = join_sized(rows, bands, series, "inner")
    whole = F.array(F.struct(F.lit(ALL).alias("_q"), F.col("_v").alias("_x")))
    banded = F.array(*[
        F.when(F.col("_v") <= F.col(f"_hi{i}"),
               F.struct(F.lit(i).alias("_q"), F.when(F.col("_v") >= F.col(f"_lo{i}"), F.col("_v")).alias("_x")))
        for i in range(m)
    ])
    counted = (
        joined.select(*series, "_n", F.explode(F.when(F.col("_short"), whole).otherwise(banded)).alias("_c"))
        .where(F.col("_c").isNotNull())
        .groupBy(*series, "_n", F.col("_c._q").alias("_q"), F.col("_c._x").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_m"))
    )
    counted = settle(counted, "bands")
    longest = counted.groupBy(*series, "_q").agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0
    found = settle(_pick(counted, series, probs, names, chunked=longest > window_rows), "quantiles")
    shown = found.select(*[F.col("_key")[c].alias(c) for c in outer], *names, "_missed")
    if not found.where("_missed").limit(1).count():
        return shown.drop("_missed")
    wider = max(16.0 * slack, 16.0 * 5.0 / accuracy)
    if not outer:
        return exact_quantiles(df, outer, value, probs, names, accuracy, window_rows, wider)
    again = shown.where("_missed").select(F.struct(*outer).alias("_again"))
    left = join_sized(df.withColumn("_again", F.struct(*outer)), again, ["_again"], "left_semi").drop("_again")
    return shown.where("NOT _missed").drop("_missed").unionByName(exact_quantiles(left, outer, value, probs, names, accuracy, window_rows, wider))


def weighted_quantile(counted: DataFrame, series: Sequence[str], value: str, weight: str, prob: float, name: str) -> DataFrame:
    """Quantile per series from a table of (value, how often); the distinct values per series are few."""
    series = list(series)
    rows = counted.select(
        *series, F.sum(weight).over(W.partitionBy(*series)).alias("_n"), F.lit(ALL).alias("_q"),
        F.col(value).cast("double").alias("_x"), F.col(weight).alias("_m"),
    )
    return _pick(rows, series, [prob], [name]).drop("_missed")


def _pick(counted: DataFrame, series: list[str], probs: Sequence[float], names: Sequence[str], chunked: bool = False) -> DataFrame:
    """Interpolate between the values at the two ranks around prob * (n - 1).

    ``_x`` null stands for all rows below the band. ``_missed`` says that a band does not hold its ranks.
    """
    if chunked:
        ranked = running_total(counted, [*series, "_q"], ["_x"], F.col("_m"), "_cum", window_rows=0)
    else:
        upto = W.partitionBy(*series, "_q").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
        ranked = counted.withColumn("_cum", F.sum("_m").over(upto))
    x, cum = F.col("_x"), F.col("_cum")

    def at(i: int, p: float) -> list[Column]:
        mine, rank = F.col("_q").isin(i, ALL), F.lit(float(p)) * (F.col("_n") - 1)
        return [
            F.min(F.when(mine & (cum > F.floor(rank)), x)).alias(f"_a{i}"),
            F.min(F.when(mine & (cum > F.ceil(rank)), x)).alias(f"_b{i}"),
            F.max(F.when(mine & x.isNull(), cum > F.floor(rank))).alias(f"_below{i}"),
        ]

    found = ranked.groupBy(*series).agg(F.first("_n").alias("_n"), *[c for i, p in enumerate(probs) for c in at(i, p)])

    def quantile(i: int, p: float) -> Column:
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        return F.col(f"_a{i}") + (rank - F.floor(rank)) * (F.col(f"_b{i}") - F.col(f"_a{i}"))

    # a series without any value has no quantile, and none that could be missed
    out = [F.coalesce(F.col(f"_below{i}"), F.lit(False)) | F.col(f"_b{i}").isNull() for i in range(len(probs))]
    missed = functools.reduce(Column.__or__, out, F.lit(False)) & F.col("_n").isNotNull()
    return found.select(*series, *[quantile(i, p).alias(n) for i, (p, n) in enumerate(zip(probs, names))], missed.alias("_missed"))
