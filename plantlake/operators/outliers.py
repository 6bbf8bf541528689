"""Isolation forest and z-score outliers per series."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from plantlake.functions.columns import number, present
from plantlake.joins import BROADCAST_BYTES, join_sized
from plantlake.operators.quantiles import weighted_quantile
from plantlake.session import settle, settle_sized

# rows of a tree
SAMPLE = 256
# times as many hashes are let through at first
SPARE = 4.0
GROUP_ROWS = 250_000
EULER = 0.5772156649015329


def zscore_outliers(df: DataFrame, value: str, threshold: float = 3.0, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """Adds z and is_outlier; a series without spread has no outliers."""
    series = list(series_cols)
    rows = present(df, value)
    spread = rows.groupBy(*series).agg(F.avg(number(value)).alias("_mean"), F.stddev_samp(number(value)).alias("_sd"))
    z = F.when(F.col("_sd") > 0, (number(value) - F.col("_mean")) / F.col("_sd"))
    return (
        join_sized(rows, spread, series, "inner")
        .withColumn("z", z)
        .withColumn("is_outlier", F.coalesce(F.abs("z") > threshold, F.lit(False)))
        .drop("_mean", "_sd")
    )


def outlier_share(flagged: DataFrame, *, series_cols: Sequence[str] = ()) -> DataFrame:
    """n, number of outliers and their percentage."""
    return flagged.groupBy(*series_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_outlier").alias("n_outliers"),
        (F.count_if("is_outlier") * 100.0 / F.count(F.lit(1))).alias("pct_outliers"),
    )


def mean_depth(n: np.ndarray | float) -> np.ndarray:
    """Average depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        deep = 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def grow_forest(samples: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Isolation trees over a single feature, one per row of ``samples`` (each row sorted), as one step function.

    Returns points and jumps sorted by point: the path length at x, summed over the trees, is the sum of
    the jumps at points below x. A tree starts with its leftmost path length at minus infinity. All
    nodes of one depth are split at once.
    """
    trees, size = samples.shape
    flat = samples.ravel()
    limit = math.ceil(math.log2(max(size, 2)))
    lo = np.arange(trees) * size
    hi = lo + size
    starts, paths = [], []
    border = np.full(len(flat), -np.inf)
    for depth in range(limit + 1):
        open_ = (flat[lo] < flat[hi - 1]) & (depth < limit)
        starts.append(lo[~open_])
        paths.append(depth + mean_depth(hi - lo)[~open_])
        lo, hi = lo[open_], hi[open_]
        if not len(lo):
            break
        at = rng.uniform(flat[lo], flat[hi - 1])
        width = hi - lo
        node = np.repeat(np.arange(len(lo)), width)
        inside = np.arange(len(node)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo, width)
        cut = lo + np.bincount(node, weights=flat[inside] <= at[node], minlength=len(lo)).astype(int)
        border[cut] = at
        lo, hi = np.concatenate([lo, cut]), np.concatenate([cut, hi])
    first, path = np.concatenate(starts), np.concatenate(paths)
    order = np.argsort(first)
    first, path = first[order], path[order]
    jump = np.diff(path, prepend=0.0)
    begins = first % size == 0
    jump[begins] = path[begins]
    point = border[first]
    point[begins] = -np.inf
    by_point = np.argsort(point, kind="stable")
    return point[by_point], jump[by_point]


def forest_samples(
    rows: DataFrame, row_id: Sequence[str], trees: int = 100, seed: int = 42, *, series_cols: Sequence[str] = (), sample: int = SAMPLE, spare: float = SPARE,
) -> DataFrame:
    """(series, _tree, _h, _v): for every series and tree the ``sample`` rows with the smallest hash of tree and row id.

    ``rows`` has the series, ``row_id`` and ``_v``. Every row takes part for every tree. Only hashes below a limit that lets
    about ``spare`` times the sample through are sent on, each task keeping its smallest; where a tree is short of rows the series is
    drawn again with a limit that is eight times higher, so the limit never decides which rows are drawn.
    """
    series = list(series_cols)
    counts = settle(rows.groupBy(*series).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    full = 2**31
    parts, share = [], float(spare * sample)
    while True:
        keyed = join_sized(rows, counts, series, "inner")
        limit = F.least(F.lit(1.0), F.lit(share) / F.col("_n")) * full
        marks = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, *row_id).alias("h")))
        drawn = keyed.select(*series, "_n", "_v", F.explode(F.filter(marks, lambda m: F.pmod(m["h"], F.lit(full)) < limit)).alias("_m"))
        drawn = drawn.select(*series, "_n", F.col("_m.tree").alias("_tree"), F.pmod("_m.h", F.lit(full)).alias("_low"), F.col("_m.h").alias("_h"), "_v")
        smallest = W.partitionBy(*series, "_tree").orderBy("_low", "_h", "_v")
        kept = settle(drawn.withColumn("_place", F.row_number().over(smallest)).where(F.col("_place") <= sample), "drawn")
        parts.append(kept)
        # a series is done when all of its trees have as many rows as there are, up to the sample
        done = kept.groupBy(*series, "_n").agg(F.count(F.lit(1)).alias("_got")).where(F.col("_got") >= trees * F.least(F.col("_n"), F.lit(sample)))
        if not series:
            left = counts.limit(0 if not done.isEmpty() else 1)
        else:
            left = counts.join(done.select(*series), series, "left_anti")
        counts = settle(left.where("_n > 0"), "sizes")
        if counts.isEmpty():
            break
        # the next round draws these series anew
        parts[-1] = kept.join(counts.select(*series), series, "left_anti") if series else kept.limit(0)
        share *= 8
    return functools.reduce(DataFrame.unionByName, parts).select(*series, "_tree", "_h", "_v")


def iforest_steps(
    df: DataFrame, value: str, row_id: Sequence[str], trees: int = 100, seed: int = 42, *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """The forest of each series as one row: (series, points, totals, sample).

    ``totals`` is the path length summed over all trees to the right of each point. Every tree draws from all rows of its
    series; a series' trees, ``trees`` times 256 values, meet in one task.
    """
    series = list(series_cols)
    rows = present(df, value).select(*series, *row_id, number(value).alias("_v"))
    if series:
        rows = rows.dropna(subset=series)
    drawn = forest_samples(rows, row_id, trees, seed, series_cols=series)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_tree", "_v"])
        size = len(pdf) // trees
        points, jumps = grow_forest(pdf["_v"].to_numpy(float).reshape(trees, size), np.random.default_rng(seed))
        out = {s: [pdf[s].iloc[0]] for s in series}
        return pd.DataFrame(out | {"points": [points], "totals": [np.cumsum(jumps)], "sample": [float(size)]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "".join(f"`{s}` {kinds[s]}, " for s in series) + "points array<double>, totals array<double>, sample double"
    return drawn.groupBy(*series).applyInPandas(build, schema)


def _score(points: np.ndarray, totals: np.ndarray, sample: float, trees: int, x: np.ndarray) -> np.ndarray:
    """Anomaly score of x; points sorted, the starts of the trees at minus infinity first."""
    depth = float(mean_depth(sample))
    if depth <= 0:
        return np.full(len(x), 0.5)
    path = totals[np.searchsorted(points, x, side="left") - 1]
    # twelve digits: one level has one score, whatever the rounding of the sums
    return np.round(2.0 ** (-(path / trees) / depth), 12)


def iforest_outliers(
    df: DataFrame, value: str, row_id: Sequence[str], contamination: float = 0.05, trees: int = 100, seed: int = 42, *,
    series_cols: Sequence[str] = (), max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(series, row_id, value, score, is_outlier) of every row with a value, judged within its series.

    ``row_id`` identifies a row within its series. A row is an outlier when its score lies strictly
    above the (1 - contamination) quantile of the scores of its series.
    """
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    series, row_id = list(series_cols), list(row_id)
    rows = present(df, value).select(*series, *row_id, number(value).alias(value))
    if series:
        rows = rows.dropna(subset=series)
    steps, size = settle_sized(iforest_steps(rows, value, row_id, trees, seed, series_cols=series), "steps")
    if size <= max_bytes:
        scored = _score_by_lookup(rows, value, steps, series, trees)
    else:
        scored = _score_by_group(rows, value, steps, series, row_id, trees)
    scored = settle(scored, "scored")
    levels = scored.groupBy(*series, "score").agg(F.count(F.lit(1)).alias("_m"))
    limit = weighted_quantile(levels, series, "score", "_m", 1.0 - contamination, "_limit")
    flagged = join_sized(scored, limit, series, "inner")
    return flagged.withColumn("is_outlier", F.col("score") > F.col("_limit") + 1e-12).drop("_limit")


def _score_by_lookup(rows: DataFrame, value: str, steps: DataFrame, series: list[str], trees: int) -> DataFrame:
    """Steps of all series were measured to be small: every task gets them, no row is shuffled."""
    table = steps.toPandas()
    keys = table[series].itertuples(index=False, name=None) if series else [()] * len(table)
    lookup = {
        key: (np.asarray(points), np.asarray(totals), sample)
        for key, points, totals, sample in zip(keys, table["points"], table["totals"], table["sample"])
    }
    shared = rows.sparkSession.sparkContext.broadcast(lookup)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for x, _, *keys in batches:
            out = np.empty(len(x))
            groups = pd.DataFrame(dict(enumerate(keys))).groupby(list(range(len(keys)))).indices if keys else {(): slice(None)}
            for key, idx in groups.items():
                out[idx] = _score(*shared.value[key if isinstance(key, tuple) else (key,)], trees, x.to_numpy(float)[idx])
            yield pd.Series(out)

    # the constant keeps a batch a tuple when there is no series column
    return rows.withColumn("score", score(value, F.lit(0), *series))


def _score_by_group(
    rows: DataFrame, value: str, steps: DataFrame, series: list[str], row_id: list[str], trees: int
) -> DataFrame:
    """Many series: rows meet their own series' steps, a long series in several groups of bounded size."""
    counts = rows.groupBy(*series).agg((F.floor(F.count(F.lit(1)) / GROUP_ROWS) + 1).alias("_parts"))
    left = join_sized(rows, counts, series, "inner").withColumn(
        "_part", F.pmod(F.xxhash64(*row_id), F.col("_parts"))
    ).drop("_parts")
    right = join_sized(steps, counts, series, "inner").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
    ).drop("_parts")

    def score(pdf: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        out = pdf.drop(columns="_part")
        if len(out) == 0:
            return out.assign(score=pd.Series(dtype=float))
        forest = table.iloc[0]
        return out.assign(score=_score(forest["points"], forest["totals"], forest["sample"], trees, pdf[value].to_numpy(float)))

    keys = [*series, "_part"]
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, schema)
