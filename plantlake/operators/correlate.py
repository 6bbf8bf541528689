"""Pairwise-complete Pearson correlation and the strong pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plantlake.functions.columns import number, numeric_columns

# above this many columns the n*(n-1)/2 aggregate expressions are replaced by partial sums per task
WIDE = 12
# count, means and co-moments kept per pair, and how many cells of them a task holds before it passes them on
SUMS = ["n", "ma", "mb", "caa", "cbb", "cab"]
HELD_CELLS = 4_000_000


def correlation_pairs(
    df: DataFrame, columns: Sequence[str] | None = None, *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """(series, a, b, n, r) for a before b; r is null where a column does not vary."""
    series = list(series_cols)
    columns = numeric_columns(df, columns, skip=series)
    if len(columns) < 2:
        raise ValueError("need at least two numeric columns to correlate")
    if len(columns) > WIDE:
        return _pairs_by_sums(df, columns, series)
    values = df.select(*series, *[number(c).alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    wide = values.groupBy(*series).agg(
        *[_pearson(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)],
        *[F.regr_count(a, b).alias(f"_n{i}") for i, (a, b) in enumerate(pairs)],
    )
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_n{i}").alias("n"),
                 F.col(f"_r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ])
    return wide.select(*series, F.inline(cells))


def _pearson(a: str, b: str) -> Column:
    """Pearson's r over the rows with both values, null when one of them is constant there."""
    return F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b)))


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, *, series_cols: Sequence[str] = ()
) -> DataFrame:
    """The full grid (series, a, b, r): both triangles, and 1 on the diagonal of a varying column."""
    series = list(series_cols)
    columns = numeric_columns(df, columns, skip=series)
    half = correlation_pairs(df, columns, series_cols=series).select(*series, "a", "b", "r")
    cells = F.array(*[F.struct(F.lit(c).alias("a"), F.stddev_pop(number(c)).alias("_sd")) for c in columns])
    diagonal = df.groupBy(*series).agg(cells.alias("_c")).select(*series, F.inline("_c")).select(
        *series, "a", F.col("a").alias("b"), F.when(F.col("_sd") > 0, F.lit(1.0)).alias("r")
    )
    return half.unionByName(half.select(*series, F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(diagonal)


def strong_pairs(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs with abs(r) strictly above the threshold, with a two-decimal label."""
    label = F.format_string("%s and %s: %.2f", "a", "b", "r")
    return pairs.where(F.abs("r") > threshold).withColumn("label", label)


def _pairs_by_sums(df: DataFrame, columns: list[str], series: list[str]) -> DataFrame:
    """Many columns: each task adds up co-moments per series with matrix products, Spark merges the tasks.

    Co-moments are taken around the means of the rows that a task holds of a series, and merged around the means of all, so a
    series far from the others, or from zero, loses no digits.
    """
    keys = [f"_k{i}" for i in range(len(series))]
    values = df.select(*[F.col(s).alias(k) for s, k in zip(series, keys)], *[number(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    m = len(columns)
    upper = np.triu_indices(m, 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for key, parts in held.items():
                out = pd.DataFrame({"i": upper[0], "j": upper[1]} | {s: parts[n][upper] for n, s in enumerate(SUMS)})
                yield out.assign(**{k: pd.Series([v] * len(out), dtype=object) for k, v in zip(keys, key)})

        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]:
                key = tuple(None if pd.isna(v) else v for v in key)
                new = _moments(part[[f"_c{i}" for i in range(m)]].to_numpy(float))
                held[key] = _merge(held[key], new) if key in held else new
            if len(held) * m * m > HELD_CELLS:
                yield from rows()
                held.clear()
        yield from rows()

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    schema += "".join(f", {k} {kinds[s]}" for s, k in zip(series, keys))
    parts = values.mapInPandas(partial, schema)
    # a pair of a series has one row per task
    pair = W.partitionBy(*keys, "i", "j")
    n = F.col("n")
    mean = lambda c: F.sum(n * F.col(c)).over(pair) / F.nullif(F.sum("n").over(pair), F.lit(0.0))
    parts = parts.withColumn("_ma", mean("ma")).withColumn("_mb", mean("mb"))
    da, db = F.col("ma") - F.col("_ma"), F.col("mb") - F.col("_mb")
    sums = parts.groupBy(*keys, "i", "j").agg(
        F.sum("n").alias("n"), F.first("_ma").alias("ma"), F.first("_mb").alias("mb"),
        F.sum(F.col("caa") + n * da * da).alias("caa"), F.sum(F.col("cbb") + n * db * db).alias("cbb"), F.sum(F.col("cab") + n * da * db).alias("cab"),
    )
    if not series:
        grid = df.sparkSession.createDataFrame([(int(i), int(j)) for i, j in zip(*upper)], "i int, j int")
        sums = grid.join(sums, ["i", "j"], "left").fillna(0.0, ["n"])
    # what is left of a constant column is rounding noise
    varies = (F.col("caa") > n * F.col("ma") ** 2 * 1e-24) & (F.col("cbb") > n * F.col("mb") ** 2 * 1e-24)
    names = F.array(*[F.lit(c) for c in columns])
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("cab", F.sqrt(F.col("caa") * F.col("cbb")))))
    return sums.select(
        *[F.col(k).alias(s) for s, k in zip(series, keys)],
        F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"),
        n.cast("long").alias("n"), F.when((n > 1) & varies, r).alias("r"),
    )


def _moments(x: np.ndarray) -> np.ndarray:
    """n, both means and the centred co-moments of every pair of columns, over the rows that hold both values."""
    ok = (~np.isnan(x)).astype(float)
    count = ok.sum(axis=0)
    middle = np.divide(np.nansum(x, axis=0), count, out=np.zeros(x.shape[1]), where=count > 0)
    x = np.nan_to_num(x - middle)
    n, sa, sb = ok.T @ ok, x.T @ ok, ok.T @ x
    over = np.maximum(n, 1.0)
    caa, cbb, cab = (x * x).T @ ok - sa * sa / over, ok.T @ (x * x) - sb * sb / over, x.T @ x - sa * sb / over
    return np.stack([n, middle[:, None] + sa / over, middle[None, :] + sb / over, np.maximum(caa, 0.0), np.maximum(cbb, 0.0), cab])


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sets of co-moments as one."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    da, db, both = b[1] - a[1], b[2] - a[2], a[0] * share
    return np.stack([n, a[1] + da * share, a[2] + db * share, a[3] + b[3] + da * da * both, a[4] + b[4] + db * db * both, a[5] + b[5] + da * db * both])
