"""Joins that keep a heavy key, or a heavy null, from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plantlake.session import row_bytes, settle, settle_sized

BROADCAST_BYTES = 32 * 1024 * 1024
# rows of one key that a single task may join
HOT_ROWS = 1_000_000


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure the rows against the limit; one pass over ``df``."""
    return (df.agg(F.sum(row_bytes(df)).alias("b")).first()["b"] or 0) <= max_bytes


def join_sized(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Join a large side with a derived side: broadcast when its measured size allows, else by hot keys.

    Without keys the derived side is a global aggregate, that is one row.
    """
    on = list(on)
    small, size = settle_sized(small)
    if not on:
        return big.join(F.broadcast(small), how="left" if how == "left" else "inner", on=F.lit(True))
    if size <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return join_hot(big, small, on, how)


def hot_keys(df: DataFrame, on: Sequence[str], rows: int = HOT_ROWS) -> DataFrame | None:
    """(on, _salts): keys with more than ``rows`` rows, and over how many tasks to spread each."""
    if df.count() <= rows:
        return None
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows)
    found = settle(counts.select(*on, F.ceil(F.col("_rows") / rows).cast("int").alias("_salts")), "hot")
    return None if found.isEmpty() else found


def join_hot(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", rows: int = HOT_ROWS,
    measured: tuple[DataFrame | None] | None = None,
) -> DataFrame:
    """Equi join of two large sides; rows of ``big`` with a hot key are spread, their partners repeated.

    ``how`` is left, inner, left_semi or left_anti. ``measured`` holds the result of an earlier
    ``hot_keys`` on the same table. Rows with a hot key are written once with a number of their own, which is their
    salt: equal rows spread like any others, and a repeated task gives every row the same salt.
    """
    on = list(on)
    hot = measured[0] if measured else hot_keys(big, on, rows)
    if hot is None:
        return big.join(small, on, how)
    hot = F.broadcast(hot) if fits_broadcast(hot) else hot
    numbered = settle(big.join(hot, on).withColumn("_salt", F.monotonically_increasing_id()), "hot-rows")
    salted_big = numbered.withColumn("_salt", F.pmod("_salt", F.col("_salts").cast("long"))).drop("_salts")
    all_salts = F.sequence(F.lit(0).cast("long"), F.col("_salts").cast("long") - 1)
    salted_small = small.join(hot, on).withColumn("_salt", F.explode(all_salts)).drop("_salts")
    spread = salted_big.join(salted_small, on + ["_salt"], how).drop("_salt")
    return big.join(hot, on, "left_anti").join(small, on, how).unionByName(spread)


def left_join_key(left: DataFrame, right: DataFrame, left_key: str, right_key: str, row_id: str) -> DataFrame:
    """Left join on a nullable string foreign key; null keys and hot keys spread over all tasks.

    ``right_key`` is unique in ``right`` and none of its values starts with a NUL character.
    """
    spread = F.coalesce(F.col(left_key), F.concat(F.lit("\u0000"), F.col(row_id).cast("string")))
    keyed = left.withColumn("_fk", spread)
    other = right.withColumn("_fk", F.col(right_key))
    return join_hot(keyed, other, ["_fk"], "left").drop("_fk")
