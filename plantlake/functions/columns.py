"""Column selection and null rules shared by the time-series operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None, skip: Sequence[str] = ()) -> list[str]:
    """The given columns, or every numeric one. Booleans are not numbers here."""
    by_name = {f.name: f.dataType for f in df.schema.fields}
    if columns:
        unknown = [c for c in columns if c not in by_name]
        if unknown:
            raise ValueError(f"column(s) {unknown} not found, available columns: {', '.join(df.columns)}")
        wrong = [c for c in columns if not isinstance(by_name[c], T.NumericType)]
        if wrong:
            raise ValueError(f"column(s) {wrong} are not numeric")
        return list(columns)
    return [n for n, t in by_name.items() if isinstance(t, T.NumericType) and n not in set(skip)]


def number(name: str) -> Column:
    """Value as double with NaN read as missing."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def present(df: DataFrame, column: str) -> DataFrame:
    """Rows that carry a value in the analysed column; other columns may be null."""
    return df.where(number(column).isNotNull())


def between(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Date-range slice, both ends included."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end))
    return df


def by_time(df: DataFrame, ts: str, series_cols: Sequence[str] = ()) -> DataFrame:
    """Sorted by series and time, for an ordered output; the operators themselves need no sorted input."""
    return df.orderBy(*series_cols, ts)


def to_long(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """One row per (kept columns, column name); missing values are dropped."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), number(c).alias(value)) for c in columns])
    return df.select(*keep, F.inline(cells)).where(F.col(value).isNotNull())
