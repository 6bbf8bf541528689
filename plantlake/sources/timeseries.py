"""Time-series files: one table with a time column, and folders of per-equipment sensor files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plantlake.functions.columns import numeric_columns
from plantlake.functions.ids import tag_parts
from plantlake.functions.text import basename
from plantlake.joins import join_sized
from plantlake.session import settle


def load_timeseries(
    spark: SparkSession, path: str | Sequence[str], datetime_column: str = "timestamp", schema: str | T.StructType | None = None,
    time_format: str | None = None,
) -> DataFrame:
    """CSV with a header; the datetime column becomes a timestamp. An unparsable time fails the job.

    Give ``schema`` for large inputs, it saves the pass that infers the types.
    """
    df, stamp = _read(spark, path, datetime_column, schema, time_format, lenient=False)
    return df.withColumn(datetime_column, stamp)


def load_timeseries_lenient(
    spark: SparkSession, path: str | Sequence[str], datetime_column: str = "timestamp", schema: str | T.StructType | None = None,
    time_format: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows with a time, rejected rows with their text as it stood)."""
    df, stamp = _read(spark, path, datetime_column, schema, time_format, lenient=True)
    good = df.withColumn(datetime_column, stamp).where(F.col(datetime_column).isNotNull())
    return good, df.where(stamp.isNull())


def _read(spark, path, datetime_column, schema, time_format, lenient):
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if schema is None:
        # a format that fits nothing keeps the time as text until it is parsed by our own rule
        df = reader.options(inferSchema=True, preferDate=False, timestampFormat="'unused'").csv(path)
    else:
        df = reader.schema(schema).csv(path)
    if datetime_column not in df.columns:
        raise ValueError(f"datetime column {datetime_column!r} not found, available columns: {', '.join(df.columns)}")
    text = F.col(datetime_column).cast("string")
    parse = F.try_to_timestamp if lenient else F.to_timestamp
    return df, parse(text, F.lit(time_format)) if lenient and time_format else (parse(text, time_format) if time_format else parse(text))


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    """Keep a prepared dataset for later jobs."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def wide_to_long(df: DataFrame, ts: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, ts, tag, value, unit): each numeric column with its ``<column>_unit`` column, if there is one.

    Works for a frame without value columns too: the result is then empty.
    """
    values = numeric_columns(df, skip=[ts, *keep])
    known = set(df.columns)
    cells = [
        F.struct(
            F.lit(c).alias("tag"), F.col(f"`{c}`").cast("double").alias("value"),
            (F.col(f"`{c}_unit`") if f"{c}_unit" in known else F.lit(None)).cast("string").alias("unit"),
        )
        for c in values
    ]
    kind = "array<struct<tag:string,value:double,unit:string>>"
    return df.select(*keep, ts, F.inline(F.array(*cells).cast(kind)))


def long_to_wide(df: DataFrame, ts: str, tags: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One column per given tag; several readings of a tag at one time are averaged."""
    return df.groupBy(*keep, ts).pivot("tag", list(tags)).agg(F.avg("value"))


def read_sensor_files(spark: SparkSession, path: str, datetime_column: str = "timestamp") -> DataFrame:
    """(file, ts, tag, value, unit) of many CSV files that may each have other columns.

    Lines meet the header of their own file; no file list goes through the driver and a file with the
    time column alone gives no readings.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    width = lines.agg(F.max(F.regexp_count("value", F.lit(",")))).first()[0]
    if width is None:
        raise ValueError(f"no lines under {path}")
    names = [f"c{i}" for i in range(width + 1)]
    row = F.from_csv("value", ", ".join(f"{n} string" for n in names))
    # a line is parsed once, whatever the number of columns: the fields are taken from the parsed row
    cells = lines.select("file", F.transform(F.array(row), lambda r: F.array(*[r[n] for n in names]))[0].alias("cells"), "value")
    is_header = F.coalesce(F.array_contains("cells", datetime_column), F.lit(False))
    if not set(datetime_column) & set('"\\'):
        # lines without the name are told apart before they are parsed
        is_header = F.col("value").contains(datetime_column) & is_header
    headers = settle(
        cells.where(is_header).groupBy("file").agg(F.min("cells").alias("names")), "headers"
    )
    if headers.isEmpty():
        raise ValueError(f"datetime column {datetime_column!r} not found in any header under {path}")
    rows = join_sized(cells.where(~is_header).drop("value"), headers, ["file"], "inner")
    place = F.array_position("names", datetime_column)
    long = rows.select(
        "file", F.to_timestamp(F.element_at("cells", place.cast("int"))).alias("ts"), "names", "cells",
        F.posexplode("names").alias("no", "tag"),
    ).where(F.col("tag").isNotNull() & (F.col("tag") != datetime_column) & ~F.col("tag").endswith("_unit"))
    unit_at = F.array_position("names", F.concat("tag", F.lit("_unit"))).cast("int")
    return long.select(
        F.col("file"), "ts", "tag",
        F.expr("try_cast(cells[no] as double)").alias("value"),
        F.when(unit_at > 0, F.element_at("cells", F.greatest(unit_at, F.lit(1)))).alias("unit"),
    )


def readings(long: DataFrame) -> DataFrame:
    """Long readings with the parts of the sensor tag as columns."""
    parts = tag_parts(F.col("tag"))
    rest = [c for c in long.columns if c != "tag"]
    return long.select("tag", *rest, parts.alias("_t")).select(
        F.col("_t.plant").alias("plant"), F.col("_t.area").alias("area"), F.col("_t.equipment").alias("equipment"), "tag",
        F.col("_t.measure").alias("measure"), F.col("_t.instance").alias("instance"), *rest,
    )


def tag_dimension(long: DataFrame) -> DataFrame:
    """One row per sensor tag with its parts, unit, number of readings and time range."""
    return readings(long).groupBy("plant", "area", "equipment", "tag", "measure", "instance").agg(
        F.max("unit").alias("unit"), F.count("value").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )


def file_name(long: DataFrame) -> DataFrame:
    return long.withColumn("file", basename(F.col("file")))
