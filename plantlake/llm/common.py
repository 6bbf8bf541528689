"""Small helpers shared by the operators: tables, crc folds, work on Arrow batches, scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantlake.session import settle

# rows of one slice that Python code holds at a time, and characters of text in it
SLICE_ROWS = 2_000
SLICE_CHARS = 4_000_000
# the same for work that needs many bytes per character
SMALL_SLICE = 500_000

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def aside(docs: DataFrame, keep: Collection[str]) -> DataFrame:
    """The same columns in the same order; all but ``keep`` carry names of ours, so that none clashes with a working column."""
    return docs.toDF(*[c if c in keep else f"own{i}" for i, c in enumerate(docs.columns)])


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % folds


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds a bounded number of rows and, but for its last row, of characters."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(lengths):
            size += int(n)
            if size >= chars or i + 1 - start >= SLICE_ROWS:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def over_texts(
    df: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, text: str = "text", chars: int = SLICE_CHARS
) -> DataFrame:
    """Run ``fold`` over the slices of every partition; a task gives back the buffers it held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fold(slices(batches, text, chars))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow lists from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def once(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate to the shared folder and read it back: later passes read the same rows."""
    return settle(df, label)


def most_frequent(df: DataFrame, limit: int, column: str = "n", cap: int = 100_000) -> DataFrame:
    """The rows with the highest counts, ``limit`` of them at most; rows with equal counts stay or go together.

    Only the number of rows per count, at most ``cap`` numbers, comes to the driver: nothing is sorted or merged there.
    """
    per = df.groupBy(F.least(F.col(column), F.lit(cap)).alias("v")).agg(F.count(F.lit(1)).alias("c")).collect()
    total, least = 0, cap + 1
    for r in sorted(per, key=lambda r: -r["v"]):
        total += r["c"]
        if total > limit:
            break
        least = r["v"]
    return df.where(F.col(column) >= least)


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Remove a scratch table that nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
