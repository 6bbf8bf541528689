"""Token ids in ORC files: run-length encoded integers, row indexes, stripes and Bloom filters on document ids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from plantlake.llm.common import lists, over_texts, texts_of
from plantlake.llm.encoding import word_encoder

STRIPE_BYTES = 16 * 1024 * 1024
ROW_INDEX_STRIDE = 1_000
FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, token_ids array<int>"


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = STRIPE_BYTES, stride: int = ROW_INDEX_STRIDE,
    partitions: int | None = None,
) -> None:
    """Write the ids of every text, each followed by ``end_id``, to ``path`` in ascending doc_id order.

    ``path/tokens`` holds the rows (doc_id, part, part_start, n_tokens, token_ids); files follow each other in the order
    of their names, null doc_ids first, equal doc_ids by text. ``path/parts`` holds one row per file part with
    the ids before it, so a document's place in the whole stream is ``start + part_start``. Every part is written on its
    own and can be written again after a lost executor. Null text is empty (one id: the end). Other columns are not read;
    an empty table gives files without rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    placed = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [x + end for x in word_encoder(tokenizer).encode(texts_of(b.column("text")))]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            tokens = lists(np.frombuffer(b"".join(ids), "<i4"), counts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(counts), tokens],
                ["doc_id", "part", "part_start", "n_tokens", "token_ids"],
            )

    encoded = over_texts(placed.sortWithinPartitions(*order), encode, FILE_SCHEMA)
    (
        encoded.write.option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", stride).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01)
        .orc(f"{path}/tokens")
    )
    # one row per part, so the running sum is over a table as small as the list of files
    parts = spark.read.schema(FILE_SCHEMA).orc(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.orc(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, token_ids) of all documents, or of a few.

    Stripes are read in parallel. A list of ids is pushed to the files: stripes and row groups whose index or
    Bloom filter excludes them are not read.
    """
    rows = spark.read.schema(FILE_SCHEMA).orc(f"{path}/tokens")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin([int(i) for i in doc_ids]))
    # one row per file part: as many as the writing job had tasks
    starts = spark.read.orc(f"{path}/parts").select("part", "start")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "token_ids")


def with_crc(tokens: DataFrame, ids: str = "token_ids") -> DataFrame:
    """Replace the ids of each row by the crc32 of their little-endian unsigned 32-bit form."""
    names = [c for c in tokens.columns if c != ids]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(ids)
            raw, offsets = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), column.offsets.to_numpy()
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    kinds = dict(tokens.dtypes)
    return tokens.mapInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in names) + ", ids_crc32 long")
