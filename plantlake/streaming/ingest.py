"""Incremental ingestion: every new file once, appended to the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plantlake.functions.chunking import BUDGET
from plantlake.functions.text import basename, extension, file_kind
from plantlake.sources.collection import Collection
from plantlake.sources.corpus import TEXT_EXTENSIONS, document_chunks


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, file, kind, text) of files as they appear."""
    lines = (
        spark.readStream.format("text").schema("value string").option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
    )
    path = F.col("_metadata.file_path")
    named = lines.select(path.alias("path"), F.col("value").alias("text"))
    return named.select(
        "path", basename(F.col("path")).alias("file"), file_kind(F.col("path")).alias("kind"),
        F.when(extension(F.col("path")).isin(TEXT_EXTENSIONS), F.col("text")).alias("text"),
    )


def ingest_stream(
    spark: SparkSession, folder: str, collection: Collection, checkpoint: str, ingested_at: str, budget: int = BUDGET
) -> StreamingQuery:
    """Process what is there and stop; the checkpoint remembers the files, the chunk ids make a retry harmless."""

    def append(batch: DataFrame, _: int) -> None:
        collection.add(document_chunks(batch, ingested_at, budget))

    return (
        file_stream(spark, folder).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
