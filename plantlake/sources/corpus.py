"""Document files: scan and routing by kind, skipping of known files, processing log."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantlake.functions.chunking import BUDGET, heading_chunks, stamp_chunks
from plantlake.functions.text import basename, clean_markup, error_details, extension, file_kind
from plantlake.joins import fits_broadcast
from plantlake.session import settle

# fixed values: status words of the processing log, and the note of a skipped file
OK, FAILED, UNSUPPORTED, SKIPPED = "ok", "failed", "unsupported", "skipped"
ALREADY = "Already processed in this session"
# extensions whose bytes are text
TEXT_EXTENSIONS = [".csv", ".txt", ".md"]


# paths that one reader is given
PATHS = 10_000


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, file, kind, ext, modified, length) of every file; no file is opened.

    Spark's file sources pass over files of zero bytes, so those give no row.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _named(reader.load(path), F.col("modificationTime").alias("modified"), "length")


def read_texts(files: DataFrame) -> DataFrame:
    """``files`` with a text column, null for kinds that are not plain text: only the bytes of text files are read.

    The paths of the files to read are given to the reader, as Spark's own list of files has them.
    """
    spark = files.sparkSession
    wanted = files.where(F.col("ext").isin(TEXT_EXTENSIONS)).select("path")
    parts, paths = [], []
    for row in wanted.toLocalIterator():
        paths.append(row["path"])
        if len(paths) == PATHS:
            parts.append(paths)
            paths = []
    contents = [
        spark.read.format("binaryFile").load([_escaped(p) for p in part]).select("path", F.decode("content", "UTF-8").alias("text"))
        for part in [*parts, paths] if part
    ]
    if not contents:
        return files.withColumn("text", F.lit(None).cast("string"))
    others = files.where(~F.coalesce(F.col("ext").isin(TEXT_EXTENSIONS), F.lit(False))).withColumn("text", F.lit(None).cast("string"))
    # what is known of the files is small beside their texts
    facts = F.broadcast(files) if fits_broadcast(files) else files
    return functools.reduce(DataFrame.unionByName, contents).join(facts, "path").select(*files.columns, "text").unionByName(others)


def _escaped(path: str) -> str:
    """A path whose signs are not taken for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def scan_files(spark: SparkSession, path: str, glob: str | None = None, log: DataFrame | None = None) -> DataFrame:
    """(path, file, kind, ext, modified, text) of every file, or of those that ``log`` does not have as done.

    Files are listed first; text is null for kinds that are not plain text, whose bytes are not read, and the contents of files that
    were done before are not read either.
    """
    files = list_files(spark, path, glob)
    if log is not None:
        files = unseen(files, log)
    return read_texts(settle(files.drop("length"), "files"))


def route(files: DataFrame) -> DataFrame:
    """Kind by lower-cased extension; ``files(path, modified, content)``."""
    text = F.when(extension(F.col("path")).isin(TEXT_EXTENSIONS), F.decode("content", "UTF-8"))
    return _named(files, "modified", text.alias("text"))


def _named(files: DataFrame, *more: str | Column) -> DataFrame:
    path = F.col("path")
    return files.select("path", basename(path).alias("file"), file_kind(path).alias("kind"), extension(path).alias("ext"), *more)


def unseen(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files without a successful entry in the log; a failed file comes again."""
    return files.join(_done(log), "path", "left_anti")


def _done(log: DataFrame) -> DataFrame:
    """Paths already processed; broadcast while they are few, so that file contents are not shuffled."""
    done = settle(log.where(F.col("status") == OK).select("path").distinct(), "done")
    return F.broadcast(done) if fits_broadcast(done) else done


def skipped_log(files: DataFrame, log: DataFrame) -> DataFrame:
    return files.select("path", "file").join(_done(log), "path", "left_semi").select(
        "path", "file", F.lit("N/A (Skipped)").alias("type"), F.lit(SKIPPED).alias("status"), F.lit(ALREADY).alias("details")
    )


def document_chunks(files: DataFrame, ingested_at: str, budget: int = BUDGET) -> DataFrame:
    """Chunks of the text documents, with headings and metadata stamps."""
    docs = files.where((F.col("kind") == "Doc") & F.col("text").isNotNull()).select("path", "text")
    return stamp_chunks(heading_chunks(docs, "path", "text", budget), "path", "document", ingested_at)


def image_chunks(descriptions: DataFrame, ingested_at: str, model: str = "external") -> DataFrame:
    """Image descriptions that came from elsewhere as text: ``descriptions(path, text)``.

    An image without a description gives no chunk, so the processing log shows it as failed.
    """
    cleaned = descriptions.withColumn("text", clean_markup(F.col("text")))
    name = basename(F.col("path"))
    described = cleaned.where(F.length("text") > 0)
    one = described.select("path", F.lit(0).alias("chunk_no"), "text", name.alias("image_file"), F.lit(model).alias("vision_model"))
    return stamp_chunks(one, "path", "image_description", ingested_at)


def processing_log(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per file: type, status and details (number of chunks, or what went wrong); files are told apart by path."""
    counts = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    seen = files.select("path", "file", "kind", "ext", F.col("text").isNotNull().alias("_readable"))
    joined = seen.join(counts, "path", "left")
    n = F.coalesce("_n", F.lit(0))
    status = (
        F.when(F.col("kind").isNull(), UNSUPPORTED).when(n > 0, OK).otherwise(FAILED)
    )
    reason = F.when(F.col("kind") == "Img", "no description given for the image").when(
        ~F.col("_readable"), "no text extractor for this format"
    ).otherwise("file empty or without content")
    details = (
        F.when(F.col("kind").isNull(), F.format_string("Unsupported type (%s)", "ext"))
        .when((n > 0) & (F.col("kind") == "Img"), "Description OK")
        .when(n > 0, F.format_string("%d chunks", n)).otherwise(error_details(reason))
    )
    return joined.select("path", "file", F.coalesce("kind", F.lit("Unknown")).alias("type"), status.alias("status"), details.alias("details"))
