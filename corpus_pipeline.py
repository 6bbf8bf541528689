"""Corpus pipeline: toxic documents go, near-duplicates go, secrets are masked, sources are mixed, sequences are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
import public_tokenizers

from plantlake.llm.jaccard import one_of_each
from plantlake.llm.mixing import take_words
from plantlake.llm.packing import pack
from plantlake.llm.secrets import redact, train_secret_model
from plantlake.llm.toxicity import score_texts, train_toxic_model
from plantlake.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    model = train_toxic_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, model, "_toxicity").where(F.col("_toxicity") < 0.5).drop("_toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return one_of_each(docs, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the scan finds is masked in the text; no document goes."""
    return redact(docs, train_secret_model(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at the cut keeps its first words."""
    return take_words(docs, [3, 1, 2], share=1.5, most=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]
# decoding, fitted models and the tokenizer have no SQL form; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
