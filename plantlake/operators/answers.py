"""Batch question answering up to the prompt: nearest chunks, context, cited sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantlake.functions.embedding import Embedder, embed_column
from plantlake.functions.text import PREVIEW, basename, preview
from plantlake.joins import fits_broadcast, join_hot
from plantlake.operators.neighbours import K, exact_top_k
from plantlake.operators.vector_index import cell_top_k, hashed_top_k
from plantlake.session import settle

INDEXES = ("exact", "lsh", "ivf")
CITED = 2
NO_DOCUMENTS = "no documents in the collection"


def nearest_chunks(questions: DataFrame, chunks: DataFrame, k: int = K, index: str = "exact", metric: str = "l2", **options) -> DataFrame:
    if index == "exact":
        return exact_top_k(questions, chunks, k, metric, **options)
    if index not in INDEXES:
        raise ValueError(f"index must be one of {INDEXES}")
    return (hashed_top_k if index == "lsh" else cell_top_k)(questions, chunks, k, metric, **options)


def source_label(kind: Column) -> Column:
    return F.when(kind == "image_description", "Img").otherwise("Doc")


def source_line(rank: Column, label: Column, name: Column, shown: Column) -> Column:
    return F.concat(F.lit("- "), label, F.lit(" *"), name, F.lit("* (match "), rank.cast("string"), F.lit("): _"), shown, F.lit("_"))


def answer_questions(
    questions: DataFrame, chunks: DataFrame, k: int = K, index: str = "exact", metric: str = "l2",
    embedder: Embedder | None = None, cited: int = CITED, **options,
) -> DataFrame:
    """(question_id, query, context, prompt, sources, cited, error) for every question.

    ``questions(question_id, query[, embedding])`` and ``chunks(chunk_id, text, source[, type,
    image_file, embedding])``; missing vectors are made with ``embedder``. Writing the answer itself
    is the caller's, from ``prompt``.
    """
    if "embedding" not in questions.columns:
        questions = embed_column(questions, "query", embedder)
    if "embedding" not in chunks.columns:
        chunks = embed_column(chunks, "text", embedder)
    filled = chunks.where(F.length("text") > 0)
    best = settle(nearest_chunks(questions, filled, k, index, metric, **options), "best")
    kind = F.col("type") if "type" in chunks.columns else F.lit("document")
    label, file = source_label(kind), basename(F.coalesce(F.col("source").cast("string"), F.lit("?")))
    name = F.when(label == "Img", F.coalesce(F.col("image_file"), file)).otherwise(file) if "image_file" in chunks.columns else file
    facts = filled.select("chunk_id", "text", label.alias("label"), name.alias("name"))
    # a few chunks may answer most questions: few answers travel, many are joined by hot chunk
    if fits_broadcast(best):
        found = facts.join(F.broadcast(best), "chunk_id")
    else:
        found = join_hot(best, facts, ["chunk_id"], "inner")
    shown = preview(F.col("text"), PREVIEW)
    item = F.struct(
        "rank", "chunk_id", "label", "name", shown.alias("preview"), "distance",
        source_line(F.col("rank"), F.col("label"), F.col("name"), shown).alias("line"), "text",
    )
    per = found.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("_s"))
    out = questions.select("question_id", "query").join(per, "question_id", "left")
    context = F.array_join(F.transform("_s", lambda s: s["text"]), "\n\n")
    return out.select(
        "question_id", "query",
        context.alias("context"),
        F.concat(context, F.lit("\n\nQuestion: "), F.col("query")).alias("prompt"),
        F.transform("_s", lambda s: s.dropFields("text", "line")).alias("sources"),
        F.array_join(F.transform(F.slice("_s", 1, cited), lambda s: s["line"]), "\n").alias("cited"),
        F.when(F.col("_s").isNull(), NO_DOCUMENTS).alias("error"),
    )
