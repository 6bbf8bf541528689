"""Document, retrieval and trace queries over the given tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from plantlake.functions.chunking import heading_chunks, ingest_counts, non_empty, stamp_chunks, window_chunks
from plantlake.functions.embedding import embed_column, hashing_embedder
from plantlake.functions.text import (
    ANSWER, PREVIEW, basename, clean_code_argument, clean_markup, clean_model_output, cut, extension, file_kind, preview, strip_think,
)
from plantlake.functions.units import KeywordRule, convert, general_information, phrase_parts, phrase_results
from plantlake.operators.answers import answer_questions
from plantlake.operators.neighbours import exact_top_k
from plantlake.operators.trace import classify_steps, merge_pieces
from plantlake.operators.vector_index import VectorIndex, cell_top_k, hashed_top_k
from plantlake.ordered import WINDOW_ROWS
from plantlake.plans.views import PLANT_EVENTS_SQL, busy_table, plant_events, rounded, stamp, table, with_sql
from plantlake.session import scratch_path, settle
from plantlake.sources.collection import Collection, flatten_metadata
from plantlake.sources.corpus import document_chunks, image_chunks, processing_log, route, scan_files, skipped_log, unseen
from plantlake.streaming.ingest import ingest_stream

INGESTED = "2024-03-01 00:00:00"
BUDGET = 120


def doc_clean_markup(spark, folder):
    return busy_table(spark, folder, "pages", "page_id", "html").select("page_id", clean_markup(F.col("html")).alias("text"))


def doc_windows(spark, folder):
    out = window_chunks(busy_table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", 800, 100)
    return out.select("doc_id", "chunk_no", "text", "n_tokens")


def doc_windows_plain(spark, folder):
    out = window_chunks(busy_table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "chunk_no", F.md5("text").alias("digest"), "n_tokens")


def doc_heading_chunks(spark, folder):
    """Documents under two headings, language and source."""
    docs = busy_table(spark, folder, "documents", "doc_id", "lang", "source", "text").withColumn("text", F.concat(F.lit("# "), "lang", F.lit("\n## "), "source", F.lit("\n"), "text"))
    out = heading_chunks(docs, "doc_id", "text", BUDGET)
    return out.select("doc_id", "chunk_no", "text", "n_tokens", F.array_join("headings", " > ").alias("headings"))


def _files(spark, folder) -> DataFrame:
    """Documents as files of several kinds; names repeat over the folders, and some files are empty."""
    kinds = [".txt", ".MD", ".pdf", ".png", ".docx"]
    ext = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, folder, "documents").select(
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/part"), (F.col("doc_id") % 7).cast("string"), ext).alias("path"),
        F.lit(INGESTED).cast("timestamp").alias("modified"), "lang",
        F.encode(F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text")), "UTF-8").alias("content"),
    )


def doc_ingest_log(spark, folder):
    """Every English file was done before; the others are routed, chunked and logged."""
    raw = _files(spark, folder)
    files = route(raw)
    log = raw.where(F.col("lang") == "en").select("path", F.lit("ok").alias("status"))
    fresh = unseen(files, log)
    done = processing_log(fresh, document_chunks(fresh, INGESTED, BUDGET)).unionByName(skipped_log(files, log))
    counted = F.nullif(F.regexp_extract("details", r"^(\d+) chunks$", 1), F.lit("")).cast("long")
    return done.select("path", "file", "type", "status", counted.alias("n_chunks"))


def doc_stamps(spark, folder):
    docs = busy_table(spark, folder, "documents", "doc_id", "source", "text").withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    out = stamp_chunks(window_chunks(docs, "path", "text", 200), "path", "document", INGESTED)
    return out.select("chunk_id", "source", "type", "chunk_no", "n_tokens", stamp("ingested_at").alias("ingested_at"))


def doc_ingest_counts(spark, folder):
    lines = table(spark, folder, "documents").select("source", F.explode(F.split("text", "\n")).alias("text"))
    return ingest_counts(lines)


def doc_non_empty(spark, folder):
    lines = table(spark, folder, "documents").select("lang", F.explode(F.split("text", "\n")).alias("text"))
    return non_empty(lines).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


def doc_scan_files(spark, folder):
    """Documents written as text files per language and scanned back."""
    path = scratch_path(spark, "corpus")
    docs = table(spark, folder, "documents").select("text", "lang")
    docs.write.option("maxRecordsPerFile", 1000).partitionBy("lang").text(path)
    files = scan_files(spark, path, "*.txt")
    lang = F.regexp_extract("path", r"lang=([^/]+)/", 1)
    return files.where(F.col("kind") == "Doc").groupBy(lang.alias("lang")).agg(F.sum(F.length("text")).alias("n_chars"))


def doc_collection(spark, folder):
    """Chunks stored with their vectors, the same files added twice, counted per file; file names repeat over the folders."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/part"), (F.col("doc_id") % 7).cast("string"), F.lit(".txt"))
    docs = busy_table(spark, folder, "documents", "doc_id", "source", "text").withColumn("path", path)
    store = Collection(spark, scratch_path(spark, "collection"), hashing_embedder(64))
    for _ in range(2):
        store.add(stamp_chunks(window_chunks(docs, "path", "text"), "path", "document", INGESTED))
    return store.read().groupBy("path", "source").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))


def doc_stream(spark, folder):
    """Documents streamed in as new files, once and then again without anything new."""
    path = scratch_path(spark, "inbox")
    docs = table(spark, folder, "documents").select("text")
    docs.write.option("maxRecordsPerFile", 200).text(path)
    store = Collection(spark, scratch_path(spark, "streamed"), hashing_embedder(64))
    checkpoint = scratch_path(spark, "stream-state")
    for _ in range(2):
        ingest_stream(spark, path, store, checkpoint, INGESTED).awaitTermination()
    return store.read().agg(F.sum("n_tokens").alias("n_tokens"))


def doc_metadata(spark, folder):
    meta = F.to_json(F.struct(
        "source", "n_chars", (F.col("n_chars") > 500).alias("long"),
        F.array(F.col("lang"), F.lit(""), F.col("source")).alias("headings"), F.struct(F.col("lang").alias("code")).alias("origin"),
    ))
    out = table(spark, folder, "documents").select("doc_id", flatten_metadata(meta).alias("m"))
    return out.select("doc_id", F.explode("m").alias("key", "value"))


def doc_images(spark, folder):
    """Pages as descriptions of images."""
    pages = table(spark, folder, "pages").select(F.concat(F.lit("img/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"), F.col("html").alias("text"))
    return image_chunks(pages, INGESTED).select("source", "type", "image_file", "text")


PHRASES = {"click": " c to f", "error": "°F to celsius", "purchase": " bar", "signup": " kPa", "view": " psi"}


def doc_unit_phrases(spark, folder):
    tail = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])[F.col("event_type")]
    text = F.concat(F.col("k").cast("string"), F.lit(".5"), tail)
    parts = phrase_parts(text)
    e = plant_events(spark, folder).select("event_id", parts["rule"].alias("rule"), parts["amount"].alias("amount"), parts["unit"].alias("unit"))
    out = e.select("event_id", "rule", "unit", rounded("amount").alias("amount"), F.explode(phrase_results(F.col("amount"), F.col("unit"))).alias("_r"))
    return out.select("event_id", "rule", "amount", "unit", F.col("_r.unit").alias("to_unit"), rounded("_r.value").alias("to_value"))


def doc_context_labels(spark, folder):
    tail = F.create_map(*[F.lit(x) for kv in {"click": "00 °C in the furnace", "error": " MW now", "purchase": " mg/Nm³", "signup": " of -10 mbar", "view": " rpm"}.items() for x in kv])
    parts = phrase_parts(F.concat(F.lit("is "), F.col("k").cast("string"), tail[F.col("event_type")]))
    return plant_events(spark, folder).select("event_id", parts["rule"].alias("rule"), parts["label"].alias("label"))


TOPICS = [KeywordRule(("furnace", "temperature"), "heat"), KeywordRule(("furnace",), "furnace"), KeywordRule(("water", "use"), "supply")]


def doc_general_information(spark, folder):
    """Questions about events, answered from a table of the caller's rules."""
    head = F.create_map(*[F.lit(x) for kv in {"click": "Temperature of Furnace ", "error": "guards near the furnace ", "purchase": "furnace uses of water ",
                                              "signup": "power ", "view": "Uses of WATER "}.items() for x in kv])
    text = F.concat(head[F.col("event_type")], F.col("k").cast("string"))
    return plant_events(spark, folder).select("event_id", general_information(text, TOPICS).alias("answer"))


def doc_converted_readings(spark, folder):
    unit = F.create_map(*[F.lit(x) for kv in {"click": "bar", "error": "psi", "purchase": "mbar", "signup": "kPa", "view": "°C"}.items() for x in kv])[F.col("event_type")]
    e = table(spark, folder, "events").select("event_id", "value", unit.alias("unit"))
    return e.select("event_id", rounded(convert(F.col("value"), F.col("unit"), "kPa")).alias("kpa"), rounded(convert(F.col("value"), F.col("unit"), "°F")).alias("fahrenheit"))


def doc_previews(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", preview(t, PREVIEW).alias("preview"), F.length(cut(t, ANSWER)).alias("shown"))


def doc_think_markers(spark, folder):
    text = F.concat(F.lit(" <think>"), F.lit("plan"), F.lit("</think>\n"), "text", F.lit(" \n"))
    return table(spark, folder, "conversations").select("conv_id", "turn", strip_think(text).alias("text"))


def doc_trace_clean(spark, folder):
    c = table(spark, folder, "conversations")
    code = F.concat(F.lit("```python\n"), "text", F.lit("\n```"))
    said = F.concat("text", F.lit("\n```\n <end_code>"))
    return c.select("conv_id", "turn", F.md5(clean_code_argument(code)).alias("code"), F.md5(clean_model_output(said)).alias("said"))


def doc_steps(spark, folder):
    """Turns as trace steps: users observe, some of them a plot; assistants think; systems plan."""
    c = table(spark, folder, "conversations")
    part = F.when(F.col("role") == "user", "observation").when(F.col("role") == "assistant", "model_output").otherwise("plan")
    plot = F.when((F.col("role") == "user") & (F.col("turn") > 0), F.concat(F.lit(" saved to results/plots/p"), F.col("conv_id").cast("string"), F.lit(".html ok"))).otherwise(F.lit(""))
    out = classify_steps(c.withColumn("part", part).withColumn("text", F.concat("text", plot)))
    return out.groupBy("message_type", "path").agg(F.count(F.lit(1)).alias("n"))


_PARTS = ["model_output", "tool_call", "observation", "error", "plan", "final_answer", "final_image", "final_audio"]


def doc_step_kinds(spark, folder):
    """Turns dealt over all parts that a trace can have, one row per step that is kept."""
    c = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    part = F.element_at(F.array(*map(F.lit, _PARTS)), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(8)) + 1).cast("int"))
    name, code = F.col("conv_id").cast("string"), F.concat(F.lit("```python\n"), "text", F.lit("\n```"))
    text = (F.when(F.col("part") == "tool_call", code).when(F.col("part") == "final_image", F.concat(F.lit("/out/"), name, F.lit(".JPEG")))
            .when(F.col("part") == "final_audio", F.concat(F.lit("say"), name, F.lit(".wav"))).otherwise(F.col("text")))
    rows = c.withColumn("part", part).withColumn("text", text).withColumn("tool_name", F.lit("python_interpreter"))
    plain = ~F.col("message_type").isin("thought", "tool_result")
    return classify_steps(rows).select("conv_id", "turn", "message_type", "path", "mime_type", F.when(plain, F.md5("content")).alias("digest"))


def doc_paths(spark, folder):
    p = table(spark, folder, "pages").select("page_id", F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit("/Report.v2.PNG")).alias("path"))
    return p.select("page_id", basename(F.col("path")).alias("file"), extension(F.col("path")).alias("ext"), file_kind(F.col("path")).alias("kind"))


def _merged(window_rows: int):
    def run(spark, folder):
        c = table(spark, folder, "conversations")
        out = merge_pieces(c, ["conv_id"], ["turn"], "text", F.col("role") != "system", window_rows)
        return out.select("conv_id", "turn", "n_pieces", "is_piece", F.md5("text").alias("digest"))

    return run


def _questions(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding")


def _vectors(spark, folder) -> DataFrame:
    return busy_table(spark, folder, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("question_id", "rank", "chunk_id", rounded("distance", 6).alias("distance"))


def _exact(metric: str):
    def run(spark, folder):
        return _shown(exact_top_k(_questions(spark, folder), _vectors(spark, folder), 3, metric))

    return run


def doc_top_k_blocks(spark, folder):
    """The block-by-block way, as for more questions than fit a broadcast."""
    return _shown(exact_top_k(_questions(spark, folder), _vectors(spark, folder), 3, "l2", max_bytes=0))


def doc_top_k_hashed(spark, folder):
    return _shown(hashed_top_k(_questions(spark, folder), _vectors(spark, folder), 3))


def doc_top_k_cells(spark, folder):
    return _shown(cell_top_k(_questions(spark, folder), _vectors(spark, folder), 3))


def doc_top_k_all_cells(spark, folder):
    return _shown(cell_top_k(_questions(spark, folder), _vectors(spark, folder), 3, cells=16, probes=16))


def _recalled(kind: str, metric: str):
    """Every vector asks a stored index: what it finds, and whether the share of true neighbours among it all is 0.9 or more."""

    def run(spark, folder):
        questions, chunks = _questions(spark, folder), _vectors(spark, folder)
        index = VectorIndex.build(chunks, scratch_path(spark, "index"), kind, metric)
        found = settle(index.search(questions, 3), "found")
        true = exact_top_k(questions, chunks, 3, metric).select("question_id", "chunk_id", F.lit(1).alias("hit"))
        recall = found.join(true, ["question_id", "chunk_id"], "left").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)) >= 0.9).alias("recall_ok"))
        per = found.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_found"), F.min_by("chunk_id", "rank").alias("nearest"), F.round(F.min("distance"), 6).alias("distance"))
        return per.join(F.broadcast(recall)).select("question_id", "n_found", "nearest", (F.col("distance") + 0.0).alias("distance"), "recall_ok")

    return run


def doc_embed(spark, folder):
    """Hashed vectors of whole documents: their length and how many words they stand for."""
    out = embed_column(busy_table(spark, folder, "documents", "doc_id", "text"), "text", hashing_embedder(64))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return out.select("doc_id", F.size("embedding").alias("width"), F.round(square, 4).alias("square"))


def _answered(spark, folder, docs: DataFrame) -> DataFrame:
    chunks = docs.select(
        F.col("doc_id").alias("chunk_id"), "embedding", "text", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"),
        F.when(F.col("doc_id") % 7 == 0, "image_description").otherwise("document").alias("type"),
        F.concat(F.lit("picture"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image_file"),
    )
    questions = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("question_id"), F.concat(F.lit("What belongs to label "), F.col("label").cast("string"), F.lit("?")).alias("query"), "embedding")
    out = answer_questions(questions, chunks)
    return out.select("question_id", "query", F.md5("prompt").alias("prompt"), F.size("sources").alias("n_sources"), "cited", "error")


def doc_answers(spark, folder):
    """Every vector asks for its nearest documents among those that have a vector."""
    return _answered(spark, folder, table(spark, folder, "documents").join(_vectors(spark, folder).withColumnRenamed("chunk_id", "doc_id"), "doc_id"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _letter_counts(texts: pd.Series) -> pd.Series:
    """How often each of the letters a to z occurs, and zeros up to 64; one pass over the bytes of a text."""
    out = []
    for i in range(0, len(texts), 512):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts[i : i + 512]]
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        byte = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        small = (byte >= 97) & (byte < 123)
        out += list(np.bincount(row[small] * 64 + byte[small] - 97, minlength=64 * len(parts)).reshape(-1, 64).astype(float))
    return pd.Series(out, dtype=object)


def _letter_vector(text):
    """A vector of the caller's own making: how often each small letter occurs, of length one."""
    # an array of one holds the counts and their length, so that both are worked out once
    sized = F.transform(F.array(_letter_counts(text)), lambda c: F.struct(c.alias("counts"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x)).alias("size")))
    return F.element_at(F.transform(sized, lambda s: F.transform(s["counts"], lambda x: F.when(s["size"] > 0, x / s["size"]).otherwise(0.0))), 1)


def doc_answers_all(spark, folder):
    """Every vector asks all documents; those without a stored vector are embedded by the caller's own function."""
    vectors = _vectors(spark, folder).select(F.col("chunk_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("stored"))
    docs = table(spark, folder, "documents").join(vectors, "doc_id", "left")
    return _answered(spark, folder, embed_column(docs, "text", _letter_vector).withColumn("embedding", F.coalesce("stored", "embedding")))


def doc_answers_text(spark, folder):
    """Benchmark passages ask the chunks of all documents, both embedded by the default function."""
    docs = busy_table(spark, folder, "documents", "doc_id", "source", "text").withColumn("path", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    chunks = stamp_chunks(window_chunks(docs, "path", "text", 200), "path", "document", INGESTED)
    questions = table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))
    out = answer_questions(questions, chunks, metric="cosine")
    return out.select("question_id", F.size("sources").alias("n_sources"), "cited", "error")


QUERIES = {
    "doc_index_cells": _recalled("cells", "l2"), "doc_index_cells_cosine": _recalled("cells", "cosine"), "doc_index_hashes": _recalled("hashes", "l2"),
    "doc_merge_pieces": _merged(WINDOW_ROWS),
    "doc_merge_pieces_chunked": _merged(0),
    **{f"doc_top_k_{m}": _exact(m) for m in ["l2", "cosine", "dot"]},
    **{f.__name__: f for f in [
        doc_clean_markup, doc_windows, doc_windows_plain, doc_heading_chunks, doc_ingest_log, doc_stamps, doc_ingest_counts, doc_non_empty,
        doc_scan_files, doc_collection, doc_stream, doc_metadata, doc_images, doc_unit_phrases, doc_context_labels, doc_general_information,
        doc_converted_readings, doc_previews, doc_think_markers, doc_trace_clean, doc_steps, doc_step_kinds, doc_paths, doc_top_k_blocks,
        doc_top_k_hashed, doc_top_k_cells, doc_top_k_all_cells, doc_embed, doc_answers, doc_answers_all, doc_answers_text,
    ]},
}

_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CLEAN = rf"""trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{_SPACE}+', ' ', 'g')),
'\*\*\s*\*\*', '', 'g'), '__\s*__', '', 'g'))"""
_BLANK = r"[ \t\n\r\f\x0B]+"


def _words(text: str) -> str:
    return f"list_filter(str_split_regex({text}, '{_BLANK}'), lambda x: x <> '')"


def _windows_sql(size: int, overlap: int, docs: str = "documents", key: str = "doc_id") -> str:
    return f"""w AS (SELECT {key}, {_words('text')} AS t FROM {docs}),
x AS (SELECT {key}, t, unnest(range(0, greatest(len(t) - 1 - {overlap}, 0) + 1, {size - overlap})) AS s FROM w WHERE len(t) > 0),
c AS (SELECT {key}, CAST(s / {size - overlap} AS INTEGER) AS chunk_no, array_to_string(t[s + 1:s + {size}], ' ') AS text,
  CAST(len(t[s + 1:s + {size}]) AS INTEGER) AS n_tokens FROM x)"""


def _packed_sql(budget: int, docs: str = "documents", key: str = "doc_id") -> str:
    return f"""l AS (SELECT {key}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs}),
w AS (SELECT {key}, i, line, {_words('line')} AS t FROM l),
pc AS (SELECT {key}, i, 0 AS j, line AS text, len(t) AS n FROM w WHERE len(t) BETWEEN 1 AND {budget} UNION ALL
  SELECT {key}, i, s, array_to_string(t[s + 1:s + {budget}], ' '), len(t[s + 1:s + {budget}]) FROM (SELECT *, unnest(range(0, len(t), {budget})) AS s FROM w WHERE len(t) > {budget})),
o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i, j) AS r FROM pc),
g AS (SELECT {key}, r, n AS filled, 0 AS c FROM o WHERE r = 1 UNION ALL
  SELECT o.{key}, o.r, CASE WHEN g.filled + o.n > {budget} THEN o.n ELSE g.filled + o.n END, CASE WHEN g.filled + o.n > {budget} THEN g.c + 1 ELSE g.c END
  FROM g JOIN o ON o.{key} = g.{key} AND o.r = g.r + 1)"""


def _top_sql(distance: str, corpus: str = "embeddings") -> str:
    return f"""t AS (SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, round({distance}, 12) AS d FROM embeddings q, {corpus} c),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d, chunk_id) AS r FROM t QUALIFY r <= 3)"""


_VEC = "CAST({0}.embedding AS DOUBLE[])"
_L2 = f"list_distance({_VEC.format('q')}, {_VEC.format('c')}) ** 2"
_COS = f"1 - list_cosine_similarity({_VEC.format('q')}, {_VEC.format('c')})"
_DOT = f"-list_inner_product({_VEC.format('q')}, {_VEC.format('c')})"


def _ranked_sql(distance: str) -> str:
    return with_sql(_top_sql(distance)) + "SELECT question_id, CAST(r AS INTEGER) AS rank, chunk_id, round(3e-9 + d, 6) + 0.0 AS distance FROM k"


def _recalled_sql(distance: str) -> str:
    """The nearest of each vector and how many rows it gets; the index has to find enough of the others."""
    return with_sql(_top_sql(distance)) + """SELECT question_id, count(*) AS n_found, min_by(chunk_id, r) AS nearest, round(min(d), 6) + 0.0 AS distance, true AS recall_ok
FROM k GROUP BY question_id"""


_EXT = "(['.txt', '.MD', '.pdf', '.png', '.docx'])[doc_id % 5 + 1]"
_ENDS = rf"'^{_SPACE}+|{_SPACE}+$'"
_PATHED = "d AS (SELECT source || '/' || doc_id || '.txt' AS path, text FROM documents)"

_ANSWERED_SQL = """, s AS (SELECT k.*, text,
  CASE WHEN chunk_id % 7 = 0 THEN 'Img' ELSE 'Doc' END AS l, CASE WHEN chunk_id % 7 = 0 THEN 'picture' || chunk_id || '.png' ELSE chunk_id || '.txt' END AS f
  FROM k JOIN documents ON chunk_id = doc_id)
SELECT question_id, any_value('What belongs to label ' || label || '?') AS query,
md5(string_agg(text, chr(10) || chr(10) ORDER BY r) || chr(10) || chr(10) || 'Question: What belongs to label ' || any_value(label) || '?') AS prompt,
CAST(count(*) AS INTEGER) AS n_sources,
string_agg('- ' || l || ' *' || f || '* (match ' || r || '): _' || substr(text, 1, 70) || '..._', chr(10) ORDER BY r) FILTER (r <= 2) AS cited, NULL AS error
FROM s JOIN embeddings ON question_id = vec_id GROUP BY question_id"""
_ALL_DOCS_SQL = """l AS (SELECT doc_id, list_transform(range(97, 161), lambda i: CASE WHEN i < 123 THEN length(text) - length(replace(text, chr(i::INTEGER), '')) ELSE 0 END::DOUBLE) AS v FROM documents),
u AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM l),
docs AS (SELECT doc_id AS vec_id, coalesce(CAST(e.embedding AS DOUBLE[]), list_transform(v, lambda x: CASE WHEN size > 0 THEN x / size ELSE 0 END)) AS embedding
  FROM u LEFT JOIN embeddings e ON doc_id = e.vec_id)"""

ORACLES = {
    "doc_top_k_l2": _ranked_sql(_L2),
    "doc_top_k_cosine": _ranked_sql(_COS),
    "doc_top_k_dot": _ranked_sql(_DOT),
    "doc_top_k_blocks": _ranked_sql(_L2),
    "doc_top_k_all_cells": _ranked_sql(_L2),
    "doc_index_cells": _recalled_sql(_L2), "doc_index_cells_cosine": _recalled_sql(_COS), "doc_index_hashes": _recalled_sql(_L2),
    "doc_clean_markup": f"SELECT page_id, {_CLEAN} AS text FROM pages",
    "doc_windows": with_sql(_windows_sql(800, 100)) + "SELECT doc_id, chunk_no, text, n_tokens FROM c",
    "doc_windows_plain": with_sql(_windows_sql(800, 0)) + "SELECT doc_id, chunk_no, md5(text) AS digest, n_tokens FROM c",
    "doc_heading_chunks": "WITH RECURSIVE " + _packed_sql(BUDGET) + """ SELECT doc_id, c AS chunk_no, string_agg(text, chr(10) ORDER BY r) AS text, CAST(sum(n) AS INTEGER) AS n_tokens,
any_value(lang || ' > ' || source) AS headings FROM g JOIN o USING (doc_id, r) JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id) GROUP BY 1, 2""",
    "doc_ingest_log": "WITH RECURSIVE " + _packed_sql(BUDGET, "(SELECT doc_id, text FROM documents WHERE lang <> 'en' AND doc_id % 5 < 2 AND doc_id % 11 <> 0)") + f""",
n AS (SELECT doc_id, max(c) + 1 AS n FROM g GROUP BY 1), f AS (SELECT *, '/corpus/' || source || '/' || doc_id || '/part' || doc_id % 7 || {_EXT} AS path, 'part' || doc_id % 7 || {_EXT} AS file, doc_id % 5 AS k FROM documents)
SELECT path, file, CASE WHEN lang = 'en' THEN 'N/A (Skipped)' WHEN k < 3 THEN 'Doc' WHEN k = 3 THEN 'Img' ELSE 'Unknown' END AS type,
CASE WHEN lang = 'en' THEN 'skipped' WHEN k = 4 THEN 'unsupported' WHEN n.n > 0 THEN 'ok' ELSE 'failed' END AS status,
CASE WHEN lang <> 'en' THEN n.n END AS n_chunks FROM f LEFT JOIN n USING (doc_id)""",
    "doc_stamps": with_sql(_PATHED, _windows_sql(200, 0, "d", "path")) + """SELECT sha256(path || chr(1) || chunk_no || chr(1) || text) AS chunk_id,
string_split(path, '/')[-1] AS source, 'document' AS type, chunk_no, n_tokens, '2024-03-01 00:00:00' AS ingested_at FROM c""",
    "doc_ingest_counts": """SELECT source, count(*) FILTER (length(l) > 0) AS n_chunks, count(*) FILTER (length(l) = 0) AS n_skipped
FROM (SELECT source, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1""",
    "doc_non_empty": """SELECT lang, count(*) AS n, CAST(sum(length(l)) AS BIGINT) AS n_chars FROM (SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents)
WHERE length(l) > 0 GROUP BY 1""",
    "doc_scan_files": "SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY 1",
    "doc_collection": with_sql(_PATHED.replace("'.txt'", "'/part' || doc_id % 7 || '.txt'"), _windows_sql(800, 0, "d", "path")) + "SELECT path, string_split(path, '/')[-1] AS source, count(*) AS n_chunks, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM c GROUP BY 1, 2",
    "doc_stream": f"SELECT CAST(sum(len({_words('text')})) AS BIGINT) AS n_tokens FROM documents",
    "doc_metadata": """SELECT doc_id, 'source' AS key, source AS value FROM documents UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents
UNION ALL SELECT doc_id, 'long', CASE WHEN n_chars > 500 THEN 'true' ELSE 'false' END FROM documents UNION ALL SELECT doc_id, 'headings', lang || ' > ' || source FROM documents""",
    "doc_images": f"""SELECT page_id || '.png' AS source, 'image_description' AS type, page_id || '.png' AS image_file, t AS text
FROM (SELECT page_id, {_CLEAN} AS t FROM pages) WHERE t <> ''""",
    "doc_unit_phrases": with_sql(PLANT_EVENTS_SQL, "a AS (SELECT event_id, event_type, k + 0.5::DOUBLE AS v FROM pe)") + " UNION ALL ".join(
        f"""SELECT event_id, '{rule}' AS rule, round(3e-9 + v, 4) + 0.0 AS amount, '{unit}' AS unit, '{to}' AS to_unit, round(3e-9 + {e}, 4) + 0.0 AS to_value FROM a WHERE event_type = '{kind}'"""
        for kind, rule, unit, to, e in [
            ("click", "temperature", "°C", "°F", "v * 9 / 5 + 32"), ("error", "temperature", "°F", "°C", "(v - 32) * 5 / 9"),
            ("purchase", "pressure", "bar", "kPa", "v * 100"), ("purchase", "pressure", "bar", "psi", "v * 14.5"),
            ("signup", "pressure", "kpa", "bar", "v / 100"), ("signup", "pressure", "kpa", "psi", "v * 0.145"),
            ("view", "pressure", "psi", "bar", "v / 14.5"), ("view", "pressure", "psi", "kPa", "v * 6.89")]),
    "doc_context_labels": with_sql(PLANT_EVENTS_SQL, """t AS (SELECT event_id, 'is ' || k || CASE event_type WHEN 'click' THEN '00 °c in the furnace' WHEN 'error' THEN ' mw now'
  WHEN 'purchase' THEN ' mg/nm³' WHEN 'signup' THEN ' of -10 mbar' ELSE ' rpm' END AS q, event_type FROM pe)""")
    + """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'pressure' WHEN l IS NOT NULL THEN 'context' ELSE 'none' END AS rule, CASE WHEN event_type <> 'signup' THEN l END AS label
FROM (SELECT *, CASE WHEN contains(q, '1600') AND contains(q, '°c') THEN '1600°C very high, EAF smelting.' WHEN contains(q, '35') AND contains(q, 'mw') THEN '35MW high power, EAFs.'
WHEN contains(q, '-10') AND contains(q, 'mbar') THEN '-10mbar slight vacuum, furnace extraction.' WHEN contains(q, '10') AND contains(q, 'mg/nm') THEN '10mg/Nm³ emission limit particulates.' END AS l FROM t)""",
    "doc_general_information": with_sql(PLANT_EVENTS_SQL) + """SELECT event_id, CASE event_type WHEN 'click' THEN 'heat' WHEN 'error' THEN 'furnace'
WHEN 'purchase' THEN 'furnace' WHEN 'view' THEN 'supply' END AS answer FROM pe""",
    "doc_converted_readings": """SELECT event_id, round(3e-9 + CASE event_type WHEN 'click' THEN value * 100 WHEN 'error' THEN value * 6.89 WHEN 'purchase' THEN value / 10
WHEN 'signup' THEN value END, 4) + 0.0 AS kpa, round(3e-9 + CASE event_type WHEN 'view' THEN value * 9 / 5 + 32 END, 4) + 0.0 AS fahrenheit FROM events""",
    "doc_previews": "SELECT doc_id, substr(text, 1, 70) || '...' AS preview, CAST(least(length(text), 1000) AS INTEGER) AS shown FROM documents",
    "doc_think_markers": f"SELECT conv_id, turn, regexp_replace('plan' || chr(10) || text || ' ' || chr(10), {_ENDS}, '', 'g') AS text FROM conversations",
    "doc_trace_clean": f"""SELECT conv_id, turn, md5(text) AS code, md5(regexp_replace(text || chr(10) || '```', {_ENDS}, '', 'g')) AS said FROM conversations""",
    "doc_steps": """SELECT message_type, path, count(*) AS n FROM (SELECT CASE WHEN role = 'assistant' THEN 'thought' WHEN role = 'system' THEN 'plan'
WHEN turn > 0 THEN 'tool_result_plot' ELSE 'tool_result' END AS message_type, CASE WHEN role = 'user' AND turn > 0 THEN 'results/plots/p' || conv_id || '.html' END AS path FROM conversations
WHERE trim(text) <> '' OR (role = 'user' AND turn > 0)) GROUP BY 1, 2""",
    "doc_step_kinds": """WITH t AS (SELECT conv_id, turn, ((conv_id * 7 + turn) % 8 + 8) % 8 AS k, text FROM conversations),
s AS (SELECT conv_id, turn, k, (['thought', 'tool_call', 'tool_result', 'error', 'plan', 'final_answer', 'final_answer_file', 'final_answer_file'])[k + 1] AS message_type,
CASE k WHEN 1 THEN '```python' || chr(10) || text || chr(10) || '```' WHEN 6 THEN '/out/' || conv_id || '.JPEG' WHEN 7 THEN 'say' || conv_id || '.wav' ELSE text END AS content FROM t)
SELECT conv_id, turn, message_type, CASE WHEN k >= 6 THEN content END AS path, CASE k WHEN 6 THEN 'image/jpeg' WHEN 7 THEN 'audio/wav' END AS mime_type,
CASE WHEN k NOT IN (0, 2) THEN md5(content) END AS digest FROM s WHERE trim(content) <> '' OR k IN (1, 3)""",
    "doc_paths": "SELECT page_id, 'Report.v2.PNG' AS file, '.png' AS ext, 'Img' AS kind FROM pages",
    "doc_merge_pieces": """WITH b AS (SELECT *, role <> 'system' AS p, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations)
SELECT conv_id, min(turn) AS turn, count(*) AS n_pieces, p AS is_piece, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM b GROUP BY conv_id, run, p""",
    "doc_merge_pieces_chunked": """WITH b AS (SELECT *, role <> 'system' AS p, sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations)
SELECT conv_id, min(turn) AS turn, count(*) AS n_pieces, p AS is_piece, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM b GROUP BY conv_id, run, p""",
    "doc_embed": """SELECT doc_id, 64 AS width, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS square FROM documents""",
    "doc_answers": with_sql("docs AS (SELECT vec_id, embedding FROM embeddings SEMI JOIN documents ON vec_id = doc_id)", _top_sql(_L2, "docs")) + _ANSWERED_SQL,
    "doc_answers_all": with_sql(_ALL_DOCS_SQL, _top_sql(_L2, "docs")) + _ANSWERED_SQL,
}
