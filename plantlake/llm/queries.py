"""Registered queries of the subpackage: one per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plantlake.llm import hmm
from plantlake.llm.collocations import collocations
from plantlake.llm.common import crc_fold, table
from plantlake.llm.fim import fill_in_middle, restored
from plantlake.llm.jaccard import near_duplicates
from plantlake.llm.language import predict_language, train_language_model
from plantlake.llm.mixing import mix
from plantlake.llm.neighbour_graph import nearest
from plantlake.llm.packing import pack
from plantlake.llm.range_join import range_join
from plantlake.llm.repeats import remove_repeats
from plantlake.llm.secrets import find_secrets, spans_text, train_secret_model
from plantlake.llm.token_files import read_token_files, with_crc, write_token_files
from plantlake.llm.toxicity import score_texts, train_toxic_model
from plantlake.session import scratch_path


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train_toxic_model(docs, table(spark, folder, "labels"))
    return score_texts(docs, model).select(
        "doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return with_crc(read_token_files(spark, path))


def op3_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = hmm.score_texts(docs, crc_fold(F.col("doc_id"), 5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = find_secrets(docs, train_secret_model(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )


def op5_range_join(spark: SparkSession, folder: str) -> DataFrame:
    return range_join(table(spark, folder, "embeddings"), least=0.9)


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), [3, 1, 2], share=1.5, most=2).select("doc_id", "size", "source_size", "target", "taken")


def op7_neighbour_graph(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), percent=80)


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = remove_repeats(table(spark, folder, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    found = predict_language(docs.select("doc_id", "text"), train_language_model(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


QUERIES = {q.__name__: q for q in [op1_toxicity, op2_token_files, op3_hidden_markov, op4_secrets, op5_range_join, op6_mixing, op7_neighbour_graph, op8_packing, op9_ngram_jaccard, op10_suffix_dedup, op11_collocations, op12_language, op13_fill_in_middle]}
ORACLES: dict[str, str] = {
    "op11_collocations": r"""
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: list_aggregate(w[i:i + k - 1], 'string_agg', ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), parts AS (
  SELECT lang, a, array_to_string(w[s:s + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS s FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM candidates WHERE k > 2))
), around AS (SELECT lang, phrase, max(a) AS a FROM parts GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN around q ON q.lang = s.lang AND q.phrase = s.phrase WHERE q.a IS NULL OR 100::HUGEINT * q.a < 80::HUGEINT * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
""",
}
