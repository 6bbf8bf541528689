"""Mixing of sources to target weights by exact cuts in a random order of each source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plantlake.llm.common import WORD, aside, once

# documents of one bucket of hash keys: what a window sorts at a time
BUCKET_ROWS = 1_024
_KEY = "_k"


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add the target of each source to (source, source_size).

    Sources in code-point order, null last, take the weights in turn and share ``share`` times all sizes. A source stops
    at ``most`` times its own size and the excess goes to the others by weight. That ends at the level L with
    target = min(most * size, L * weight): with the sources in order of most * size / weight, those before some place
    are full and L is what they leave, divided by the weights of the rest. One row per source.
    """
    everything = W.partitionBy(F.lit(0))
    turn = F.row_number().over(everything.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * float(most)).alias("_cap")
    rows = sources.withColumn("_weight", weight).select("*", cap, (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("_all"))
    by_level = everything.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), "source")
    upto, rest = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / F.sum("_weight").over(rest)
    rows = rows.withColumn("_level", level)
    # the first source that isn't filled at its own level sets the level of all behind it
    open_at = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_weight")).alias("r"), F.col("_level").alias("level")))).over(everything)
    return rows.withColumn("_at", open_at["level"]).withColumn(
        "target", F.coalesce(F.least("_cap", F.col("_at") * F.col("_weight")), F.col("_cap"))
    ).drop("_weight", "_cap", "_all", "_level", "_at")


def mix(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The words that a mix of sources takes of each document.

    One row per input row: doc_id, source, size (words), source_size, target (of its source), taken, and ``_row``, the
    hash of (doc_id, text). A source gives all its documents ``floor(target / source_size)`` times; the rest
    of its target is cut exactly (to a whole word) from the documents in the order of their hash keys: a prefix sum runs
    over (source, bucket of keys) first, then inside buckets of about ``bucket_rows`` documents, so a source of any
    size is spread over all tasks. Reruns agree; equal rows are interchangeable. Null text has size 0, a null source
    is a source; an empty table gives no rows; other columns are not read.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(6))
    sized = once(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), key.alias(_KEY),
    ), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    planned = once(source_targets(sources, weights, share, most).select(
        F.col("source").alias("_source"), "source_size", "target",
        F.ceil(F.col("_rows") / bucket_rows).cast("long").alias("_buckets"),
        # whole words; a source without words takes none
        F.least(F.round("target").cast("long"), F.col("source_size") * int(most)).alias("_budget"),
    ), "targets")
    # keys are spread evenly over the 64-bit range, so equal ranges of them hold about as many documents each
    place = F.floor((F.col(_KEY).cast("double") / 2.0**64 + 0.5) * F.col("_buckets"))
    rows = sized.join(planned, F.col("source").eqNullSafe(F.col("_source")), "left")
    rows = rows.withColumn("_bucket", F.greatest(F.lit(0), F.least(place.cast("long"), F.col("_buckets") - 1))).drop("_source")
    per = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    earlier = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = per.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_base"))
    inside = W.partitionBy("source", "_bucket").orderBy(_KEY, "doc_id").rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(0)
    left = F.col("_budget") - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_base") - F.col("_before")))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"), F.col(_KEY).alias("_row"),
    )


def take_words(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2) -> DataFrame:
    """The documents of the mix: as many whole copies of each as the mix takes, and the first words of the one at the cut
    (single spaces between them).

    The columns are those of ``docs``, whatever their names; n_chars, if there, follows the text. Documents that the mix leaves out, or that
    have no words, go. Equal rows share what is taken of them in the order of the cut.
    """
    names, docs, spare = docs.columns, aside(docs, ("doc_id", "text", "source", "n_chars")), "_taken"
    keyed = docs.withColumn("_row", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(6)))
    # equal rows are numbered, so that each meets its own share
    same = W.partitionBy("_row", "source")
    taken = mix(docs, weights, share, most).where(F.col("size") > 0).select(
        F.col("_row").alias("_r"), F.col("source").alias("_s"), F.row_number().over(same.orderBy(F.desc("taken"))).alias("_n"),
        F.col("taken").alias(spare), F.col("size").alias("_size"),
    )
    keyed = keyed.withColumn("_copy", F.row_number().over(same.orderBy("doc_id")))
    joined = keyed.join(taken, (F.col("_row") == F.col("_r")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_copy") == F.col("_n")))
    whole, rest = F.floor(F.col(spare) / F.col("_size")).cast("int"), (F.col(spare) % F.col("_size")).cast("int")
    # number 0 stands for the cut copy, the others for whole ones
    copies = F.array_compact(F.concat(F.when(rest > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>"))))
    out = joined.withColumn("_part", F.explode(copies))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), rest), " ")
    text = F.when(F.col("_part") == 0, first).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns).toDF(*names)
