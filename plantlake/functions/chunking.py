"""Chunks of documents: fixed token windows, and token-bounded chunks that follow headings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plantlake.functions.text import basename

# fixed values: token budget and declared overlap of a chunk; the overlap in use is 0
BUDGET, DECLARED_OVERLAP = 800, 100
BLANK = r"[ \t\n\r\f\x0B]+"
LEVELS = 6
HEADING = rf"^(#{{1,{LEVELS}}})[ \t]+(.*)$"


def tokens(text: Column) -> Column:
    """Words between blanks."""
    return F.filter(F.split(text, BLANK), lambda t: F.length(t) > 0)


def windows(words: Column, size: int = BUDGET, overlap: int = 0) -> Column:
    """Array of windows, each up to ``size`` words and sharing ``overlap`` with the one before.

    A start whose window would lie wholly inside the previous one is left out.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the window size")
    last = F.greatest(F.size(words) - 1 - overlap, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return F.when(F.size(words) > 0, F.transform(starts, lambda s: F.slice(words, s + 1, F.lit(size)))).otherwise(
        F.array().cast("array<array<string>>")
    )


def window_chunks(
    docs: DataFrame, doc_id: str, text: str, size: int = BUDGET, overlap: int = 0, keep: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, keep, chunk_no, text, n_tokens) for every document with at least one word."""
    cut = docs.select(doc_id, *keep, tokens(F.col(text)).alias("_w"))
    out = cut.select(doc_id, *keep, F.posexplode(windows(F.col("_w"), size, overlap)).alias("chunk_no", "_p"))
    return out.select(doc_id, *keep, "chunk_no", F.array_join("_p", " ").alias("text"), F.size("_p").alias("n_tokens"))


def packed(pieces: Column, budget: int) -> Column:
    """Greedy chunks over the pieces (text, n, level) of one document: array of (first, path, alone), in order.

    Level is 0 for body pieces and 1..6 for headings. Body pieces under the same heading are put together while they fit; a
    heading that nothing stands under is a chunk of its own (``alone``). ``path`` has the place of the heading above per level, -1
    for none. One fold that adds to its result only where a chunk begins.
    """
    # the level behind each piece; the end of the document counts as a heading of the highest level
    end = F.transform(F.slice(pieces, 1, 1), lambda p: F.struct(p["text"], p["n"], F.lit(1).alias("level")))
    behind = F.concat(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), end)
    rows = F.transform(
        F.zip_with(pieces, behind, lambda p, q: F.struct(p["n"].alias("n"), p["level"].alias("level"), q["level"].alias("next"))),
        lambda r, i: F.struct(i.alias("i"), r["n"].alias("n"), r["level"].alias("level"), r["next"].alias("next")),
    )
    none = F.array(*[F.lit(-1)] * LEVELS)
    start = F.struct(
        F.array().cast("array<struct<first:int,path:array<int>,alone:boolean>>").alias("chunks"), none.alias("path"), F.lit(-1).alias("filled"),
    )

    def step(state: Column, r: Column) -> Column:
        heading = r["level"] > 0
        above = F.transform(state["path"], lambda p, k: F.when(k + 1 < r["level"], p).otherwise(-1))
        path = F.transform(above, lambda p, k: F.when(k + 1 == r["level"], r["i"]).otherwise(p))
        alone = heading & (r["next"] > 0) & (r["next"] <= r["level"])
        fits = ~heading & (state["filled"] >= 0) & (state["filled"] + r["n"] <= budget)
        begin = F.struct(r["i"].alias("first"), F.when(heading, above).otherwise(state["path"]).alias("path"), alone.alias("alone"))
        return F.struct(
            F.when(alone | (~heading & ~fits), F.concat(state["chunks"], F.array(begin))).otherwise(state["chunks"]).alias("chunks"),
            F.when(heading, path).otherwise(state["path"]).alias("path"),
            F.when(heading, F.lit(-1)).when(fits, state["filled"] + r["n"]).otherwise(r["n"]).alias("filled"),
        )

    return F.aggregate(rows, start, step, lambda state: state["chunks"])


def heading_chunks(
    docs: DataFrame, doc_id: str, text: str, budget: int = BUDGET, keep: Sequence[str] = (), counter=None
) -> DataFrame:
    """(doc_id, keep, chunk_no, text, n_tokens, headings): lines packed up to the budget under one heading.

    A line above the budget is cut into windows first; a heading that long is no heading but a line like others, so no chunk has
    more words than the budget. Everything stays in the JVM. ``counter`` may replace the word count by another function
    from an array of lines to an array of counts.
    """
    lines = F.filter(F.split(text, "\n"), lambda s: F.regexp_replace(s, BLANK, "") != "")

    def pieces(line: Column) -> Column:
        words = tokens(line)
        level = F.length(F.regexp_extract(line, HEADING, 1))
        whole = F.array(F.struct(
            F.when(level > 0, F.regexp_extract(line, HEADING, 2)).otherwise(line).alias("text"),
            F.size(words).alias("n"), level.alias("level"),
        ))
        parts = F.transform(windows(words, budget), lambda w: F.struct(
            F.array_join(w, " ").alias("text"), F.size(w).alias("n"), F.lit(0).alias("level")))
        return F.when(F.size(words) > budget, parts).otherwise(whole)

    cut = docs.select(doc_id, *keep, F.flatten(F.transform(lines, pieces)).alias("_p"))
    if counter is not None:
        counted = F.zip_with("_p", counter(F.transform("_p", lambda p: p["text"])), lambda p, n: F.struct(p["text"].alias("text"), n.cast("int").alias("n"), p["level"].alias("level")))
        cut = cut.withColumn("_p", counted)
    ranges = cut.withColumn("_c", packed(F.col("_p"), budget))
    # where the next chunk begins; a document without a chunk has none
    after = F.slice(F.concat(F.transform(F.slice("_c", F.lit(2), F.greatest(F.size("_c") - 1, F.lit(0))), lambda c: c["first"]), F.array(F.size("_p"))), F.lit(1), F.size("_c"))
    taken = F.zip_with("_c", after, lambda c, e: F.struct(
        F.filter(F.slice(F.col("_p"), c["first"] + 1, F.when(c["alone"], 1).otherwise(e - c["first"])), lambda p: c["alone"] | (p["level"] == 0)).alias("body"),
        F.transform(F.filter(c["path"], lambda i: i >= 0), lambda i: F.element_at(F.col("_p"), i + 1)["text"]).alias("headings"),
    ))
    out = ranges.select(doc_id, *keep, F.posexplode(taken).alias("chunk_no", "_t"))
    return out.select(
        doc_id, *keep, "chunk_no",
        F.array_join(F.transform("_t.body", lambda p: p["text"]), "\n").alias("text"),
        F.aggregate("_t.body", F.lit(0), lambda a, p: a + p["n"]).alias("n_tokens"),
        F.col("_t.headings").alias("headings"),
    )


def stamp_chunks(chunks: DataFrame, path: str, kind: str, ingested_at: str) -> DataFrame:
    """Adds chunk_id, path, source (the file's name), type and one ingestion time for the whole run.

    The id is a digest of path, number and text: the same file always gives the same chunks, and files of the same name in
    different folders give different ones.
    """
    source = basename(F.col(path))
    digest = F.sha2(F.concat_ws("\u0001", F.col(path), F.col("chunk_no").cast("string"), F.col("text")), 256)
    return chunks.select(
        digest.alias("chunk_id"), F.col(path).alias("path"), source.alias("source"), F.lit(kind).alias("type"),
        *[c for c in chunks.columns if c != path], F.lit(ingested_at).cast("timestamp").alias("ingested_at"),
    )


def non_empty(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.where(F.length(text) > 0)


def ingest_counts(chunks: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, n_chunks, n_skipped): kept and empty chunks per file; give ``path`` where names repeat over folders."""
    full = F.coalesce(F.length(text) > 0, F.lit(False))
    return chunks.groupBy(source).agg(F.count_if(full).alias("n_chunks"), F.count_if(~full).alias("n_skipped"))
