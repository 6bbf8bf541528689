"""Message traces: merging of text pieces, classification of steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plantlake.functions.text import clean_code_argument, clean_model_output, strip
from plantlake.ordered import WINDOW_ROWS, running_total

PLOT_PATH = r"([^\s`'\"()]+\.html)"

# fixed values: media type by file extension
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".wav": "audio/wav", ".mp3": "audio/mpeg"}
DEFAULT_MEDIA_TYPE = "image/png"


# bytes of text of one merged row
SEGMENT_BYTES = 64 << 20


def merge_pieces(
    df: DataFrame, conversation: Sequence[str], order: Sequence[str], text: str, is_piece: Column, window_rows: int = WINDOW_ROWS,
    segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """Runs of consecutive text pieces become one message; every other row ends a run and stays itself.

    Returns (conversation, first position, n_pieces, is_piece, text, segment) with the pieces put together in order. A run of more than
    ``segment_bytes`` becomes several rows, numbered by ``segment`` from 0: a piece goes to the segment its first byte lies in, so a
    row holds that many bytes and the rest of its last piece at most.
    """
    if segment_bytes < 1:
        raise ValueError("segment_bytes must be positive")
    conversation, order = list(conversation), list(order)
    rows = df.select(*conversation, *order, F.col(text).alias("text"), F.coalesce(is_piece, F.lit(False)).alias("is_piece"))
    breaks = F.when(F.col("is_piece"), 0).otherwise(1)
    numbered = running_total(rows, conversation, order, breaks, "_run", window_rows)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    # no run is longer than its conversation: without a long one all is one segment
    longest = rows.groupBy(*conversation).agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest > segment_bytes:
        numbered = running_total(numbered, [*conversation, "_run", "is_piece"], order, size, "_upto", window_rows)
        segment = F.floor((F.col("_upto") - size) / segment_bytes)
    else:
        segment = F.lit(0)
    numbered = numbered.withColumn("segment", segment.cast("int"))
    place = F.struct(*order)
    merged = numbered.groupBy(*conversation, "_run", "is_piece", "segment").agg(
        F.min(place).alias("_first"), F.count(F.lit(1)).alias("n_pieces"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), "text"))), lambda s: s["text"]), "").alias("text"),
    )
    return merged.select(*conversation, *[F.col(f"_first.{o}").alias(o) for o in order], "n_pieces", "is_piece", "text", "segment")


def plot_path(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, PLOT_PATH, 1), F.lit(""))


def media_type(path: Column) -> Column:
    ext = F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)\z", 1)
    table = F.create_map(*[x for k, v in MEDIA_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[ext], F.lit(DEFAULT_MEDIA_TYPE))


def classify_steps(df: DataFrame, part: str = "part", text: str = "text", tool: str = "tool_name") -> DataFrame:
    """Adds message_type, content, path and mime_type; rows without any content are dropped.

    ``part`` says what a row holds: model_output, tool_call, observation, error, plan, final_answer,
    final_image or final_audio.
    """
    body = strip(F.col(text))
    tool_name = F.col(tool) if tool in df.columns else F.lit(None).cast("string")
    p = F.col(part)
    code = F.concat(F.lit("```python\n"), clean_code_argument(F.col(text)), F.lit("\n```"))
    plot = F.when(p == "observation", plot_path(body))
    file = p.isin("final_image", "final_audio")
    kind = (
        F.when(p == "model_output", "thought").when(p == "tool_call", "tool_call")
        .when((p == "observation") & plot.isNotNull(), "tool_result_plot").when(p == "observation", "tool_result")
        .when(p == "error", "error").when(p == "plan", "plan").when(file, "final_answer_file").when(p == "final_answer", "final_answer")
    )
    content = (
        F.when(p == "model_output", clean_model_output(F.col(text)))
        .when((p == "tool_call") & (tool_name == "python_interpreter"), code)
        .when(p == "observation", body)
        .otherwise(F.col(text))
    )
    out = df.withColumn("message_type", kind).withColumn("content", content).withColumn(
        "path", F.when(file, F.col(text)).otherwise(plot)
    ).withColumn("mime_type", F.when(file, media_type(F.col(text))))
    return out.where(F.col("message_type").isNotNull() & ((strip(F.col("content")) != "") | F.col("message_type").isin("tool_call", "error")))
