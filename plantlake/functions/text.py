"""Text clean-up, previews, paths and trace clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode white space, plus the four separators that count as space in Python but not in Java
SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z|\A{SPACE}+", "")


# the patterns of clean_markup and of the code fences below are fixed values
def clean_markup(text: Column) -> Column:
    """Tags to spaces, white space runs to one space, empty bold and underline marks dropped, trimmed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    out = F.trim(F.regexp_replace(out, rf"{SPACE}+", " "))
    out = F.regexp_replace(out, r"\*\*\s*\*\*", "")
    out = F.regexp_replace(out, r"__\s*__", "")
    return F.trim(out)


def strip_think(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"</?think>", ""))


def preview(text: Column, length: int = 70) -> Column:
    """The first characters followed by three dots, also when nothing was cut."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def cut(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


# fixed values: lengths of the shortened texts
PREVIEW, ANSWER, TOOL_LOG, TOOL_ARGS, ERROR_TEXT = 70, 1000, 300, 100, 40


def error_details(message: Column) -> Column:
    return F.concat(F.lit("Error: "), cut(message, ERROR_TEXT), F.lit("..."))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty for none and for names that only start with dots."""
    return F.lower(F.regexp_extract(basename(path), r"[^.][^/]*?(\.[^.]*)\z", 1))


# fixed values: accepted extensions by kind
DOCUMENT_EXTENSIONS = [".pdf", ".csv", ".txt", ".md"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png"]


def file_kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(DOCUMENT_EXTENSIONS), "Doc").when(ext.isin(IMAGE_EXTENSIONS), "Img")


def clean_model_output(text: Column) -> Column:
    """Drop end-of-code markers next to a code fence."""
    out = F.regexp_replace(strip(text), r"```\s*<end_code>", "```")
    out = F.regexp_replace(out, r"<end_code>\s*```", "```")
    return strip(out)


def clean_code_argument(text: Column) -> Column:
    """Code without a leading python fence and a trailing fence."""
    return F.regexp_replace(F.regexp_replace(text, r"\A```python\n", ""), r"\n```\n?\z", "")
