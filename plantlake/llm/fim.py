"""Fill-in-the-middle: texts are cut at two ranks of units that an indexable skip list finds, and put together in another order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantlake.llm.common import over_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# one node in so many of a lane also stands in the lane above
FAN_OUT = 4
# percent of documents that are left as they are from here on; of the others, percent that lead with their suffix
PLAIN_FROM, SPM_BELOW = 90, 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_widths(text: str) -> np.ndarray:
    """Code points of every unit: a run of ASCII letters, or any other single code point."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    at = np.flatnonzero(begins)
    # a unit of letters is as wide as its bytes; everything else is one code point of one to four bytes
    widths = np.diff(at, append=len(data)).astype(np.uint32)
    widths[~letter[at]] = 1
    return widths


def _levels(n: int) -> np.ndarray:
    """Highest lane of each node: a hash of its position, so that a list is the same whenever it is built."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    out, mask = np.zeros(n, np.uint8), np.uint64(1)
    while True:
        mask *= np.uint64(FAN_OUT)
        up = x % mask == 0
        if not up.any():
            return out
        out += up


@dataclass(frozen=True)
class Lane:
    """Links of one lane, in order: how many units and code points each one passes, and the link below that starts where it does."""

    units: np.ndarray | None
    points: np.ndarray
    below: np.ndarray | None


class SkipList:
    """Indexable skip list over units. Lane 0 has one link per unit; an express lane adds up the links below it."""

    def __init__(self, widths: np.ndarray) -> None:
        self.lanes = [Lane(None, widths, None)]
        self.n = len(widths)
        # a link starts at its node, or at the head of the lane, and runs to the next node of the lane
        levels = _levels(self.n)
        units, points = None, widths.astype(np.int64)
        level = 0
        while len(points) > FAN_OUT:
            level += 1
            up = levels >= level
            up[:1] = True
            below = np.flatnonzero(up)
            if len(below) == len(points):
                break
            units = np.diff(below, append=len(up)) if units is None else np.add.reduceat(units, below)
            points = np.add.reduceat(points, below)
            self.lanes.append(Lane(units, points, below))
            levels = levels[below]

    def points_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        units = points = at = 0
        for lane in reversed(self.lanes):
            end = len(lane.points)
            while at < end and (step := 1 if lane.units is None else int(lane.units[at])) <= rank - units:
                units += step
                points += int(lane.points[at])
                at += 1
            if units == rank:
                break
            if lane.below is not None:
                at = int(lane.below[at])
        return points


def cut(text: str, digest: str) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the text in its new order, as ``digest`` (hex) says."""
    widths = unit_widths(text)
    n = len(widths)
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= PLAIN_FROM or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    index = SkipList(widths)
    a, b = (index.points_before(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """Add the column ``fim``: struct of n (units), form, prefix_chars, middle_chars and output to every row of ``docs``.

    Each row is cut by itself, from the sha256 of ``seed:key``, so reruns and repeated rows agree. Null text counts as empty
    and empty text is plain; a null key counts as the empty string. All other columns pass through, one named ``fim`` is
    replaced. An empty table stays empty. One text is held at a time, besides its batch.
    """
    kept = [c for c in docs.columns if c != "fim"]
    kinds = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    own = ["_fim_text", "_fim_hash"]
    source = docs.select(
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)],
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(own[0]),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256).alias(own[1]),
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [cut(t.as_py(), h.as_py()) for t, h in zip(b.column(own[0]), b.column(own[1]), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *made], [*b.schema.names[: len(kept)], *_PARTS])

    schema = ", ".join([*(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(kinds)), *(f"{c} {t}" for c, t in _PARTS.items())])
    made = over_texts(source, fold, schema, own[0])
    return made.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], F.struct(*_PARTS).alias("fim"))


_PARTS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from; the signs occur in it once each, in the order of its form."""
    body = F.substr(output, F.lit(4))

    def parts(second: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(body, MIDDLE, 1)
        return F.substring_index(head, second, 1), F.substring_index(head, second, -1), F.substring_index(body, MIDDLE, -1)

    prefix, suffix, middle = parts(SUFFIX)
    suffix2, prefix2, middle2 = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
