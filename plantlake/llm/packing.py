"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from plantlake.llm.common import SLICE_CHARS
from plantlake.llm.encoding import byte_encoder

CAPACITY = 2_048
# bytes of text in one group: what a task holds besides its sorted input
GROUP_BYTES = 16 * 1024 * 1024
PIECES = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, token_ids binary"
)


class FreeSpace:
    """Tournament tree over bins: each inner node keeps the largest free space below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin with room for it; the bin's number."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        found = node - self.leaves
        best[node] -= size
        while node > 1:
            node //= 2
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if left > right else right
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of every piece; pieces go by falling size, ties by their place. No size is above ``capacity`` or zero."""
    order = np.argsort(-sizes, kind="stable")
    tree, bins = FreeSpace(len(sizes), capacity), np.empty(len(sizes), np.int64)
    for i in order.tolist():
        bins[i] = tree.place(int(sizes[i]))
    return bins


def place_pieces(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths.

    Whole sequences are cut from the front of long documents; the rests are packed by first-fit decreasing. Bins
    are then closed from the emptiest end: pieces of the last bins are cut to fill the gaps of the others, so that
    only one sequence of a group stays short, and that one is cut at powers of two, which need no padding.
    """
    full, rest = lengths // capacity, lengths % capacity
    out, sequence = [], 0
    for doc in np.flatnonzero(full).tolist():
        for k in range(int(full[doc])):
            out.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
    docs = np.flatnonzero(rest)
    if not len(docs):
        return out
    sizes = rest[docs]
    bins = first_fit_decreasing(sizes, capacity)
    held: list[list[list[int]]] = [[] for _ in range(int(bins.max()) + 1)]
    for doc, size, b in zip(docs.tolist(), sizes.tolist(), bins.tolist(), strict=True):
        held[b].append([doc, int(full[doc]) * capacity, size])
    used = [sum(p[2] for p in b) for b in held]
    # fullest bins first; the last ones are taken apart
    order = sorted(range(len(held)), key=lambda b: (-used[b], b))
    front, back = 0, len(order) - 1
    while front < back:
        gap = capacity - used[order[front]]
        if not gap:
            front += 1
            continue
        donor = order[back]
        doc, start, size = held[donor][-1]
        move = min(gap, size)
        held[order[front]].append([doc, start + size - move, move])
        used[order[front]] += move
        used[donor] -= move
        if move == size:
            held[donor].pop()
        else:
            held[donor][-1][2] = size - move
        if not held[donor]:
            back -= 1
    for b in order[: back + 1]:
        left = [p for p in held[b] if p[2]]
        total, done = sum(p[2] for p in left), 0
        # a full bin is one sequence; the last, short one becomes sequences of falling powers of two
        targets = [capacity] if total == capacity else [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if total >> k & 1]
        for target in targets:
            room = target
            while room:
                doc, start, size = left[0]
                take = min(room, size)
                out.append((doc, start, take, sequence, target - room))
                room -= take
                left[0][1], left[0][2] = start + take, size - take
                if not left[0][2]:
                    left.pop(0)
            sequence += 1
            done += target
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pack the ids of every text, each text followed by ``end_id``, into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, start and length within its document, doc_tokens, sequence_id, offset there, and the ids
    themselves (little-endian unsigned 32-bit). Documents meet in random groups of about ``group_bytes`` of text, by a
    hash of the whole row, so that no source, key or group of copies makes a group large; repeated rows are packed
    each for itself. Null text is empty (one id), null doc_ids stay null; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("bytes")).first()["bytes"] or 0
    groups = max(1, -(-int(size) // group_bytes))
    end = np.array([end_id], "<u4").tobytes()

    def pack_group(group: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({c: pa.array([], t) for c, t in _PIECE_TYPES.items()})
        number = group.column("_group")[0].as_py()
        group = group.sort_by([("doc_id", "ascending"), ("_tie", "ascending")])
        texts, ids = group.column("text"), []
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for i, j in _ranges(lengths):
            ids += [x + end for x in byte_encoder(tokenizer).encode(texts[i:j].to_pylist())]
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        doc_ids = group.column("doc_id").to_pylist()
        pieces = place_pieces(counts, capacity)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        return pa.table({
            "doc_id": pa.array([doc_ids[d] for d in doc.tolist()], pa.int64()),
            "start": start, "length": length, "doc_tokens": counts[doc],
            "sequence_id": (np.int64(number) << 32) + sequence, "offset": offset,
            "token_ids": pa.array([ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)], pa.binary()),
        })

    keyed = rows.withColumn("_tie", F.xxhash64("text"))
    # rows that are equal in everything are told apart by a number, or a group of copies would meet in one group
    spread = F.xxhash64("doc_id", "_tie", F.monotonically_increasing_id())
    keyed = keyed.withColumn("_group", F.pmod(spread, F.lit(groups)))
    return keyed.groupBy("_group").applyInArrow(pack_group, PIECES)


_PIECE_TYPES = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(),
    "offset": pa.int64(), "token_ids": pa.binary(),
}


def _ranges(lengths: list[int]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, n in enumerate(lengths):
        size += n
        if size >= SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)
