"""Removal of long passages that occur elsewhere: sampled suffixes, dealt by their leading bytes, sorted bucket by bucket."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from plantlake.joins import join_sized
from plantlake.llm.common import SMALL_SLICE, once, over_texts

LENGTH = 200
# leading bytes of a suffix; every stretch of LENGTH bytes holds a sampled suffix with all of them
LEAD = 32
# suffixes of one bucket, and of one leading string beyond which its bucket is split
BUCKET = 20_000

_P = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hash(data: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of the ``length`` bytes from each place on; strings are put together by doubling."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    n = len(data) - length + 1
    part, size, whole, done = _mix(data.astype(np.uint64) + np.uint64(0x1234567)), 1, None, 0
    while True:
        if length & size:
            piece = part[done : done + n]
            whole = piece.copy() if whole is None else whole * np.uint64(pow(_P, size, 1 << 64)) + piece
            done += size
        if done == length:
            return _mix(whole)
        part = part[: len(part) - size] * np.uint64(pow(_P, size, 1 << 64)) + part[size:]
        size *= 2


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from running minima of blocks forwards and backwards."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.uint64(_MASK))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def sampled_suffixes(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, position, hash of the lead, stretches before, stretches after) of the suffixes that stand for all stretches.

    A stretch of LENGTH bytes is stood for by the place inside it whose lead has the smallest hash, the first of equals. That
    depends on its bytes only, so equal stretches have equal suffixes. ``before`` and ``after`` say that the stretches
    that start ``after`` to ``before`` bytes before the suffix are its own.
    """
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    starts = ends - np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    leads = _hash(data, LEAD)
    places = np.arange(len(leads), dtype=np.uint64)
    # hash above, place below: the smallest hash, then the first place
    best = _sliding_min((leads & np.uint64(_MASK ^ 0xFFFFFFF)) | places, LENGTH - LEAD + 1)
    at = (best & np.uint64(0xFFFFFFF)).astype(np.int64)
    stretch = np.arange(len(at))
    owner = np.searchsorted(ends, stretch, side="right")
    valid = stretch + LENGTH <= ends[owner]
    stretch, at, owner = stretch[valid], at[valid], owner[valid]
    if not len(stretch):
        return none, none, none, none, none
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    place = at[first]
    return owner[first], place - starts[owner[first]], leads[place].view(np.int64), place - stretch[first], place - stretch[last]


def _distinct_texts(batch: pa.RecordBatch, seen: set[int]) -> tuple[list[int], list[bytes], list[int]]:
    """Keys, bytes and rows of the texts of a slice that this task has not seen yet; the memory of it is bounded."""
    keys, texts, rows = [], [], []
    for i, (key, text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)):
        if text and key not in seen:
            keys.append(key)
            texts.append(text.encode("utf-8", "surrogatepass"))
            rows.append(i)
            if len(seen) < 500_000:
                seen.add(key)
    return keys, texts, rows


def _suffixes(texts: DataFrame) -> DataFrame:
    """(lead, key, pos, before, after, first, twice) of all sampled suffixes.

    ``first`` marks one suffix per lead and slice, ``twice`` those whose lead comes again in the slice: a lead that very
    many documents share is decided by a few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys, data, _ = _distinct_texts(b, seen)
            if not data:
                continue
            owner, pos, lead, before, after = sampled_suffixes(data)
            _, first, place, count = np.unique(lead, return_index=True, return_inverse=True, return_counts=True)
            is_first = np.zeros(len(lead), bool)
            is_first[first] = True
            yield pa.RecordBatch.from_pydict({
                "lead": lead, "key": np.array(keys, np.int64)[owner], "pos": pos.astype(np.int32), "before": before.astype(np.int16),
                "after": after.astype(np.int16), "first": is_first, "twice": count[place] > 1,
            })

    return over_texts(texts.select("key", "text"), run, "lead long, key long, pos int, before short, after short, first boolean, twice boolean", chars=SMALL_SLICE)


def repeated_suffixes(texts: DataFrame) -> DataFrame:
    """(lead, key, pos, before, after) of the suffixes whose lead occurs at another place."""
    rows = once(_suffixes(texts), "suffixes")
    place = F.xxhash64("key", "pos")
    lead = W.partitionBy("lead")
    decided = rows.where("first").withColumn("lo", F.min(place).over(lead)).withColumn("hi", F.max(place).over(lead))
    kept = ["lead", "key", "pos", "before", "after"]
    return once(decided.where("twice or lo <> hi").select(*kept).unionByName(rows.where("not first").select(*kept)), "repeated")


def _contexts(texts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(lead, key, pos, after, context): the bytes of all stretches of a suffix."""
    per = suffixes.groupBy("key").agg(F.collect_list(F.struct("lead", "pos", "before", "after")).alias("found"))
    per = per.select("key", *[F.col(f"found.{c}").alias(c) for c in ("lead", "pos", "before", "after")])
    # positions grow with the texts, so the two sides meet by key
    rows = texts.select("key", "text").join(per, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys, data, at = _distinct_texts(b, seen)
            out: dict[str, list] = {c: [] for c in ("lead", "key", "pos", "after", "context")}
            found = {c: b.column(c) for c in ("lead", "pos", "before", "after")}
            for key, text, i in zip(keys, data, at, strict=True):
                lead, pos, before, after = (found[c][i].values.to_numpy() for c in ("lead", "pos", "before", "after"))
                start, end = pos - before, pos - after + LENGTH
                out["lead"].append(lead)
                out["pos"].append(pos)
                out["after"].append(after)
                out["key"].append(np.full(len(lead), key, np.int64))
                out["context"] += [text[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
            if out["context"]:
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary()) if c == "context" else np.concatenate(v) for c, v in out.items()})

    return over_texts(rows, run, "lead long, key long, pos int, after short, context binary")


SORTED = "key long, start long, stop long, stretch long, witness boolean"


def _sort_bucket(group: pa.Table) -> pa.Table:
    """Sort the stretches of a bucket by (lead, place of the lead, bytes) and compare neighbours.

    Gives runs of bytes (key, start, stop) whose stretches occur twice in the bucket. For leads that are split over several
    buckets also one row per different stretch, to be compared across buckets: ``witness`` where it is covered already.
    """
    none = pa.table({"key": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "stop": pa.array([], pa.int64()), "stretch": pa.array([], pa.int64()), "witness": pa.array([], pa.bool_())})
    keys, pos = group.column("key").to_numpy(), group.column("pos").to_numpy().astype(np.int64)
    # a text that is there several times gives the same suffixes again
    _, own = np.unique(np.stack([keys, pos]), axis=1, return_index=True)
    group = group.take(pa.array(own))
    keys, pos, after = keys[own], pos[own], group.column("after").to_numpy().astype(np.int64)
    leads, split = group.column("lead").to_numpy().view(np.uint64), group.column("split").to_numpy()
    column = group.column("context").combine_chunks()
    lengths = np.array([len(x) for x in column.to_pylist()], np.int64) if column.offset else np.diff(np.frombuffer(column.buffers()[1], np.int32)[: len(column) + 1]).astype(np.int64)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    if not len(data):
        return none
    counts = lengths - LENGTH + 1
    ends = np.cumsum(lengths)
    record = np.repeat(np.arange(len(keys)), counts)
    nth = np.arange(len(record)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashed = _hash(data, LENGTH)[(ends - lengths)[record] + nth]
    back = after[record] + counts[record] - 1 - nth
    stretch = _mix(hashed * np.uint64(_P) + _mix(leads[record] + back.astype(np.uint64)))
    order = np.argsort(stretch, kind="stable")
    ordered = stretch[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(stretch), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    begin = pos[record] - back
    # consecutive stretches of one suffix that are covered make one run
    hit = np.flatnonzero(twice)
    parts = []
    if len(hit):
        fresh = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(record[hit]) != 0)])
        first, last = hit[fresh], hit[np.concatenate([fresh[1:], [True]])]
        parts.append((keys[record[first]], begin[first], begin[last] + LENGTH, np.zeros(len(first), np.int64), np.ones(len(first), bool)))
    spread = np.flatnonzero(split[record])
    if len(spread):
        # one row per different stretch of this bucket
        _, one = np.unique(stretch[spread], return_index=True)
        one = spread[one]
        parts.append((keys[record[one]], begin[one], begin[one] + LENGTH, stretch[one].view(np.int64), twice[one]))
    if not parts:
        return none
    key, start, stop, code, witness = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pa.table({"key": key, "start": start, "stop": stop, "stretch": code, "witness": witness})


def repeated_runs(texts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(key, start, stop): runs of bytes of different texts that are covered by repeated stretches; they may overlap."""
    suffixes = repeated_suffixes(texts)
    total = suffixes.count()
    buckets = max(1, -(-total // bucket))
    # leads of very many suffixes; there are fewer than the total by the bucket size
    hot = once(suffixes.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket), "hot")
    hot = hot.select("lead", F.ceil(F.col("n") / bucket).cast("int").alias("salts"))
    contexts = join_sized(_contexts(texts, suffixes), hot, ["lead"], "left")
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("key", "pos"), F.col("salts"))).otherwise(F.lit(0))
    dealt = contexts.withColumn("split", F.col("salts").isNotNull()).withColumn("bucket", F.pmod(F.xxhash64("lead", salt), F.lit(buckets))).drop("salts")
    found = once(dealt.groupBy("bucket").applyInArrow(_sort_bucket, SORTED), "runs")
    runs = found.where("stretch = 0").select("key", "start", "stop")
    if hot.isEmpty():
        return runs
    across = W.partitionBy("stretch")
    # at most one row per bucket for each stretch
    met = found.where("stretch <> 0").withColumn("n", F.count(F.lit(1)).over(across)).where("n > 1 and not witness")
    return runs.unionByName(met.select("key", "start", "stop"))


def merged_runs(runs: DataFrame) -> DataFrame:
    """(key, starts, stops): the maximal runs of every text, ascending."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, stops = [], []
            for found in b.column("found").to_pylist():
                merged: list[list[int]] = []
                for s, e in sorted((r["start"], r["stop"]) for r in found):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                starts.append([s for s, _ in merged])
                stops.append([e for _, e in merged])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64()))], ["key", "starts", "stops"])

    per = runs.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    return per.mapInArrow(merge, "key long, starts array<long>, stops array<long>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """What is left of every text without the bytes of 200-byte strings that start anywhere else too.

    Adds to (doc_id, text): n_bytes, n_removed, spans (array of start and stop bytes, maximal, ascending) and kept
    (binary). Strings are judged on the input; matches never cross documents and may lie in one document. A text that several
    rows have is covered whole from 200 bytes on, and is compared with the others once. Null and empty texts keep nothing;
    rows with a null doc_id take part; an empty table gives no rows. Texts are told apart by a 64-bit hash of theirs.

    Not all suffixes are sorted: that would move some 16 bytes per byte of text. Of every 200-byte stretch one suffix is
    taken, chosen by its content, which keeps the result exact. Those whose 32 leading bytes come only once go. The
    rest meet by their leading bytes, each bucket sorts its stretches and compares neighbours, and leads that are too many
    for one bucket are compared across buckets.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = rows.withColumn("key", F.xxhash64("text", F.octet_length("text")))
    long = texts.where(F.octet_length("text") >= LENGTH)
    copied = long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("size")).where("n > 1")
    runs = repeated_runs(long).unionByName(copied.select("key", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("stop")))
    joined = join_sized(texts, merged_runs(runs), ["key"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, spans, kept = [], [], [], []
            starts, stops = b.column("starts"), b.column("stops")
            for i, text in enumerate(b.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                merged = list(zip(starts[i].as_py(), stops[i].as_py(), strict=True)) if starts[i].is_valid else []
                at, left = 0, []
                for s, e in merged:
                    left.append(data[at:s])
                    at = e
                size.append(len(data))
                removed.append(sum(e - s for s, e in merged))
                spans.append([{"start": s, "stop": e} for s, e in merged])
                kept.append(b"".join([*left, data[at:]]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return over_texts(joined, cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
