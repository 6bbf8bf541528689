import datetime as dt
import os
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SMALL
from plantlake.functions.chunking import BUDGET, heading_chunks, ingest_counts, stamp_chunks, window_chunks
from plantlake.functions.embedding import embed_column, hashing_embedder
from plantlake.functions.text import (
    basename, clean_code_argument, clean_markup, clean_model_output, error_details, extension, file_kind, preview, strip_think,
)
from plantlake.functions.units import KeywordRule, convert, general_information, phrase_parts, phrase_results
from plantlake.operators.answers import answer_questions, nearest_chunks
from plantlake.operators.neighbours import Leaders, exact_top_k, top_k_in_cells
from plantlake.operators.vector_index import VectorIndex, cell_top_k, hashed_top_k
from plantlake.operators.trace import classify_steps, media_type, merge_pieces
from plantlake.plans.documents import _letter_vector
from plantlake.sources.collection import Collection, flatten_metadata
from plantlake.sources.corpus import document_chunks, image_chunks, list_files, processing_log, scan_files, skipped_log, unseen
from plantlake.streaming.ingest import ingest_stream


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_clean_markup(spark):
    texts = ["<p>a</p><br>b", " x  y ", "k ** ** z __ __ w", "****", None, "a\x1cb", "<script>var x;</script>t", "1 < 2"]
    assert column(spark, texts, clean_markup) == ["a b", "x y", "k  z  w", "", "", "a b", "var x; t", "1 < 2"]


def test_small_text_functions(spark):
    assert column(spark, ["<think>a</think> b\n"], strip_think) == ["a b"]
    assert column(spark, ["x" * 80, "é"], preview) == ["x" * 70 + "...", "é..."]
    assert column(spark, ["e" * 50], error_details) == ["Error: " + "e" * 40 + "..."]
    paths = ["/a/b/Report.v2.PDF", "x.tar.gz", "/a/.bashrc", "noext", "dir.d/file", "p.JPG"]
    assert column(spark, paths, basename) == [os.path.basename(p) for p in paths]
    assert column(spark, paths, extension) == [os.path.splitext(os.path.basename(p))[1].lower() for p in paths]
    assert column(spark, paths, file_kind) == ["Doc", None, None, None, None, "Img"]
    assert column(spark, ["a\n```\n<end_code>", "<end_code> ```", "x```<end_code>"], clean_model_output) == ["a\n```", "```", "x```"]
    assert column(spark, ["```python\nx=1\n```", "x=1"], clean_code_argument) == ["x=1", "x=1"]


def test_unit_phrases(spark):
    texts = ["100 C to F", "212°F to celsius", "2 bar", "101.3 kPa", "30 psi", "-10 mbar", "hello", "is 35 MW ok", "1600 °C?", "10 mg/Nm3", "5 bar or 100 c to f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parts = phrase_parts(F.col("t"))
    out = df.select("i", *[parts[c].alias(c) for c in parts]).withColumn("r", phrase_results(F.col("amount"), F.col("unit"))).orderBy("i").collect()
    shown = [{r.unit: round(r.value, r.decimals) for r in row.r} for row in out]
    assert shown[:6] == [{"°F": 212.0}, {"°C": 100.0}, {"kPa": 200.0, "psi": 29.0}, {"bar": 1.01, "psi": 14.69}, {"bar": 2.07, "kPa": 206.7}, {"kPa": 1.0}]
    # the pressure pattern drops the sign
    assert (out[5].rule, out[5].amount, out[5].unit) == ("pressure", 10.0, "mbar")
    assert [r.rule for r in out[6:]] == ["none", "context", "context", "context", "temperature"]
    assert out[7].label == "35MW high power, EAFs." and out[9].label.startswith("10mg")
    kpa = df.select(convert(F.lit(2.0), F.lit("bar"), "kPa"), convert(F.lit(2.0), F.lit("°C"), "kPa"), convert(F.lit(100.0), F.lit("°C"), "°F")).first()
    assert tuple(kpa) == (200.0, None, 212.0)


def test_general_information(spark):
    rules = [KeywordRule(("furnace", "heat"), "a"), KeywordRule(("furnace",), "b")]
    got = column(spark, ["Heat of a FURNACE?", "furnace guards", "power"], lambda c: general_information(c, rules))
    assert list(got) == ["a", "b", None]


@pytest.mark.parametrize("size,overlap", [(5, 0), (5, 2), (3, 1), (800, 100)])
def test_windows_cover_every_word(spark, size, overlap):
    docs = [" ".join(f"w{i}" for i in range(n)) for n in [0, 1, 4, 5, 6, 7, 8, 23]]
    df = spark.createDataFrame(list(enumerate(docs)), "d int, text string")
    rows = window_chunks(df, "d", "text", size, overlap).orderBy("d", "chunk_no").collect()
    for d, text in enumerate(docs):
        parts = [r.text.split() for r in rows if r.d == d]
        joined = [w for i, p in enumerate(parts) for w in (p if i == 0 else p[overlap:])]
        assert joined == text.split() and all(len(p) <= size for p in parts)
        assert all(len(p) > overlap for p in parts[1:])


def test_heading_chunks(spark):
    text = "intro one\n\n# A\na b c\nd e\nf g h i\n## B\n\nx y\n# C\n## D\n1 2 3 4 5 6 7 8 9\nz\n# E"
    df = spark.createDataFrame([(1, text)], "d int, text string")
    got = [(r.text, r.n_tokens, r.headings) for r in heading_chunks(df, "d", "text", 5).orderBy("chunk_no").collect()]
    assert got == [
        ("intro one", 2, []), ("a b c\nd e", 5, ["A"]), ("f g h i", 4, ["A"]), ("x y", 2, ["A", "B"]),
        ("1 2 3 4 5", 5, ["C", "D"]), ("6 7 8 9\nz", 5, ["C", "D"]), ("E", 2, []),
    ]


def brute_chunks(text, budget):
    """(text, n, headings) by the rules, line by line."""
    pieces = []
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        mark = re.match(r"(#{1,6})[ \t]+(.*)$", line)
        if len(words) > budget:
            pieces += [(" ".join(words[i : i + budget]), len(words[i : i + budget]), 0) for i in range(0, len(words), budget)]
        else:
            pieces.append((mark[2], len(words), len(mark[1])) if mark else (line, len(words), 0))
    out, path, body = [], [], []

    def close():
        if body:
            out.append(("\n".join(t for t, _, _ in body), sum(n for _, n, _ in body), [t for t, _ in path]))
            body.clear()

    for i, (t, n, level) in enumerate(pieces):
        if level:
            close()
            path = [h for h in path if h[1] < level]
            if i + 1 == len(pieces) or 0 < pieces[i + 1][2] <= level:
                out.append((t, n, [h for h, _ in path]))
            path.append((t, level))
            continue
        if body and sum(x[1] for x in body) + n > budget:
            close()
        body.append((t, n, level))
    close()
    return out


def test_heading_chunks_like_brute_force(spark):
    """Headings of all levels, long headings and lines, headings without a body; no chunk is above the budget."""
    rng = random.Random(6)
    line = lambda: ("#" * rng.randint(1, 7) + " " if rng.random() < 0.4 else "") + " ".join(rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 2, 3, 5, 17])))
    texts = ["\n".join(line() for _ in range(rng.randint(0, 30))) for _ in range(150)] + ["", "# " + "long " * 40, "# a\n" + "\n".join(f"line {i}" for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    for budget in (4, 9):
        got = {}
        for r in heading_chunks(df, "d", "text", budget).orderBy("d", "chunk_no").collect():
            got.setdefault(r.d, []).append((r.text, r.n_tokens, r.headings))
        for i, text in enumerate(texts):
            want = brute_chunks(text, budget)
            assert got.get(i, []) == want
            assert all(n <= budget for _, n, _ in want)
    plan = heading_chunks(df, "d", "text", 9)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_heading_chunks_by_another_counter(spark):
    df = spark.createDataFrame([(1, "# t\naa bb\ncc\ndddd")], "d int, text string")
    chars = lambda lines: F.transform(lines, lambda t: F.length(t))
    got = [(r.text, r.n_tokens) for r in heading_chunks(df, "d", "text", 7, counter=chars).orderBy("chunk_no").collect()]
    assert got == [("aa bb\ncc", 7), ("dddd", 4)]


def test_stamps_are_stable(spark):
    df = spark.createDataFrame([("/x/a.txt", "one two three")], "path string, text string")
    rows = [stamp_chunks(window_chunks(df, "path", "text", 2), "path", "document", "2024-01-01").collect() for _ in range(2)]
    assert rows[0] == rows[1] and rows[0][0].source == "a.txt" and rows[0][0].ingested_at == dt.datetime(2024, 1, 1)
    counts = spark.createDataFrame([("a", "x"), ("a", ""), ("b", None)], "source string, text string")
    assert {r.source: (r.n_chunks, r.n_skipped) for r in ingest_counts(counts).collect()} == {"a": (1, 1), "b": (0, 1)}
    assert BUDGET == 800


def test_hashing_embedder_like_brute_force(spark):
    texts = ["Furnace pressure, furnace 12", "", None, "Überdruck é"]
    got = [r.embedding for r in embed_column(spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i"), embedder=hashing_embedder(16)).orderBy("i").collect()]
    for text, vector in zip(texts, got):
        want = np.zeros(16)
        for word in {"Furnace pressure, furnace 12": ["furnace", "pressure", "furnace", "12"], "Überdruck é": ["überdruck", "é"]}.get(text, []):
            h = np.uint64(xxhash.xxh64_intdigest(word, seed=42)).astype(np.int64)
            want[h % 16] += 1 if (h >> 40) & 1 else -1
        if want.any():
            want /= np.linalg.norm(want)
        np.testing.assert_allclose(vector, want, atol=1e-6)


def brute(q, x, k, metric):
    out = {}
    for i, a in enumerate(q):
        if metric == "l2":
            d = ((x - a) ** 2).sum(1)
        elif metric == "dot":
            d = -(x @ a)
        else:
            n = np.linalg.norm(a) * np.linalg.norm(x, axis=1)
            d = 1 - np.divide(x @ a, n, out=np.zeros(len(x)), where=n > 0)
        out[i] = sorted(zip(d.round(9), range(len(x))))[:k]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[17] = x[230] = x[5]
    x[40] = 0
    q = np.vstack([rng.normal(size=(20, 8)), x[5:6]])
    return q, x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "question_id long, embedding array<double>"), spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("max_bytes", [10**6, 0])
def test_exact_top_k(vectors, metric, max_bytes):
    q, x, questions, chunks = vectors
    rows = exact_top_k(questions, chunks, 3, metric, max_bytes=max_bytes).orderBy("question_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.question_id, []).append((round(r.distance, 9), r.chunk_id))
    want = brute(q, x, 3, metric)
    assert {k: [c for _, c in v] for k, v in got.items()} == {k: [c for _, c in v] for k, v in want.items()}
    if metric == "l2":
        assert [c for _, c in got[20]] == [5, 17, 230]


def test_top_k_in_a_crowded_cell(vectors):
    """All vectors in one cell, cut into small blocks on both sides."""
    q, x, questions, chunks = vectors
    cell = F.lit(1).cast("long").alias("cell")
    rows = top_k_in_cells(questions.select("*", cell), chunks.select("*", cell), 3, question_block=4, chunk_block=37).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.question_id, []).append(r.chunk_id)
    assert got == {k: [c for _, c in v] for k, v in brute(q, x, 3, "l2").items()}


def test_approximate_indexes_find_most(vectors):
    q, x, questions, chunks = vectors
    want = {(k, c) for k, v in brute(q, x, 3, "l2").items() for _, c in v}
    full = {(r.question_id, r.chunk_id) for r in cell_top_k(questions, chunks, 3, cells=6, probes=6).collect()}
    assert full == want
    some = {(r.question_id, r.chunk_id) for r in cell_top_k(questions, chunks, 3).collect()}
    assert len(some & want) / len(want) >= 0.9
    hashed = {(r.question_id, r.chunk_id) for r in hashed_top_k(questions, chunks, 3, tables=2).collect()}
    assert len(hashed & want) / len(want) >= 0.9
    with pytest.raises(ValueError):
        nearest_chunks(questions, chunks, index="other")
    with pytest.raises(ValueError):
        exact_top_k(questions, chunks, metric="other")


def clustered(n, groups, seed=0):
    """Vectors around centres, as embeddings of texts are."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, 16))[rng.integers(groups, size=n)] + 0.15 * rng.normal(size=(n, 16))


def stored(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")


@pytest.mark.parametrize("kind,metric", [("cells", "l2"), ("cells", "cosine"), ("hashes", "l2"), ("hashes", "cosine")])
def test_index_recall_and_share_read(spark, tmp_path, kind, metric):
    """Recall of 0.9 or more on questions that are not stored; the share of rows that a question is held against falls with the size."""
    shares = []
    for n in (400, 6400):
        x = clustered(n + 40, n // 40)
        chunks = stored(spark, x[:n])
        questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[n:])], "question_id long, embedding array<double>")
        index = VectorIndex.build(chunks, str(tmp_path / f"{n}"), kind, metric)
        found = {(r.question_id, r.chunk_id) for r in index.search(questions, 3).collect()}
        want = {(q, c) for q, v in brute(x[n:], x[:n], 3, metric).items() for _, c in v}
        assert len(found) == 120 and len(found & want) / len(want) >= 0.9
        again = VectorIndex(spark, index.path)
        assert (again.probes, again.kind, again.metric, again.n) == (index.probes, kind, metric, n)
        visited = again.visits(questions).toPandas()["cell"].to_numpy()
        shares.append(again.sizes[visited].sum() / 40 / n)
    assert shares[1] < 0.5 * shares[0] and shares[1] < 0.2


def test_index_reads_only_the_cells_it_visits(spark, tmp_path):
    x = clustered(2000, 40)
    index = VectorIndex.build(stored(spark, x), str(tmp_path / "i"), probes=2)
    one = spark.createDataFrame([(1, x[7].tolist())], "question_id long, embedding array<double>")
    cells = [r["cell"] for r in index.visits(one).collect()]
    assert 1 <= len(cells) <= 2 and index.search(one, 3).where("rank = 1").first()["chunk_id"] == 7
    plan = index.read(cells)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert {f.split("cell=")[1].split("/")[0] for f in index.read(cells).inputFiles()} >= {str(c) for c in cells}
    assert index.read(cells).count() == index.sizes[cells].sum() < 400


def test_bounds_of_cells_are_sound(spark, tmp_path):
    """No vector is nearer than the bound of its cell, and a cell that is left out holds none of the nearest."""
    x = clustered(1500, 12, seed=3)
    q = clustered(30, 12, seed=4)
    for kind in ("cells", "hashes"):
        index = VectorIndex.build(stored(spark, x), str(tmp_path / kind), kind, probes=10**6)
        far = np.linalg.norm(q[:, None] - x[None], axis=2)
        place = index.model.place(x)[:, 0]
        assert (index.model.bounds(q)[1][:, place] <= far + 1e-9).all()
        questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "question_id long, embedding array<double>")
        got = {(r.question_id, r.chunk_id) for r in index.search(questions, 3).collect()}
        assert got == {(i, c) for i, v in brute(q, x, 3, "l2").items() for _, c in v}
    visits = VectorIndex(spark, str(tmp_path / "cells")).visits(questions)
    assert visits.count() < 30 * len(np.unique(VectorIndex(spark, str(tmp_path / "cells")).model.place(x)))


@pytest.mark.parametrize("kind", ["cells", "hashes"])
def test_index_of_odd_tables(spark, tmp_path, kind):
    same = [(i, [1.0, 2.0]) for i in range(500)] + [(500, None), (501, [0.0, 0.0]), (502, [5.0, 5.0])]
    chunks = spark.createDataFrame(same, "chunk_id long, embedding array<double>")
    questions = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0])], "question_id long, embedding array<double>")
    got = VectorIndex.build(chunks, str(tmp_path / "a"), kind, "cosine", tables=2).search(questions, 2).collect()
    assert sorted((r.question_id, r["rank"], r.chunk_id) for r in got if r.question_id == 0) == [(0, 1, 0), (0, 2, 1)]
    assert {r.question_id for r in got} == {0, 2}
    none = VectorIndex.build(chunks.limit(0), str(tmp_path / "b"), kind)
    assert none.n == 0 and none.search(questions, 2).count() == 0
    few = VectorIndex.build(chunks.where("chunk_id > 499"), str(tmp_path / "c"), kind).search(questions, 5)
    assert few.groupBy("question_id").count().where("count = 2").count() == 2
    for bad in ({"kind": "tree"}, {"metric": "dot"}):
        with pytest.raises(ValueError):
            VectorIndex.build(chunks, str(tmp_path / "d"), **bad)


def test_answers(spark):
    chunks = spark.createDataFrame([
        ("c1", "furnace pressure limits", "/d/a.txt", "document", None), ("c2", "coffee machine manual", "/d/b.txt", "document", None),
        ("c3", "furnace pressure diagram", "/d/p.png", "image_description", "p.png"), ("c4", "", "/d/e.txt", "document", None),
    ], "chunk_id string, text string, source string, type string, image_file string")
    questions = spark.createDataFrame([(1, "furnace pressure")], "question_id int, query string")
    row = answer_questions(questions, chunks, k=2).first()
    assert row.context.split("\n\n") == [c.preview[:-3] for c in row.sources] and row.error is None
    assert {s.chunk_id for s in row.sources} == {"c1", "c3"} and row.prompt.endswith("\n\nQuestion: furnace pressure")
    assert "- Img *p.png* (match" in row.cited and "- Doc *a.txt* (match" in row.cited
    none = answer_questions(questions, chunks.limit(0)).first()
    assert none.error and none.sources is None


def test_metadata(spark):
    text = '{"source":"a.pdf","page":3,"ok":true,"none":null,"headings":["A","",null,"B"],"dl_meta":{"x":1},"items":[1,2]}'
    got = column(spark, [text, '{"k":"v"}', '{"headings":"plain"}'], flatten_metadata)
    assert got == [{"source": "a.pdf", "page": "3", "ok": "true", "none": None, "headings": "A > B"}, {"k": "v"}, {"headings": "plain"}]


def test_corpus_log_and_retry(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello world")
    (tmp_path / "B.MD").write_text("# T\nbody text")
    (tmp_path / "empty.txt").write_text(" \n")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.xyz").write_text("?")
    (tmp_path / "e.png").write_bytes(b"png")
    files = scan_files(spark, str(tmp_path))
    log = processing_log(files, document_chunks(files, "2024-01-01"))
    got = {r.file: (r.type, r.status, r.details) for r in log.collect()}
    assert got["a.txt"] == ("Doc", "ok", "1 chunks") and got["B.MD"] == ("Doc", "ok", "1 chunks")
    assert got["d.xyz"] == ("Unknown", "unsupported", "Unsupported type (.xyz)")
    assert got["empty.txt"][1] == got["c.pdf"][1] == got["e.png"][1] == "failed" and got["c.pdf"][2].startswith("Error: ")
    assert {r.file for r in unseen(files, log).collect()} == {"empty.txt", "c.pdf", "d.xyz", "e.png"}
    assert {r.file for r in skipped_log(files, log).collect()} == {"a.txt", "B.MD"}
    # files that are done are not read again, nor is any file that is not text
    again = scan_files(spark, str(tmp_path), log=log)
    assert {r.file for r in again.collect()} == {"empty.txt", "c.pdf", "d.xyz", "e.png"}
    read = lambda df: {f.rsplit("/", 1)[1] for f in df.inputFiles() if str(tmp_path) in f}
    assert read(again) == {"empty.txt"} and read(files) == {"a.txt", "B.MD", "empty.txt"}
    assert {r.file: r.length for r in list_files(spark, str(tmp_path)).collect()}["c.pdf"] == 4
    assert "content" not in list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    pictures = image_chunks(spark.createDataFrame([("/x/e.png", "<b>furnace</b>"), ("/x/f.png", " ")], "path string, text string"), "2024-01-01")
    rows = {r.source: r for r in pictures.collect()}
    # an image that nobody described has no chunk and is logged as failed
    assert rows["e.png"].text == "furnace" and set(rows) == {"e.png"}


def test_log_and_collection_tell_files_of_one_name_apart(spark, tmp_path):
    for folder, text in [("a", "same words"), ("b", " \n"), ("c", "same words")]:
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "readme.md").write_text(text)
    files = scan_files(spark, str(tmp_path / "in"))
    chunks = document_chunks(files, "2024-01-01")
    log = processing_log(files, chunks)
    assert {r.path.split("/")[-2]: (r.status, r.details) for r in log.collect() if r.status == "ok"} == {"a": ("ok", "1 chunks"), "c": ("ok", "1 chunks")}
    assert [r.path.split("/")[-2] for r in unseen(files, log).collect()] == ["b"]
    store = Collection(spark, str(tmp_path / "store"), hashing_embedder(16))
    for _ in range(2):
        store.add(chunks)
    assert store.read().count() == 2


def test_collection_and_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("alpha beta")
    store = Collection(spark, str(tmp_path / "store"), hashing_embedder(16))

    def run():
        ingest_stream(spark, str(inbox), store, str(tmp_path / "state"), "2024-01-01").awaitTermination()
        return store.read().count()

    assert run() == 1
    (inbox / "b.txt").write_text("gamma\n# H\ndelta")
    (inbox / "c.bin").write_text("skipped")
    assert run() == 3
    assert run() == 3
    store.add(store.read().drop("embedding"))
    assert store.read().count() == 3
    best = store.retrieve(spark.createDataFrame([(1, "alpha beta")], "question_id int, query string"), k=1).first()
    assert store.read().where(F.col("chunk_id") == best.chunk_id).first().text == "alpha beta"
    store.add(spark.createDataFrame([("x", "new")], "chunk_id string, text string"), rebuild=True)
    assert [r.chunk_id for r in store.read().collect()] == ["x"]
    store.clear()
    assert store.read().count() == 0
    with pytest.raises(ValueError):
        Collection(spark, "x", index="nope")


def test_merge_pieces(spark):
    rows = [(1, 0, "q", False), (1, 1, "a", True), (1, 2, "b", True), (1, 3, "tool", False), (1, 4, "c", True), (2, 0, "d", True), (2, 1, "e", True)]
    df = spark.createDataFrame(rows, "conv int, turn int, text string, piece boolean")
    got = sorted(tuple(r) for r in merge_pieces(df, ["conv"], ["turn"], "text", F.col("piece")).collect())
    assert got == [(1, 0, 1, False, "q", 0), (1, 1, 2, True, "ab", 0), (1, 3, 1, False, "tool", 0), (1, 4, 1, True, "c", 0), (2, 0, 2, True, "de", 0)]


@pytest.mark.parametrize("window_rows", [2_000_000, 0])
def test_merge_pieces_cuts_long_runs_into_segments(spark, window_rows):
    rows = [(1, i, "xy" * (i % 3) + str(i), True) for i in range(200)] + [(1, 200, "end", False), (2, 0, "\u00e9" * 9, True), (2, 1, None, True), (2, 2, "", True), (2, 3, "z", True)]
    df = spark.createDataFrame(rows, "conv int, turn int, text string, piece boolean")
    got = sorted(tuple(r) for r in merge_pieces(df, ["conv"], ["turn"], "text", F.col("piece"), window_rows, segment_bytes=16).collect())
    want = {}
    for conv, kind in ((1, True), (1, False), (2, True)):
        upto = 0
        for c, turn, text, piece in rows:
            if (c, piece) == (conv, kind):
                held = want.setdefault((c, piece, upto // 16), [turn, 0, ""])
                held[1], held[2] = held[1] + 1, held[2] + (text or "")
                upto += len((text or "").encode())
    assert got == sorted((c, turn, n, piece, text, segment) for (c, piece, segment), (turn, n, text) in want.items())
    with pytest.raises(ValueError):
        merge_pieces(df, ["conv"], ["turn"], "text", F.col("piece"), segment_bytes=0)


def test_classify_steps(spark):
    rows = [
        ("model_output", " think ```\n<end_code>", None), ("model_output", "  ", None), ("tool_call", "```python\nx\n```", "python_interpreter"),
        ("observation", "saved results/plots/a.html now", None), ("observation", "plain text .html", None), ("observation", " done ", None),
        ("error", "boom", None), ("plan", "p", None), ("final_answer", "yes", None), ("final_image", "/x/y.JPEG", None), ("final_audio", "s.mp3", None),
    ]
    out = classify_steps(spark.createDataFrame(rows, "part string, text string, tool_name string")).collect()
    assert [r.message_type for r in out] == ["thought", "tool_call", "tool_result_plot", "tool_result", "tool_result", "error", "plan", "final_answer", "final_answer_file", "final_answer_file"]
    assert out[0].content == "think ```" and out[1].content == "```python\nx\n```" and out[2].path == "results/plots/a.html"
    assert [r.mime_type for r in out[-2:]] == ["image/jpeg", "audio/mpeg"]
    assert column(spark, ["a.wav", "b"], media_type) == ["audio/wav", "image/png"]


def test_python_stages_run_from_another_folder(spark, tmp_path):
    """The package reaches the workers of any session when only the driver's sys.path knows it."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", __spark_entry__.queries()["doc_top_k_l2"](spark, {SMALL!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert f"rows {3 * spark.read.parquet(SMALL + '/embeddings.parquet').count()}" in done.stdout, done.stderr[-2000:]


def test_indexes_always_give_k_rows(spark):
    """A question far from every chunk, and more rows asked for than the probed cells hold."""
    chunks = spark.createDataFrame([(i, [float(i % 5), float(i // 5)]) for i in range(40)], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [500.0, -300.0]), (2, [1.1, 2.2])], "question_id long, embedding array<double>")
    want = {tuple(r) for r in exact_top_k(asked, chunks, 3).where("question_id = 1").collect()}
    for search in (hashed_top_k, cell_top_k):
        assert sorted((r["question_id"], r["rank"]) for r in search(asked, chunks, 3, probes=1).collect()) == [(q, k) for q in (1, 2) for k in (1, 2, 3)]
        assert {tuple(r) for r in search(asked, chunks, 3, probes=100).where("question_id = 1").collect()} == want
    # more than any cell holds: answered exactly
    many = {tuple(r) for r in exact_top_k(asked, chunks, 30).collect()}
    assert {tuple(r) for r in cell_top_k(asked, chunks, 30, cells=16, probes=1).collect()} == many
    assert hashed_top_k(asked, chunks.limit(2), 3).count() == 4


@pytest.mark.parametrize("max_bytes", [10**6, 0])
def test_one_odd_chunk_does_not_hide_the_others(spark, max_bytes):
    """A vector that is not a number is never near, and very long vectors, far groups and copies change no rank."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(60, 8)), 1e6 + 0.1 * rng.normal(size=(60, 8)), np.full((40, 8), 0.5), 1e20 * rng.normal(size=(3, 8)), np.full((1, 8), np.nan)])
    q = np.vstack([x[:5], x[60:65], x[120:122]])
    chunks, asked = stored(spark, x), stored(spark, q).withColumnRenamed("chunk_id", "question_id")
    got = exact_top_k(asked, chunks, 3, max_bytes=max_bytes).orderBy("question_id", "rank").collect()
    want = brute(q, x[:163], 3, "l2")
    assert [(r.question_id, r.chunk_id) for r in got] == [(i, c) for i in sorted(want) for _, c in want[i]]


def test_comparing_a_block_takes_bounded_memory():
    """Many questions, and a batch of chunks that are all equally far from them: neither all distances nor all ties are held."""
    rng = np.random.default_rng(2)
    q = rng.normal(size=(6_000, 16))
    x = np.vstack([np.eye(16)[rng.integers(16, size=5_000)] * np.sign(rng.normal(size=(5_000, 1))), rng.normal(size=(5_000, 16))])
    tracemalloc.start()
    best = Leaders(q, 3, "cosine")
    for turn in range(3):
        best.add(np.arange(10_000) + 10_000 * turn, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * 2**20
    found = pa.Table.from_batches(best.rows(pa.array(np.arange(6_000)), pa.int64())).to_pandas()
    want = brute(q[:40], np.vstack([x, x, x]), 3, "cosine")
    assert {i: g["chunk_id"].tolist() for i, g in found[found["question_id"] < 40].groupby("question_id")} == {i: [c for _, c in v] for i, v in want.items()}


def test_vectors_of_chunks_are_worked_out_once(spark):
    """An embedder may be expensive: neither the count of a cell nor a null filter asks for it again."""
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "question_id long, embedding array<double>")
    for max_bytes in (10**6, 0):
        seen = spark.sparkContext.accumulator(0)

        @F.pandas_udf("array<double>")
        def vector(ids: pd.Series) -> pd.Series:
            seen.add(len(ids))
            return pd.Series([[float(i), 1.0] for i in ids], dtype=object)

        chunks = spark.range(50).select(F.col("id").alias("chunk_id"), vector("id").alias("embedding"))
        assert exact_top_k(asked, chunks, 1, max_bytes=max_bytes).where("question_id = chunk_id").count() == 5
        assert seen.value == 50


def test_letter_vectors(spark):
    texts = ["abba", "", None, "ÄZ 9", "zéa\n" * 1000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", _letter_vector(F.col("text")).alias("v")).orderBy("i").collect()
    for (_, v), t in zip(rows, texts, strict=True):
        counts = [float((t or "").count(chr(97 + i))) if i < 26 else 0.0 for i in range(64)]
        size = sum(c * c for c in counts) ** 0.5
        assert v == [c / size if size else 0.0 for c in counts]
