"""Search by runs of cells: the same rows as one group for every cell, and no vector for every visit."""

import numpy as np
import pytest

from plantlake import session
from plantlake.operators import neighbours, vector_index
from plantlake.operators.neighbours import CellLeaders, completed, top_k_in_cells
from plantlake.operators.vector_index import Runs, VectorIndex, hashed_top_k

SCHEMA = "{} {}, embedding array<{}>"


def vectors(spark, x, name, kind="long", width="double", ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in zip(ids, x)], SCHEMA.format(name, kind, width))


@pytest.mark.parametrize("kind", ["cells", "hashes"])
def test_no_vector_is_written_for_every_visit(spark, tmp_path, monkeypatch, kind):
    """Questions are written once and found rows are few, however many cells are visited."""
    x = np.random.default_rng(1).normal(size=(1500, 12))
    index = VectorIndex.build(vectors(spark, x, "chunk_id"), str(tmp_path / "i"), kind, probes=30)
    written, ranked = [], []

    def settle(df, label="settled", f=vector_index.settle):
        written.append((label, (out := f(df, label)).count()))
        return out

    def rank(candidates, k, f=neighbours.rank_candidates):
        ranked.append(candidates.count())
        return f(candidates, k)

    monkeypatch.setattr(vector_index, "settle", settle)
    monkeypatch.setattr(neighbours, "rank_candidates", rank)
    found = index.search(vectors(spark, x[:300], "question_id"), 3)
    assert found.count() == 900
    assert written and max(n for _, n in written) <= 300
    # one run of cells holds all 1,500 chunks
    assert max(ranked) <= 900


@pytest.mark.parametrize("kind,metric,ids", [("hashes", "l2", "long"), ("cells", "cosine", "string")])
def test_runs_give_the_rows_of_cells(spark, tmp_path, monkeypatch, kind, metric, ids):
    """Small runs and blocks, a crowded cell, copies, ids that come twice, ids and vectors that are null."""
    rng = np.random.default_rng(5)
    x = [*rng.normal(size=(500, 6)).round(1), *[np.ones(6)] * 150, *rng.normal(size=(40, 6)), None]
    keys = [*range(650), *range(100, 140), 5000]
    names = [str(i) for i in keys] if ids == "string" else [None if i == 7 else i for i in keys]
    chunks = vectors(spark, x, "chunk_id", ids, "float", names).unionAll(vectors(spark, x[:60], "chunk_id", ids, "float", names[:60]))
    q = [*rng.normal(size=(70, 6)), np.ones(6), None, np.ones(6), np.full(6, np.nan)]
    questions = vectors(spark, q, "question_id", ids="a".join(["", *map(str, range(len(q)))]).split("a")[1:], kind="string")
    questions = questions.unionAll(vectors(spark, [q[0], q[3]], "question_id", "string", ids=["0", None]))
    for name, value in (("QUESTION_BLOCK", 16), ("LEAST_CHUNKS", 60), ("CHUNK_BLOCK", 100), ("RUN_CELLS", 5)):
        monkeypatch.setattr(vector_index, name, value)
    index = VectorIndex.build(chunks, str(tmp_path / "i"), kind, metric, tables=2, probes=9)
    assert Runs.of(index.sizes, 60).parts.max() > 1
    asked = index.visits(questions, 3, 9)
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]
    everything = index.chunks().select("chunk_id", "embedding").dropDuplicates(["chunk_id"])
    want = completed(top_k_in_cells(asked, index.read(cells), 3, metric), questions, everything, 3, metric)
    got = index.search(questions, 3)
    rows = [sorted(((r["question_id"] or "", r["rank"], r["chunk_id"], r["distance"]) for r in t.collect()), key=str) for t in (got, want)]
    assert len(rows[0]) > 200 and rows[0] == rows[1]


def test_bits_of_visits():
    sizes = np.array([3, 0, 5, 40, 2, 2, 2, 9, 1])
    runs = Runs.of(sizes, 10)
    assert runs.first.tolist() == [0, -1, 0, 1, 5, 5, 5, 6, 6] and runs.parts.tolist() == [1, 1, 1, 4, 1, 1, 1, 1, 1]
    order = np.array([[8, 0, 3], [1, -1, -1], [2, 0, -1], [6, 4, 1]])
    got = [{(v["run"], i) for v in row for i in range(8 * len(v["cells"])) if v["cells"][i >> 3] >> (i & 7) & 1} for row in runs.visits(order).to_pylist()]
    want = [{(int(runs.first[c]) + p, int(runs.at[c])) for c in row if c >= 0 and sizes[c] for p in range(runs.parts[c])} for row in order]
    assert got == want
    wide = Runs.of(np.ones(1000, np.int64), 900)
    order = np.stack([np.random.default_rng(i).permutation(1000)[:300] for i in range(5)])
    for row, visited in zip(order, wide.visits(order).to_pylist()):
        bits = {(v["run"], i) for v in visited for i in range(8 * len(v["cells"])) if v["cells"][i >> 3] >> (i & 7) & 1}
        assert bits == {(int(wide.first[c]), int(wide.at[c])) for c in row}


def test_leaders_of_cells_keep_a_chunk_once():
    """A chunk met in two cells counts once, and copies of it in a first cell do not shut out the next one."""
    q = np.zeros((2, 2))
    best = CellLeaders(q, 2, "l2", np.array([[0b11], [0b10]], np.uint8))
    best.add_cell(0, np.array([5, 5, 6]), np.array([[1.0, 0], [1.0, 0], [3.0, 0]]))
    best.add_cell(1, np.array([5, 9]), np.array([[1.0, 0], [2.0, 0]]))
    assert best.ids.tolist() == [[5, 9], [5, 9]] and best.near.tolist() == [[1, 4], [1, 4]] and best.limit.tolist() == [4, 4]


def test_hashed_top_k_of_nothing(spark):
    chunks = vectors(spark, np.eye(4), "chunk_id")
    assert hashed_top_k(vectors(spark, [None], "question_id"), chunks, 3).count() == 0
    assert hashed_top_k(vectors(spark, np.eye(4), "question_id"), chunks, 3).count() == 12


def test_hashed_top_k_of_many_visits_stays_small(spark, tmp_path, monkeypatch):
    """What a search by hashed buckets leaves in the scratch folder grows with the questions, not with their visits."""
    x = np.random.default_rng(2).normal(size=(1200, 48))
    chunks, questions = vectors(spark, x, "chunk_id", width="float"), vectors(spark, x[:400], "question_id", width="float")
    for probes in (1, 30):
        monkeypatch.setattr(session, "shared_dir", lambda spark, probes=probes: str(tmp_path / str(probes)))
        assert hashed_top_k(questions, chunks, 3, probes=probes).count() == 1200
        assert [spark.read.parquet(str(p)).count() for p in (tmp_path / str(probes)).glob("visits-*")] == [400]
