"""Trained and approximate operators: toxicity, hidden Markov model, vector joins and searches, pipeline, entry point."""

import itertools
import math
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T
import pytest

from plantlake.llm import graph, hmm, neighbour_graph
from plantlake.llm.common import crc_fold, most_frequent
from plantlake.llm.graph import components
from plantlake.llm.neighbour_graph import nearest
from plantlake.llm.range_join import range_join
from plantlake.llm.toxicity import SYMBOLS, CharModel, Reader, score_texts, symbol, train_char_model, train_toxic_model, word_features

from llm_tables import ODD, docs  # noqa: F401

MILD = ["river", "stone", "garden", "window", "letter", "market", "winter", "yellow", "basket", "castle"]


def test_components(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7), (5, 4)]
    lead = {}

    def top(x):
        lead.setdefault(x, x)
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in links:
        if a != b:
            a, b = top(a), top(b)
            lead[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: top(n) for n in lead}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components_of_few_links_take_few_tasks(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_LINKS", few, raising=False)
    rng = random.Random(7)
    # a long chain, a ring, a node with many neighbours, chance links, and nodes that several roots share
    links = [(i, i + 1) for i in range(100, 160)] + [(i, 200 + (i + 1) % 20) for i in range(200, 220)] + [(300, i) for i in range(301, 340)]
    links += [(rng.randint(400, 480), rng.randint(400, 480)) for _ in range(60)] + [(599, 500), (599, 501), (598, 501), (598, 502), (5, 5)]
    want = {}
    for a, b in links:
        for x in (a, b):
            want.setdefault(x, x)
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    own = {"spark.sql.shuffle.partitions": "41", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        found = components(spark.createDataFrame(links, "a long, b long"))
        got = {r["node"]: r["component"] for r in found.collect()}
        files = len(found.inputFiles())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert not few or files <= 2 * spark.sparkContext.defaultParallelism


def test_most_frequent_keeps_ties_together(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([9, 5, 5, 3, 3, 3, 1])], "k int, n long")
    assert sorted(r["n"] for r in most_frequent(df, 5).collect()) == [5, 5, 9]
    assert most_frequent(df, 7).count() == 7 and most_frequent(df.where("n = 3"), 2).count() == 0


def test_symbols():
    assert [symbol(c) for c in "az é-7×"] == [1, 26, 0, SYMBOLS - 1, 0, 0, 0]


def test_char_model_counts_every_word(docs):
    model = train_char_model(docs(["ab ab", None, "", "b"]))
    assert isinstance(model, CharModel) and model.logp.shape == (SYMBOLS**4,)
    p = np.exp(model.logp.reshape([SYMBOLS] * 4).astype(float))
    assert np.allclose(p.sum(axis=-1), 1.0, atol=1e-4)
    assert p[0, 0, 0, 1] > p[0, 0, 0, 2] > p[0, 0, 0, 3] and p[0, 0, 1, 2] > 0.4


def test_viterbi_finds_the_best_path(docs):
    """Against every path of a lattice."""
    model = train_char_model(docs(["moron idiot loser"] * 5 + ["lot dir mono soil"]))
    for lattice in (
        [[("i", -0.1), ("l", -0.1)], [("d", -0.1)], [("i", -0.2), ("l", -0.2)], [("o", 0.0), ("", -1.0)], [("t", 0.0)]],
        [[("l", 0.0)], [("o", -0.1)], [("o", -0.1), ("", -1.2)], [("s", -2.3), ("5", -0.1)], [("", -0.1), (" ", -3.0)], [("e", 0.0)], [("r", 0.0)]],
    ):
        def cost(path):
            state, total = (0, 0, 0), 0.0
            for char, c in [*path, (" ", 0.0)]:
                total += c
                if char:
                    d = symbol(char)
                    total += float(model.logp[((state[0] * SYMBOLS + state[1]) * SYMBOLS + state[2]) * SYMBOLS + d])
                    state = (state[1], state[2], d) if d else (0, 0, 0)
            return total

        best = max(itertools.product(*lattice), key=cost)
        assert model.decode(lattice) == "".join(c for c, _ in best).strip()


def toxic_table(n=700):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(MILD) for _ in range(rng.randint(5, 30))]
        bad = rng.random() < 0.3
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "scum"])
            words.insert(0, rng.choice(["idiot", "moron", "scum"]))
        texts.append(" ".join(words))
        labels.append((i, 0, int(bad)))
    return texts, labels


def test_toxicity(spark, docs):
    texts, labels = toxic_table()
    hidden = ["river 1d10t stone", "garden i d i o t window", "letter m0r0n castle", "market iiidiiooot winter", "m.o.r.o.n garden", "$cum river"]
    clean = ["river stone garden", "rrriver st0ne", "a b c d", "r i v e r", "1234 5678"]
    table = docs(texts + hidden + clean + ODD)
    known = spark.createDataFrame(labels + [(None, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    model = train_toxic_model(table, known)
    reader = Reader(model.chars, model.lexicon)
    assert [reader.tokens(t) for t in ("x i d i o t y", "m.o.r.o.n")] == [["x", "idiot", "y"], ["moron"]]
    assert [reader.word(t) for t in ("1d10t", "m0r0n!", "iiidiiooot", "$cum", "river", "2024")] == ["idiot", "moron", "idiot", "scum", "river", "2024"]
    out = score_texts(table, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "n", "score"] and out.dtypes[-1] == ("score", "double")
    got = {r[0]: r[-1] for r in out.collect()}
    at = len(texts)
    held = [i for i in range(at) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == bool(labels[i][2]) for i in held)
    assert right >= 0.97 * len(held)
    assert all(got[at + i] >= 0.5 for i in range(len(hidden))), [(t, got[at + i]) for i, t in enumerate(hidden)]
    assert all(got[at + len(hidden) + i] < 0.5 for i in range(len(clean) + len(ODD)))


def test_toxicity_of_signs_at_edges_long_words_and_wide_spacing(spark, docs):
    texts, labels = toxic_table()
    drawn = "i" + "d" * 30 + "i" * 12 + "ot"
    hidden = ["river !diot stone", "garden idio+ window", f"letter {drawn} castle", "market 1 d ! 0 t winter", "$ c u m river", "stone i  d . i  o  t garden", "river (!d1ot!) stone"]
    clean = ["river! stone (garden) +winter", "| r | i | v |", "r i v e r !", "| | | |", "(a + b)"]
    table = docs(texts + hidden + clean)
    model = train_toxic_model(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    reader = Reader(model.chars, model.lexicon)
    assert [reader.word(t) for t in ("!diot", "idio+", drawn, "(!d1ot!)", "moron!!!", "(river)", "river!", "!!!", "")] == ["idiot"] * 4 + ["moron", "river", "river", "", ""]
    assert [reader.tokens(t) for t in ("1 d ! 0 t", "$ c u m", "i  d . i  o  t", "m o r o n !")] == [["idiot"], ["scum"], ["idiot"], ["moron"]]
    got = {r["doc_id"]: r["score"] for r in score_texts(table, model).collect()}
    at = len(texts)
    assert all(got[at + i] >= 0.5 for i in range(len(hidden))), [(t, got[at + i]) for i, t in enumerate(hidden)]
    assert all(got[at + len(hidden) + i] < 0.5 for i in range(len(clean)))


def test_toxicity_does_not_learn_from_held_out_labels(spark, docs):
    texts, labels = toxic_table(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (train_toxic_model(docs(texts), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert a.lexicon == b.lexicon and np.allclose(a.weights, b.weights)
    empty = train_toxic_model(docs([]), spark.createDataFrame([], schema))
    assert not empty.lexicon and score_texts(docs(["x"]), empty).first()["score"] < 0.5
    assert word_features("abcdefgh") == ["=abcdefgh", "abcd", "abcde", "abcdef", "abcdefg"]


def plain_forward(model, symbols):
    """Sum over all state paths, unscaled."""
    alpha = model.start * model.emit[:, symbols[0]]
    for s in symbols[1:]:
        alpha = (alpha @ model.move) * model.emit[:, s]
    return math.log(alpha.sum())


def small_model(rng, states=3, symbols=6):
    rows = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1])
    return hmm.HiddenMarkov(rows(states), rows(states, states), rows(states, symbols))


def test_forward_recursion_is_exact(monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 25)
    rng = np.random.default_rng(1)
    model = small_model(rng)
    seqs = [rng.integers(0, 6, n).astype(np.int16) for n in (1, 9, 4, 4, 30, 2)]
    got = np.zeros(len(seqs))
    for mine, padded, running in hmm._blocks(seqs):
        got[mine] = hmm.forward(model, padded, running, keep=False)[0]
    assert np.allclose(got, [plain_forward(model, s) for s in seqs])
    brute = sum(
        model.start[p[0]] * model.emit[p[0], seqs[2][0]] * math.prod(model.move[a, b] * model.emit[b, s] for a, b, s in zip(p, p[1:], seqs[2][1:]))
        for p in itertools.product(range(3), repeat=4)
    )
    assert got[2] == pytest.approx(math.log(brute))


def test_expected_counts_by_enumeration_and_rising_likelihood(monkeypatch):
    rng = np.random.default_rng(2)
    model = small_model(rng)
    seqs = [rng.integers(0, 6, n).astype(np.int16) for n in (3, 4, 1)]
    starts, moves, emits, total = hmm.expected_counts(model, seqs)
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((3, 6))]
    for s in seqs:
        paths = {p: model.start[p[0]] * model.emit[p[0], s[0]] * math.prod(model.move[a, b] * model.emit[b, x] for a, b, x in zip(p, p[1:], s[1:])) for p in itertools.product(range(3), repeat=len(s))}
        whole = sum(paths.values())
        for p, w in paths.items():
            want[0][p[0]] += w / whole
            for a, b in zip(p, p[1:]):
                want[1][a, b] += w / whole
            for state, x in zip(p, s):
                want[2][state, x] += w / whole
    for got, w in zip((starts, moves, emits), want):
        assert np.allclose(got, w)
    for _ in range(5):
        starts, moves, emits, before = hmm.expected_counts(model, seqs)
        model = hmm.HiddenMarkov(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
        assert hmm.expected_counts(model, seqs)[3] >= before - 1e-9


def test_language_model_scores(docs, monkeypatch):
    """Base scores and counts against plain counting, on both sides of the limit of sent words; the model beats the base."""
    rng = random.Random(7)
    tongues = [[f"{c}{i}x" for i in range(40)] for c in "abc"]
    texts = [" ".join(rng.choice(rng.choice([t, t])) for _ in range(rng.randint(1, 60))) for t in (tongues[rng.randrange(3)] for _ in range(250))]
    texts += ODD + ["never seen words", "A0X a0x"]
    tokens = [(t or "").encode().lower().split() for t in texts]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    counts = Counter(w for ws, t in zip(tokens, train) if t for w in ws)
    ends, total = sum(train), sum(counts.values()) + sum(train)
    room = total + 0.5 * (len(counts) + 2)
    results = []
    for sent in (hmm.SENT, 20):
        monkeypatch.setattr(hmm, "SENT", sent)
        got = {r["doc_id"]: r for r in hmm.score_texts(docs(texts), crc_fold(F.col("doc_id"), 5) != 1, states=3).collect()}
        gain = 0.0
        for i, ws in enumerate(tokens):
            want = sum(math.log10((counts[w] + 0.5) / room) for w in ws) + math.log10((ends + 0.5) / room)
            assert got[i]["base_score"] == pytest.approx(want) and got[i]["train"] == train[i]
            assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, total)
            gain += 0.0 if train[i] else got[i]["score"] - got[i]["base_score"]
        assert gain > 0
        results.append(got)
    assert {i: r["base_score"] for i, r in results[0].items()} == pytest.approx({i: r["base_score"] for i, r in results[1].items()})
    assert hmm.score_texts(docs([]), F.lit(True)).count() == 0
    alone = hmm.score_texts(docs(["a b"]), F.lit(False)).first()
    assert alone["n_known"] == 0 and alone["train_tokens"] == 0 and alone["score"] < 0


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("cid", T.StringType())])


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VECTORS)


def cloud(seed, n, groups=4, width=8):
    """Scattered vectors, tight and chained groups, exact copies, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    out = list(rng.normal(size=(n, width)))
    for g in range(groups):
        centre = rng.normal(size=width)
        out += [centre + rng.normal(size=width) * 0.12 * (g + 1) for _ in range(15)]
    out += [out[0]] * 4 + [out[3] * 5.0]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]
    order = rng.permutation(len(rows))
    rows = [(int(k), v) for k, (_, v) in zip(order, rows)]
    at = len(rows)
    nan, inf = float("nan"), float("inf")
    return rows + [(at, None), (at + 1, [0.0] * width), (at + 2, [1.0, None] + [0.0] * (width - 2)), (at + 3, [nan] * width), (at + 4, [inf] + [0.0] * (width - 1)), (at + 5, [])]


def usable_rows(rows):
    return [(i, np.array(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]


@pytest.mark.parametrize("cell,block", [(8_192, 8_192), (20, 7), (40, 1_000)])
def test_range_join(vectors, cell, block):
    rows = cloud(cell, 120)
    good = usable_rows(rows)
    links, lead = Counter(), {i: i for i, _ in rows}

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for (i, a), (j, b) in itertools.combinations(good, 2):
        if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.9:
            links[i] += 1
            links[j] += 1
            x, y = top(i), top(j)
            lead[max(x, y)] = min(x, y)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in range_join(vectors(rows), 0.9, cell, block).collect()}
    assert got == {i: (links[i], top(i), top(i) == i) for i, _ in rows} and sum(links.values()) > 100


def test_range_join_of_odd_tables(vectors):
    assert range_join(vectors([])).count() == 0
    got = range_join(vectors([(1, None), (2, [0.0])])).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got] == [(0, 1, True), (0, 2, True)]
    rows = [(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0, 0.0])]
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in range_join(vectors(rows)).collect()) == [(0, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4)]


def test_nearest(vectors):
    rows = cloud(5, 700, width=6)
    good = usable_rows(rows)
    found = {}
    for r in nearest(vectors(rows), F.col("vec_id") % 10 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i, _ in good if i % 10 == 0]
    assert sorted(found) == sorted(asked)
    at, hits = dict(good), 0
    for q in asked:
        want = sorted((float(np.linalg.norm(at[q] - v)), i) for i, v in good if i != q)[:10]
        mine = sorted(found[q])
        assert [k for k, _, _ in mine] == list(range(1, 11))
        assert [(d, i) for _, i, d in mine] == sorted((d, i) for _, i, d in mine)
        for _, i, d in mine:
            assert d == pytest.approx(float(np.linalg.norm(at[q] - at[i])), abs=1e-12) and i != q
        hits += len({i for _, i in want} & {i for _, i, _ in mine})
    assert hits >= 0.9 * 10 * len(asked)


def recall(rows, got, k=10):
    """Share of the true nearest among the rows found, and rows per query."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    mine, hits = {}, 0
    for r in got:
        mine.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, found in mine.items():
        d = ((x - x[ids == q][0]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hits += len(found & set(ids[np.argsort(d, kind="stable")[:k]].tolist()))
    return hits / (k * max(1, len(mine))), {q: len(f) for q, f in mine.items()}


@pytest.mark.parametrize("longest,noise", [(1_000.0, 0.0), (1.0, 0.001)])
def test_nearest_of_long_vectors_and_near_copies(vectors, longest, noise):
    """One vector far longer than the rest; a group of thousands of near copies."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if noise:
        x[:2_500] = x[0] + rng.normal(size=(2_500, 16)) * noise / 4.0
    x[2_999] *= longest
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    share, sizes = recall(rows, nearest(vectors(rows), F.col("vec_id") % 60 == 0).collect())
    assert share >= 0.9 and set(sizes.values()) == {10} and len(sizes) == 50


def test_nearest_of_vectors_apart(vectors):
    """A few vectors opposite to all others, which lie around a common mean, have whole answers too."""
    rng = np.random.default_rng(12)
    x = np.full(16, 1.0) + rng.normal(size=(2_000, 16)) * 0.2
    x[:5] = -x[:5]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    got = nearest(vectors(rows), (F.col("vec_id") < 5) | (F.col("vec_id") % 100 == 0)).collect()
    share, sizes = recall(rows, got)
    assert share >= 0.9 and len(sizes) == 24 and set(sizes.values()) == {10}


def test_nearest_when_the_graph_leaves_queries_short(vectors, monkeypatch):
    """Walks that find next to nothing: all rows are compared, in blocks, with ties to smaller ids and copies as rows of their own."""
    rng = np.random.default_rng(13)
    monkeypatch.setattr(neighbour_graph, "search", lambda codes, graph, queries: queries.select("qid", F.array("qid").alias("near")))
    monkeypatch.setattr(neighbour_graph, "EXACT_BYTES", 400)
    rows = [(i, [float(c) for c in rng.integers(1, 4, size=4)]) for i in range(300)]
    found = {}
    for r in nearest(vectors(rows), F.col("vec_id") % 30 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {i: np.array(v) for i, v in rows}
    assert sorted(found) == list(range(0, 300, 30))
    for q, mine in found.items():
        want = sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)[:10]
        assert [(d, i) for _, i, d in sorted(mine)] == want


def test_nearest_of_odd_tables(vectors):
    assert nearest(vectors([]), F.lit(True)).count() == 0
    assert nearest(vectors([(1, [1.0]), (2, None)]), F.lit(True)).count() == 0
    copies = nearest(vectors([(i, [1.0, 2.0]) for i in range(30)] + [(99, [1.0, 2.5])]), F.col("vec_id").isin(4, 99)).collect()
    got = {q: [r["vec_id"] for r in sorted(copies, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (4, 99)}
    assert got == {4: [0, 1, 2, 3, 5, 6, 7, 8, 9, 10], 99: list(range(10))}


def test_pipeline_stages(spark, tmp_path):
    """Every stage against a plain version of itself, on a table where each decides something."""
    import corpus_pipeline

    texts, labels = toxic_table(400)
    rng = random.Random(9)
    texts += [t + " extra" for t in texts[:3]] + [" ".join(rng.choice(MILD) + str(rng.randint(0, 99)) for _ in range(60))] * 3 + ['secret = "abcdefgh12345" river', None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "secrets", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    stayed = {r["doc_id"] for r in kept["toxicity"]}
    assert not any(w in (texts[i] or "") for i in stayed for w in ("idiot", "moron", "scum")) and stayed >= {i for i, t in enumerate(texts) if t and not any(w in t for w in ("idiot", "moron", "scum"))}
    sets = {i: {tuple((texts[i] or "").split()[k : k + 5]) for k in range(max(1, len((texts[i] or "").split()) - 4))} for i in stayed}
    lead = {i: i for i in stayed}
    for i in sorted(stayed):
        for j in sorted(stayed):
            if j < i and texts[i] and texts[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                lead[i] = min(lead[i], lead[j])
    assert {r["doc_id"] for r in kept["ngram_join"]} == {i for i in stayed if lead[i] == i}
    assert len(kept["secrets"]) == len(kept["ngram_join"]) and [r["text"] for r in kept["secrets"] if r["doc_id"] == len(texts) - 3] == ["[SECRET]\" river"]
    assert all(r["n_chars"] == len(r["text"]) for r in kept["secrets"] if r["text"] is not None)
    size = Counter()
    for r in kept["secrets"]:
        size[r["source"]] += len((r["text"] or "").split())
    mixed = Counter()
    for r in kept["mixing"]:
        mixed[r["source"]] += len(r["text"].split())
    assert sum(mixed.values()) == pytest.approx(1.5 * sum(size.values()), abs=3) and all(mixed[s] <= 2 * size[s] for s in size)
    assert sum(r["start"] == 0 for r in kept["packing"]) == len(kept["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["packing"])


def test_entry_point_lives_without_the_subpackage(tmp_path):
    """The other queries import when plantlake.llm and the pipeline are gone; any other missing module is an error."""
    code = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in GONE:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), any(q.startswith("op") or q == "pipeline" for q in e.queries()))
"""
    root = __file__.rsplit("/tests/", 1)[0]
    run = lambda gone: subprocess.run([sys.executable, "-c", f"GONE = {gone!r}\n{code}"], cwd=root, capture_output=True, text=True, timeout=120)
    without = run(["corpus_pipeline", "plantlake.llm"])
    assert without.returncode == 0 and without.stdout.split()[-1] == "False", without.stderr
    assert run(["tokenizers_missing"]).stdout.split()[-1] == "True"
    assert run(["pyarrow"]).returncode != 0


def test_batches_of_the_graph_are_small(spark):
    """Rows that carry codes of all neighbours travel a few at a time, and the caller's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    x = np.random.default_rng(5).normal(size=(700, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    with neighbour_graph._small_batches(spark):
        sizes = vectors.select("vec_id").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"vec_id": [b.num_rows]}) for b in batches), "vec_id long").collect()
    assert sorted(r.vec_id for r in sizes) == [200, 500]
    spark.conf.set(name, "300")
    try:
        got = nearest(vectors, F.col("vec_id") == 7, 2).orderBy("rank").collect()
        assert spark.conf.get(name) == "300"
    finally:
        spark.conf.set(name, before)
    assert [r.vec_id for r in got] == np.argsort(((x - x[7]) ** 2).sum(axis=1), kind="stable")[1:3].tolist()
