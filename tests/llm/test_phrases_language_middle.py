"""Collocations, language by cross-parsing and fill-in-the-middle against brute force."""

from collections import Counter
import hashlib
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F
import pytest

from plantlake.llm import collocations as phrases, fim, language, queries
from plantlake.llm.common import crc_fold
from plantlake.llm.fim import SkipList, cut, fill_in_middle, restored, unit_widths
from plantlake.llm.language import LanguageModel, plain_bytes, predict_language, suffix_automaton, train_language_model

from llm_tables import DOCS, ODD, docs  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def brute_phrases(rows, least, top, cover):
    counts, totals = {}, Counter()
    for lang, text in rows:
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        wide = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in wide.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    around[p[s : s + m]] = max(around[p[s : s + m]], a)
        found = []
        for p, a in wide.items():
            if around[p] and 100 * around[p] >= cover * a:
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("bits,together,long,top", [(17, 1_500_000, 4_000_000, 2_000), (3, 40, 60, 7)])
def test_collocations(spark, monkeypatch, bits, together, long, top):
    """Also with pairs that share counters, windows that are counted in many parts, and long texts that are cut."""
    monkeypatch.setattr(phrases, "TOGETHER", together)
    monkeypatch.setattr(phrases, "LONG", long)
    rng = random.Random(5)
    words = ["The", "big", "Mill", "é", "x y", "\x1c", "of", "steel", "ß", "runs"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " : "]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text + (" cast iron pan handle" * 3 if i % 3 else ""), rng.choice(["en", "de", None])))
    rows += [(None, None, "en"), (1, "", "fr"), (2, " \t\n", None), (3, "big Mill of steel " * 300, "en"), (3, "big Mill of steel " * 300, "en")]
    table = spark.createDataFrame([(i, t, g, "n", "w1", 0) for i, t, g in rows], "doc_id long, text string, lang string, n string, w1 string, phrase int")
    got = sorted(tuple(r) for r in phrases.collocations(table, least=5, top=top, bits=bits).collect())
    assert got == brute_phrases([(g, t) for _, t, g in rows], 5, top, 80) and {g[0] for g in got} >= {"en", "de", "und"}


def test_collocations_of_an_empty_table(docs):
    assert phrases.collocations(docs([])).count() == 0
    assert phrases.collocations(docs(ODD), bits=10, least=2).where("lang = 'en'").count() > 0


def test_scores_pass_64_bits(spark):
    """floor(2,000,000 * a / (l + r)) with counts beyond 2^43."""
    a, l, r = 9 * 10**15, 10**16, 10**16 + 1
    row = spark.range(1).select(F.expr(f"(cast({2 * phrases.SCALE} as decimal(10,0)) * cast({a} as decimal(20,0))) div (cast({l} as decimal(20,0)) + cast({r} as decimal(20,0)))").alias("s")).first()
    assert row["s"] == 2_000_000 * a // (l + r)


def test_collocations_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(queries.ORACLES["op11_collocations"])
    names = [c[0] for c in want.description]
    got = queries.op11_collocations(spark, SMALL)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


def test_suffix_automaton_accepts_the_substrings_only():
    rng = random.Random(2)
    for _ in range(30):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25)))
        moves = suffix_automaton(np.frombuffer(data, np.uint8))
        assert len(moves) <= max(1, 2 * len(data))
        for _ in range(200):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 8)))
            state = 0
            for c in word:
                state = moves[state].get(c) if state is not None else None
            assert (state is not None) == (word in data)


def cross_parse(data, sample):
    """Phrases by definition: the longest that occurs in the sample, or one byte."""
    n = at = 0
    while at < len(data):
        end = at + 1
        while end < len(data) and data[at : end + 1] in sample:
            end += 1
        n, at = n + 1, end
    return n


def test_phrases_are_the_longest_matches(spark, monkeypatch):
    rng = random.Random(3)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"aa": draw("abc  ", 300), "bb": draw("cde  ", 300), "cc": draw("aeé  ", 200)}
    table = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(samples.items())], "doc_id long, text string, lang string")
    model = train_language_model(table, F.lit(True))
    texts = [draw("abcdeéz .", n) for n in (1, 5, 60, 400, 511, 512, 1400)] + [""]
    data = [plain_bytes(t) if t else b"" for t in texts]
    got = model.phrases(data)
    for i, d in enumerate(data):
        for j, name in enumerate(model.names):
            sample = plain_bytes(samples[name])
            pieces = [d[at : at + language.PIECE] for at in range(0, len(d), language.PIECE)]
            assert got[i, j] == sum(cross_parse(p, sample) for p in pieces), (i, name)


def test_language(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    model = train_language_model(table, ~held_out)
    found = predict_language(table, model).where(held_out).select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"), "score").collect()
    assert np.mean([r["ok"] for r in found]) >= 0.97 and all(0 <= r["score"] <= 1 for r in found)
    odd = predict_language(docs([*ODD, "12 34 -- ½² !", "中"]), model)
    rows = {r["doc_id"]: r for r in odd.collect()}
    assert [r["lang_pred"] == "und" for _, r in sorted(rows.items())] == [True, True, True, False, False, False, False, False, True, False]
    assert rows[0]["score"] == 0.0 and rows[5]["lang_pred"] == rows[6]["lang_pred"] and odd.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "n", "lang_pred", "score"]
    assert predict_language(docs([]), model).count() == 0


def test_language_learns_only_from_what_it_may(spark):
    rows = [(i, "rot blau gelb " * 5, "de" if i % 2 else None) for i in range(20)] + [(i, "zzz yyy", "xx") for i in range(20, 40)] + [(50, None, "qq")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train_language_model(table, F.col("doc_id") < 20)
    assert model.names == ["de"]
    assert {(r["lang_pred"], r["score"]) for r in predict_language(table.where("text is not null"), model).collect()} == {("de", 1.0)}
    none = train_language_model(table, F.lit(False))
    assert {(r["lang_pred"], r["score"]) for r in predict_language(table, none).collect()} == {("und", 0.0)}
    with pytest.raises(ValueError):
        train_language_model(table, F.lit(True), sample_chars=language.PASSAGE)


def test_sample_is_bounded_and_the_model_small(spark):
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" q")), 300).alias("text"), F.lit("aa").alias("lang"))
    model = train_language_model(table, F.lit(True), sample_chars=20 * language.PASSAGE)
    assert isinstance(model, LanguageModel) and 2 ** model.bits[0] <= 21 * language.PASSAGE and len(model.table) <= 2 * 21 * language.PASSAGE * model.width


UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def test_units_and_ranks():
    rng = random.Random(9)
    for n in [0, 1, 2, 5, 17, 64, 65, 300, 5000]:
        text = "".join(rng.choice(["a", "B", "z", " ", "\n", "é", "\U0001f600", "1", "ſ"]) for _ in range(n))
        units = UNIT.findall(text)
        widths = unit_widths(text)
        assert widths.tolist() == [len(u) for u in units]
        index = SkipList(widths)
        before = [0]
        for u in units:
            before.append(before[-1] + len(u))
        assert [index.points_before(r) for r in range(len(units) + 1)] == before
        for lane in index.lanes:
            assert lane.points.sum() == len(text) and (lane.units is None or lane.units.sum() == len(units))
        assert n < 300 or len(index.lanes) > 2
        with pytest.raises(IndexError):
            index.points_before(len(units) + 1)


def brute_fim(key, text):
    hexed = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[i : i + 8], 16) for i in range(0, 32, 8))
    units = UNIT.findall(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    return (len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")))


def test_fill_in_middle(spark, docs):
    rng = random.Random(4)
    texts = ODD + ["<P", "a<S>b", "x<M>", "<", "<<P", "P><S"] + ["".join(rng.choice(["ab", "C", " ", "<", ">", "P", "S", "M", "é", "\n", "\U0001f600"]) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    table = docs(texts).withColumn("fim", F.lit(1)).withColumn("n", F.lit("kept")).union(docs([], [(None, "no id here", "en", "s", 1, "", "kept", "")]).withColumn("fim", F.lit(1)))
    out = fill_in_middle(table)
    assert out.columns == [*table.columns[:-1], "fim"]
    rows = out.withColumn("back", restored(F.col("fim.form"), F.col("fim.output"))).collect()
    assert len(rows) == len(texts) + 1 and {r["n"] for r in rows} == {"kept"}
    for r in rows:
        assert tuple(r["fim"]) == brute_fim(r["doc_id"], r["text"] or "") and r["back"] == (r["text"] or "")
    assert {r["fim"]["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs([])).count() == 0
    assert cut("", "0" * 64) == (0, "plain", None, None, "")


def test_middle_query(spark):
    rows = queries.op13_fill_in_middle(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, form, prefix, middle, output = brute_fim(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
