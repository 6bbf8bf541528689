import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from plantlake.functions.calendar import date_range_end, date_range_start, parse_rule, period_start
from plantlake.functions.columns import numeric_columns, present
from plantlake.operators.correlate import correlation_matrix, correlation_pairs, strong_pairs
from plantlake.operators.decompose import decompose, infer_period, season_strength
from plantlake.operators.describe import describe, describe_labels, histogram, overview, summarize
from plantlake.operators.outliers import forest_samples, grow_forest, iforest_outliers, mean_depth, outlier_share, zscore_outliers
from plantlake.operators.quantiles import exact_quantiles
from plantlake.operators.resample import resample_mean
from plantlake.ordered import last_before, ordered_chunks, running_total, with_position


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(5)
    stamps = pd.date_range("2024-01-03 05:10", periods=160, freq="11h31min").append(
        pd.DatetimeIndex(["2024-01-07 00:00", "2024-01-31 23:59:59", "2024-03-31 00:00"])
    )
    stamps = stamps.drop(stamps[20:45])
    pdf = pd.DataFrame({"ts": stamps, "value": rng.normal(50, 9, len(stamps)).round(3)})
    pdf.loc[3, "value"] = np.nan
    return pdf.sample(frac=1, random_state=1), spark.createDataFrame(pdf.sample(frac=1, random_state=2), "ts timestamp, value double")


@pytest.mark.parametrize("rule", ["D", "h", "7h", "5h", "90min", "2D", "3D", "W", "2W", "3W", "ME", "2ME", "MS", "2MS", "QE", "YE", "45s", "B", "W-MON", "2W-WED", "W-SAT", "QS", "2QS", "YS"])
def test_resample_like_pandas(readings, rule):
    pdf, df = readings
    if rule == "45s":
        pdf = pdf.sort_values("ts").head(5)
        df = df.where(F.col("ts") <= F.lit(pdf["ts"].max()))
    want = pdf.set_index("ts").sort_index()["value"].resample(rule).mean()
    got = resample_mean(df, "ts", rule).toPandas().set_index("ts").sort_index()["value"]
    assert list(got.index) == list(want.index)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(), rtol=1e-12)


def test_resample_reads_its_input_once(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id * id) AS ts, id AS v, id % 2 AS s FROM range(9)").write.parquet(str(tmp_path / "in"))
    out = resample_mean(spark.read.parquet(str(tmp_path / "in")), "ts", "h", ["v"], series_cols=["s"])
    assert out.inputFiles() and not any(str(tmp_path) in f for f in out.inputFiles())
    # hours 0 to 64 and 1 to 49
    assert out.count() == 65 + 49 and out.where("v is not null").count() == 9


def test_resample_series_are_independent(spark, readings):
    pdf, df = readings
    late = df.withColumn("s", F.lit("b")).withColumn("ts", F.col("ts") + F.expr("interval 50 hours"))
    both = df.withColumn("s", F.lit("a")).unionByName(late)
    got = resample_mean(both, "ts", "7h", ["value"], series_cols=["s"]).toPandas()
    for name, shift in [("a", 0), ("b", 50)]:
        want = pdf.assign(ts=pdf.ts + pd.Timedelta(hours=shift)).set_index("ts").sort_index()["value"].resample("7h").mean()
        one = got[got.s == name].set_index("ts").sort_index()["value"]
        assert list(one.index) == list(want.index)
        np.testing.assert_allclose(one.to_numpy(float), want.to_numpy(), rtol=1e-12)


def test_resample_refuses(spark, readings):
    with pytest.raises(ValueError):
        parse_rule("2X")
    with pytest.raises(ValueError):
        resample_mean(readings[1], "ts", "D", ["nothing"])
    with pytest.raises(Exception, match="buckets in one series"):
        resample_mean(readings[1], "ts", "s", max_buckets=100).collect()


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, True, "x"), (2, float("nan"), False, "y"), (3, None, None, None)], "a int, b double, c boolean, d string")
    assert numeric_columns(df) == ["a", "b"]
    assert present(df, "b").count() == 1
    with pytest.raises(ValueError, match="available columns"):
        numeric_columns(df, ["zz"])
    with pytest.raises(ValueError, match="not numeric"):
        numeric_columns(df, ["c"])


def test_describe_like_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"s": rng.choice(["a", "b"], 3000, p=[0.9, 0.1]), "x": rng.choice([0.0, 1.5, 7.25], 3000), "y": rng.normal(size=3000)})
    df = spark.createDataFrame(pdf)
    for kwargs in [{}, {"percentile_rows": 0}, {"percentile_rows": 0, "accuracy": 50}]:
        got = describe(df, series_cols=["s"], **kwargs).toPandas()
        for _, row in got.iterrows():
            want = pdf[pdf.s == row.s][row["column"]].describe()
            np.testing.assert_allclose(
                [row["count"], row["mean"], row["std"], row["min"], row.q25, row.q50, row.q75, row["max"]], want.to_numpy(), rtol=1e-9)


def test_quantiles_in_chunks_equal_one_window(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"s": ["hot"] * 4000 + ["cold"] * 37, "v": np.concatenate([rng.exponential(size=4000).round(2), rng.normal(size=37)])})
    df = spark.createDataFrame(pdf)
    for rows in [0, 10**6]:
        got = exact_quantiles(df, ["s"], "v", [0.0, 0.01, 0.5, 0.95, 1.0], list("abcde"), accuracy=100, window_rows=rows).toPandas().set_index("s")
        for s in ["hot", "cold"]:
            np.testing.assert_allclose(got.loc[s].to_numpy(float), pdf[pdf.s == s].v.quantile([0.0, 0.01, 0.5, 0.95, 1.0]).to_numpy(), rtol=1e-12)


def test_overview_and_summary(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, "a"), (dt.datetime(2024, 1, 3), float("nan"), None), (dt.datetime(2024, 1, 2), None, "b")],
                               "ts timestamp, v double, t string")
    row = overview(df, "ts").first()
    assert row.shape == [3, 2] and row.columns == ["v", "t"] and row.missing == {"v": 2, "t": 1}
    assert row.time_range.start == dt.datetime(2024, 1, 1) and row.time_range.end == dt.datetime(2024, 1, 3)
    assert summarize(df, "ts").first().stats["v"]["count"] == 1.0
    empty = overview(df.limit(0), "ts").first()
    assert empty.shape == [0, 2] and empty.time_range.start is None
    labels = {r["column"]: r for r in describe_labels(df, ["t"]).collect()}
    assert (labels["t"]["count"], labels["t"]["unique"], labels["t"]["top"], labels["t"]["freq"]) == (2, 2, "a", 1)


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 9, 10]], "v double")
    got = [r["n"] for r in histogram(df, "v", 5).orderBy("bin").collect()]
    assert got == np.histogram([0, 1, 2, 3, 9, 10], 5)[0].tolist()
    flat = histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 3).orderBy("bin").collect()
    assert [r["n"] for r in flat] == [2, 0, 0]


def test_correlation(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(400, 5)) + 1e6, columns=list("abcde"))
    pdf["b"] = pdf["a"] * 2 + rng.normal(size=400) * 0.1
    pdf["e"] = 3.0
    pdf.loc[::7, "c"] = np.nan
    df = spark.createDataFrame(pdf)
    want = pdf.corr()
    import plantlake.operators.correlate as module

    for wide in [30, 1]:
        monkeypatch.setattr(module, "WIDE", wide)
        got = {(r.a, r.b): r.r for r in correlation_pairs(df).collect()}
        for (a, b), r in got.items():
            if np.isnan(want.loc[a, b]):
                assert r is None
            else:
                assert r == pytest.approx(want.loc[a, b], abs=1e-7)
    full = {(r.a, r.b): r.r for r in correlation_matrix(df).collect()}
    assert len(full) == 25 and full["a", "a"] == 1.0 and full["e", "e"] is None and full["b", "a"] == pytest.approx(want.loc["a", "b"], abs=1e-7)
    assert [(r.a, r.b) for r in strong_pairs(correlation_pairs(df)).collect()] == [("a", "b")]
    assert strong_pairs(correlation_pairs(df)).first().label == "a and b: 1.00"
    with pytest.raises(ValueError):
        correlation_pairs(df, ["a"])
    keyed = df.withColumn("s", F.when(F.col("a") > 1e6, "u").otherwise("l"))
    monkeypatch.setattr(module, "WIDE", 1)
    monkeypatch.setattr(module, "HELD_CELLS", 1)
    got = {(r.s, r.a, r.b): r.r for r in correlation_pairs(keyed, list("abcd"), series_cols=["s"]).collect()}
    for s, part in pdf.groupby(np.where(pdf.a > 1e6, "u", "l")):
        assert got[s, "a", "d"] == pytest.approx(part["a"].corr(part["d"]), abs=1e-7)


def numpy_decompose(x, period, model):
    """Independent re-derivation with NumPy."""
    n = len(x)
    w = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    k = len(w) // 2
    trend = np.full(n, np.nan)
    trend[k:n - k] = np.convolve(x, w, "valid")
    if k:
        front, back = k, n - 1 - k
        for at, fill in [(np.arange(front, min(front + period, back)), np.arange(0, front)),
                         (np.arange(max(front, back - period), back), np.arange(back + 1, n))]:
            m, c = np.linalg.lstsq(np.c_[at, np.ones(len(at))], trend[at], rcond=-1)[0]
            trend[fill] = m * fill + c
    de = x - trend if model == "additive" else x / trend
    means = np.array([de[i::period].mean() for i in range(period)])
    means = means - means.mean() if model == "additive" else means / means.mean()
    seasonal = np.tile(means, n // period + 1)[:n]
    resid = x - trend - seasonal if model == "additive" else x / seasonal / trend
    return trend, seasonal, resid


@pytest.mark.parametrize("period,n,model", [(7, 60, "additive"), (24, 200, "additive"), (12, 24, "multiplicative"), (5, 10, "additive"), (4, 9, "multiplicative"), (2, 4, "additive")])
def test_decompose_like_numpy(spark, monkeypatch, period, n, model):
    import plantlake.operators.decompose as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rng = np.random.default_rng(n)
    x = 20 + 0.1 * np.arange(n) + 3 * np.sin(np.arange(n) * 2 * np.pi / period) + rng.normal(size=n)
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for i, v in enumerate(x)]
    rows.insert(5, ("s", dt.datetime(2023, 1, 1), None))
    df = spark.createDataFrame(rows + [("short", dt.datetime(2024, 1, 1), 1.0)], "s string, ts timestamp, v double")
    whole = decompose(df, "ts", "v", period, model, series_cols=["s"]).toPandas().sort_values("pos")
    got = decompose(df, "ts", "v", period, model, series_cols=["s"], window_rows=0).toPandas().sort_values("pos")
    np.testing.assert_allclose(whole[["trend", "seasonal"]], got[["trend", "seasonal"]], rtol=1e-9)
    assert set(got.s) == {"s"} and len(got) == n
    for name, want in zip(["trend", "seasonal", "resid"], numpy_decompose(x, period, model)):
        np.testing.assert_allclose(got[name].to_numpy(), want, rtol=1e-8, atol=1e-9)
    rows = {r.s: r for r in season_strength(df, "ts", "v", period, model, series_cols=["s"]).collect()}
    trend, seasonal, resid = numpy_decompose(x, period, model)
    assert rows["short"].status.startswith("need at least") and rows["short"].trend_strength is None
    assert rows["s"].trend_strength == pytest.approx(max(0, 1 - np.var(resid) / np.var(trend + resid)), abs=1e-9)
    assert rows["s"].season_strength == pytest.approx(max(0, 1 - np.var(resid) / np.var(seasonal + resid)), abs=1e-9)


def test_decompose_parts_add_up_without_series(spark):
    df = spark.range(300).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 24 + F.rand(3)).alias("v"))
    got = decompose(df, "ts", "v", 24).toPandas()
    np.testing.assert_allclose(got.trend + got.seasonal + got.resid, got.observed, rtol=1e-12)
    assert abs(got.sort_values("pos").seasonal.head(24).sum()) < 1e-9
    bad = season_strength(df.withColumn("v", -F.col("v")), "ts", "v", 24, "multiplicative").first()
    assert bad.status == "multiplicative model needs positive values" and bad.trend_strength is None
    with pytest.raises(ValueError):
        decompose(df, "ts", "v", 24, "other")


def test_infer_period(spark):
    def stamps(name, index):
        return [(name, t.to_pydatetime()) for t in index]

    rows = (
        stamps("hour", pd.date_range("2024-01-01 00:30", periods=50, freq="h")) + stamps("day", pd.date_range("2024-01-01", periods=9, freq="D"))
        + stamps("business", pd.bdate_range("2024-01-03", periods=15)) + stamps("week", pd.date_range("2024-01-03", periods=7, freq="7D"))
        + stamps("fortnight", pd.date_range("2024-01-03", periods=7, freq="14D")) + stamps("month end", pd.date_range("2024-01-31", periods=6, freq="ME"))
        + stamps("month start", pd.date_range("2024-01-01", periods=6, freq="MS")) + stamps("quarter hour", pd.date_range("2024-01-01", periods=96, freq="15min"))
        + stamps("gap", pd.date_range("2024-01-01", periods=50, freq="h").delete(7)) + stamps("two", pd.date_range("2024-01-01", periods=2, freq="h"))
        + stamps("twice", pd.date_range("2024-01-01", periods=5, freq="h").append(pd.DatetimeIndex(["2024-01-01"])))
        + stamps("odd week", pd.DatetimeIndex(["2024-01-01", "2024-01-08", "2024-01-22", "2024-02-12"]))
    )
    got = {r.s: (r.frequency, r.period) for r in infer_period(spark.createDataFrame(rows, "s string, ts timestamp"), "ts", series_cols=["s"]).collect()}
    assert got == {
        "hour": ("hour", 24), "day": ("day", 7), "business": ("business day", 5), "week": ("week", 52), "fortnight": ("week", 26),
        "month end": ("month", 12), "month start": ("month", 12), "quarter hour": (None, None), "gap": (None, None), "two": (None, None),
        "twice": (None, None), "odd week": (None, None),
    }


def test_zscore(spark):
    df = spark.createDataFrame([("a", 1.0)] * 20 + [("a", 50.0), ("b", 2.0), ("b", 2.0), ("b", None)], "s string, v double")
    out = zscore_outliers(df, "v", 3.0, series_cols=["s"])
    assert [r.v for r in out.where("is_outlier").collect()] == [50.0]
    share = {r.s: r for r in outlier_share(out, series_cols=["s"]).collect()}
    assert (share["a"].n, share["a"].n_outliers, share["b"].n_outliers) == (21, 1, 0)


def slow_tree(values, rng_at, limit):
    """Path length of each value in one isolation tree, by recursion, with the split taken from ``rng_at``."""
    out = {}

    def grow(part, depth, lo):
        if depth >= limit or part[0] == part[-1]:
            for v in part:
                out[v] = depth + float(mean_depth(len(part)))
            return
        at = rng_at(lo, part)
        left = part[part <= at]
        grow(left, depth + 1, lo)
        grow(part[part > at], depth + 1, lo + len(left))

    grow(values, 0, 0)
    return out


def test_isolation_forest_steps():
    samples = np.sort(np.random.default_rng(1).normal(size=(3, 64)).round(1), axis=1)

    class Middle:
        """Splits in the middle of a node's range, so that the trees are known."""

        def uniform(self, a, b):
            return (a + b) / 2

    points, jumps = grow_forest(samples, Middle())
    x = np.unique(samples)
    got = np.cumsum(jumps)[np.searchsorted(points, x, side="left") - 1]
    trees = [slow_tree(row, lambda lo, part: (part[0] + part[-1]) / 2, 6) for row in samples]
    for value, path in zip(x, got):
        if all(value in t for t in trees):
            assert path == pytest.approx(sum(t[value] for t in trees))
    assert (points[:3] == -np.inf).all() and np.isfinite(points[3:]).all()
    assert mean_depth(2) == 1.0 and mean_depth(1) == 0.0 and mean_depth(256) == pytest.approx(10.2448, abs=1e-3)
    flat = grow_forest(np.full((2, 10), 4.0), np.random.default_rng(0))
    assert len(flat[0]) == 2 and flat[1].sum() == pytest.approx(2 * float(mean_depth(10)))


def test_iforest(spark):
    rng = np.random.default_rng(9)
    n = 2000
    v = rng.normal(1500, 50, n)
    v[700:705] += 400
    rows = [("te", i, float(x)) for i, x in enumerate(v)] + [("flat", i, 5.0) for i in range(50)] + [("te", n, None)]
    df = spark.createDataFrame(rows, "s string, id long, v double")
    one = iforest_outliers(df, "v", ["id"], series_cols=["s"]).toPandas()
    te = one[one.s == "te"].set_index("id")
    assert len(te) == n and te.loc[700:704].is_outlier.all()
    assert te.is_outlier.mean() == pytest.approx(0.05, abs=0.01)
    limit = np.quantile(te.score, 0.95)
    assert (te.is_outlier == (te.score > limit + 1e-12)).all()
    assert not one[one.s == "flat"].is_outlier.any()
    # the same trees and flags however the rows are spread, and by either way of scoring
    other = iforest_outliers(df.repartition(7), "v", ["id"], series_cols=["s"], max_bytes=0).toPandas()
    key = ["s", "id"]
    pd.testing.assert_frame_equal(one.sort_values(key).reset_index(drop=True), other.sort_values(key).reset_index(drop=True))
    alone = iforest_outliers(df.where("s = 'te'").drop("s"), "v", ["id"]).toPandas()
    assert alone.set_index("id").is_outlier.equals(te.is_outlier.reindex(alone.id))
    with pytest.raises(ValueError):
        iforest_outliers(df, "v", ["id"], contamination=0.7)


def test_positions_and_totals_with_a_heavy_series(spark):
    """One series holds most rows; chunks stay even and the numbering has no hole."""
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("s"), (F.hash("id") % 1000).alias("t"), "id")
    for rows in [0, 10**6]:
        got = with_position(df, ["s"], ["t", "id"], total="n", window_rows=rows).toPandas().sort_values(["s", "t", "id"])
        assert (got.pos.to_numpy() == got.groupby("s").cumcount().to_numpy()).all()
        assert (got.n == got.groupby("s").id.transform("size")).all()
        summed = running_total(df, ["s"], ["t", "id"], F.col("id") % 3, "total", rows).toPandas().sort_values(["s", "t", "id"])
        assert (summed.total == (summed.id % 3).groupby(summed.s).cumsum()).all()
        bare = with_position(df.drop("s"), [], ["id"], window_rows=rows).toPandas()
        assert (bare.pos == bare.id).all()
    sizes = ordered_chunks(df, ["s"], ["t", "id"], 8).groupBy("_chunk").count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() < 2 * 5000 / 8


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 30)), min_size=1, max_size=40))
def test_last_before_like_brute_force(spark, rows):
    causes = [("k", t, f"c{i:02d}") for i, (is_cause, t) in enumerate(rows) if is_cause]
    effects = [("k", t, f"e{i:02d}") for i, (is_cause, t) in enumerate(rows) if not is_cause]
    left, right = spark.createDataFrame(causes, "k string, ct int, c string"), spark.createDataFrame(effects, "k string, et int, e string")
    want = {e: max(((ct, c) for _, ct, c in causes if ct <= t), default=(None, None))[1] for _, t, e in effects}
    for limit in [0, 10**6]:
        assert {r.e: r.c for r in last_before(left, right, ["k"], "ct", "et", "c", "e", limit).collect()} == want


def test_calendar_texts(spark):
    df = spark.createDataFrame([("2024-02-05",), ("202402",), ("2024_02",), ("20240105_to_20240203",), (None,)], "r string")
    got = [(str(a), str(b)) for a, b in df.select(date_range_start(F.col("r")), date_range_end(F.col("r"))).collect()]
    assert got == [("2024-02-05", "2024-02-05"), ("2024-02-01", "2024-02-29"), ("2024-02-01", "2024-02-29"), ("2024-01-05", "2024-02-03"), ("None", "None")]
    assert df.select(period_start(F.lit("2024-03-17").cast("date"))).first()[0] == dt.datetime(2024, 2, 1)


def test_summary_is_json(spark, tmp_path):
    from plantlake.sources.timeseries import write_json

    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0)], "ts timestamp, v double")
    write_json(summarize(df, "ts"), str(tmp_path / "s"))
    text = next((tmp_path / "s").glob("part-*.json")).read_text()
    assert json.loads(text)["stats"]["v"]["mean"] == 1.0


def test_null_and_far_series_are_alike_on_both_sides_of_a_switch(spark):
    """A null series stays, a series far from the others keeps its digits, an empty table gives the same rows."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 13))
    base[:, 1] = base[:, 0] + 0.1 * base[:, 1]
    rows = [(s, *map(float, r + (1e8 if s == "far" else 0.0))) for s in [None, "a", "far"] for r in base]
    names = [f"c{i:02d}" for i in range(13)]
    df = spark.createDataFrame(rows, "s string, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    few = {(r.s, r.a, r.b): (r.n, r.r) for r in correlation_pairs(df, names[:12], series_cols=["s"]).collect()}
    many = {(r.s, r.a, r.b): (r.n, r.r) for r in correlation_pairs(df, names, series_cols=["s"]).collect()}
    assert {k[0] for k in many} == {None, "a", "far"} and len(many) == 3 * 78
    for key, (n, r) in few.items():
        assert many[key][0] == n and many[key][1] == pytest.approx(r, abs=1e-6)
    for columns in (names[:12], names):
        pairs = correlation_pairs(df.drop("s").limit(0), columns).collect()
        assert len(pairs) == len(columns) * (len(columns) - 1) // 2 and all(r.n == 0 and r.r is None for r in pairs)
    plain = {(r.s, r.column): tuple(r) for r in describe(df, names[:2], series_cols=["s"]).collect()}
    bands = {(r.s, r.column): tuple(r) for r in describe(df, names[:2], series_cols=["s"], percentile_rows=0).collect()}
    assert set(plain) == set(bands) and len(plain) == 6
    for key, want in plain.items():
        assert bands[key][2:] == pytest.approx(want[2:], rel=1e-9)


def test_quantile_bands_that_miss_are_widened(spark):
    """The first bands are turned inside out, so that none holds its rank."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"s": ["a"] * 3000 + ["b"] * 40 + [None] * 900, "v": rng.normal(size=3940).round(2)})
    df = spark.createDataFrame(pdf, "s string, v double")
    probs, names = [0.0, 0.25, 0.5, 0.99, 1.0], list("pqrtu")
    for series in (["s"], []):
        got = exact_quantiles(df, series, "v", probs, names, accuracy=100, slack=-0.04).toPandas()
        groups = [(k, g.v) for k, g in pdf.groupby("s", dropna=False)] if series else [(None, pdf.v)]
        assert len(got) == len(groups)
        for key, v in groups:
            row = got[got.s.isna() if key is None or key != key else got.s == key].iloc[0] if series else got.iloc[0]
            np.testing.assert_allclose(row[names].to_numpy(float), v.quantile(probs).to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("spare", [4.0, 0.1])
def test_forest_samples_are_the_smallest_hashes_of_all_rows(spark, spare):
    """Also where the first limit lets too few through, and for series shorter than a sample."""
    df = spark.range(3000).select(F.when(F.col("id") < 20, "short").when(F.col("id") < 1000, "mid").otherwise("long").alias("s"), "id", (F.col("id") % 97).cast("double").alias("_v"))
    got = forest_samples(df, ["id"], trees=5, seed=3, series_cols=["s"], sample=50, spare=spare).toPandas()
    full = df.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("h", F.xxhash64(F.lit(3), "t", "id")).withColumn("low", F.pmod("h", F.lit(2**31))).toPandas()
    for (s, t), g in full.groupby(["s", "t"]):
        want = g.sort_values(["low", "h"]).head(50)
        mine = got[(got.s == s) & (got._tree == t)]
        assert sorted(mine._h) == sorted(want.h) and sorted(mine._v) == sorted(want._v)
    assert len(got) == 5 * (50 + 50 + 20)
    alone = forest_samples(df.drop("s"), ["id"], trees=2, sample=50, spare=spare)
    assert alone.count() == 100 and forest_samples(df.where("id < 0").drop("s"), ["id"], trees=2).count() == 0


def test_every_row_can_enter_a_tree(spark):
    """More trees draw more different rows; no pool of fixed size stands in between."""
    df = spark.range(200_000).select("id", F.col("id").cast("double").alias("_v"))
    ids = forest_samples(df, ["id"], trees=100, sample=64)
    assert ids.count() == 6_400 and ids.select("_v").distinct().count() > 6_200


def test_planted_spikes_are_flagged(spark):
    rng = np.random.default_rng(8)
    rows = [("a", i, float(v)) for i, v in enumerate(rng.normal(size=4000))] + [("b", i, float(v)) for i, v in enumerate(rng.uniform(size=300))]
    rows = [(s, i, v + 50.0 if i % 100 == 3 else v) for s, i, v in rows]
    out = iforest_outliers(spark.createDataFrame(rows, "s string, id long, v double"), "v", ["id"], series_cols=["s"]).toPandas()
    assert out[out.id % 100 == 3].is_outlier.all()
    assert (out.groupby("s").is_outlier.mean() <= 0.05).all()
