"""Time-series queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantlake.functions.columns import between, by_time, numeric_columns, present
from plantlake.operators.correlate import correlation_matrix, correlation_pairs, strong_pairs
from plantlake.operators.decompose import (
    decompose, end_lines, infer_period, moving_average, phase_means, positions, season_strength,
)
from plantlake.operators.describe import PERCENTILE_ROWS, describe, describe_labels, histogram, overview, summarize
from plantlake.operators.outliers import iforest_outliers, outlier_share, zscore_outliers
from plantlake.operators.resample import resample_mean
from plantlake.ordered import WINDOW_ROWS
from plantlake.plans.views import busy_table, pick, pick_sql, rounded, stamp, table
from plantlake.session import scratch_path
from plantlake.sources.timeseries import (
    file_name, load_timeseries, long_to_wide, read_sensor_files, tag_dimension, wide_to_long, write_dataset, write_json,
)

TYPE = ["event_type"]
PERIOD = 24


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return resample_mean(table(spark, folder, "events"), "ts", "h", ["value"], series_cols=TYPE)


def _resampled(rule: str, source: str, ts: str, value: str, series: list[str]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = resample_mean(table(spark, folder, source), ts, rule, [value], series_cols=series)
        return out.select(*series, stamp(ts).alias("bucket"), rounded(value).alias("mean_value"))

    return run


def _fixed_sql(step: str, origin: str) -> str:
    """Plain steps of ``step`` from ``origin`` (an SQL expression per series), empty buckets kept."""
    return f"""WITH e AS (SELECT event_type, ts, value, {origin} AS o FROM events),
b AS (SELECT event_type, o, CAST(floor((epoch(ts) - epoch(o)) / {step}) AS BIGINT) AS b, avg(value) AS v FROM e GROUP BY ALL),
g AS (SELECT event_type, o, unnest(range(min(b), max(b) + 1)) AS b FROM b GROUP BY event_type, o)
SELECT g.event_type, strftime(g.o + to_seconds(g.b * {step}), '%Y-%m-%d %H:%M:%S') AS bucket, round(3e-9 + v, 4) + 0.0 AS mean_value
FROM g LEFT JOIN b ON g.event_type = b.event_type AND g.b = b.b"""


def _calendar_sql(unit: str, label: str) -> str:
    """Calendar buckets numbered by ``unit`` (an SQL integer of o_orderdate), labelled by ``label`` (of u)."""
    return f"""WITH b AS (SELECT o_orderpriority, {unit} AS u, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
g AS (SELECT o_orderpriority, unnest(range(min(u), max(u) + 1)) AS u FROM b GROUP BY 1)
SELECT g.o_orderpriority, strftime({label}, '%Y-%m-%d %H:%M:%S') AS bucket, round(3e-9 + v, 4) + 0.0 AS mean_value
FROM g LEFT JOIN b ON g.o_orderpriority = b.o_orderpriority AND g.u = b.u"""


MONTH_NO = "(year(o_orderdate) * 12 + month(o_orderdate) - 1)"
DAY_NO = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"
WEEK_NO = "CAST(floor((date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 3) / 7) AS BIGINT)"


def _month_sql(no: str) -> str:
    return f"make_date(CAST(floor(({no}) / 12) AS BIGINT), ({no}) % 12 + 1, 1)"


def ts_overview(spark, folder):
    out = overview(table(spark, folder, "events"), "ts", series_cols=TYPE)
    return out.select(
        "event_type", F.col("shape")[0].alias("n_rows"), F.col("shape")[1].alias("n_columns"),
        F.array_join("columns", ",").alias("columns"), stamp("time_range.start").alias("start"), stamp("time_range.end").alias("end"),
        F.col("missing")["value"].alias("missing_value"), F.col("missing")["props"].alias("missing_props"),
    )


def _described(percentile_rows: int):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

    def run(spark, folder):
        rows = busy_table(spark, folder, "lineitem", "l_returnflag", *columns)
        out = describe(rows, columns, series_cols=["l_returnflag"], percentile_rows=percentile_rows)
        return out.select("l_returnflag", "column", "count", *[rounded(c).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])

    return run


def _describe_sql(columns: list[str]) -> str:
    one = """SELECT l_returnflag, '{c}' AS "column", count({c}) AS count, round(3e-9 + avg({c}), 4) + 0.0 AS mean, round(3e-9 + stddev_samp({c}), 4) + 0.0 AS std,
round(3e-9 + min({c}), 4) + 0.0 AS min, round(3e-9 + quantile_cont({c}, 0.25), 4) + 0.0 AS q25, round(3e-9 + quantile_cont({c}, 0.5), 4) + 0.0 AS q50,
round(3e-9 + quantile_cont({c}, 0.75), 4) + 0.0 AS q75, round(3e-9 + max({c}), 4) + 0.0 AS max FROM lineitem GROUP BY l_returnflag"""
    return " UNION ALL ".join(one.format(c=c) for c in columns)


def ts_describe_labels(spark, folder):
    return describe_labels(table(spark, folder, "events"), ["event_type", "props"])


def ts_histogram(spark, folder):
    out = histogram(table(spark, folder, "events"), "value", 20, series_cols=TYPE)
    return out.select("event_type", "bin", rounded("from").alias("low"), rounded("to").alias("high"), "n")


def ts_slice(spark, folder):
    out = between(table(spark, folder, "events"), "ts", "2024-01-05 00:00:00", "2024-01-12 12:00:00")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value")).alias("total"))


def ts_by_time(spark, folder):
    return by_time(table(spark, folder, "events"), "ts", TYPE).select("event_type", stamp("ts").alias("at"), "event_id")


def ts_numeric_columns(spark, folder):
    """One row per numeric column: how many values it holds."""
    df = table(spark, folder, "lineitem")
    names = numeric_columns(df)
    held = df.agg(*[F.count(c).alias(c) for c in names])
    return held.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in names])))


def ts_present(spark, folder):
    """Hours with a value per type, of the hours laid out."""
    h = hourly(spark, folder)
    return present(h, "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value")).alias("total"))


def ts_correlation(spark, folder):
    out = correlation_pairs(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], series_cols=["l_returnflag"])
    return out.select("l_returnflag", "a", "b", "n", rounded("r", 6).alias("r"))


def ts_correlation_matrix(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return correlation_matrix(df, ["l_extendedprice", "net", "l_tax"]).select("a", "b", rounded("r", 6).alias("r"))


def ts_strong_pairs(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    pairs = correlation_pairs(df, ["l_quantity", "l_extendedprice", "net", "l_tax"])
    return strong_pairs(pairs).select("a", "b", rounded("r", 6).alias("r"))


def _nation_days(spark, folder):
    """Daily mean order price per customer nation and per (nation, open or not), one column each."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    done = F.when(F.col("o_orderstatus") == "F", "F").otherwise("X")
    long = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderdate").alias("ts"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), done).alias("tag"),
        F.col("o_totalprice").alias("value"),
    )
    tags = [f"n{i}{s}" for i in range(25) for s in "FX"]
    return long_to_wide(long, "ts", tags), tags


def ts_correlation_wide(spark, folder):
    wide, tags = _nation_days(spark, folder)
    return correlation_pairs(wide, tags).select("a", "b", "n", rounded("r", 6).alias("r"))


def _positions(window_rows: int):
    def run(spark, folder):
        out = positions(table(spark, folder, "events"), "ts", "value", series_cols=TYPE, tie_cols=["event_id"], window_rows=window_rows)
        return _position_blocks(out)

    return run


def _position_blocks(out):
    return out.groupBy("event_type", F.floor(F.col("pos") / 100).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum(F.col("pos") * F.col("value")), 2).alias("moment"), F.max("_n").alias("series_rows")
    )


def _averaged(spark, folder):
    rows = positions(hourly(spark, folder), "ts", "value", series_cols=TYPE)
    return moving_average(rows, PERIOD, series_cols=TYPE)


def ts_moving_average(spark, folder):
    return _averaged(spark, folder).select("event_type", stamp("ts").alias("hour"), "pos", rounded("trend").alias("average"))


def ts_moving_average_odd(spark, folder):
    rows = positions(table(spark, folder, "events"), "ts", "value", series_cols=TYPE, tie_cols=["event_id"])
    return moving_average(rows, 7, series_cols=TYPE).select("event_type", "pos", rounded("trend").alias("average"))


def ts_end_lines(spark, folder):
    out = end_lines(_averaged(spark, folder), PERIOD, series_cols=TYPE)
    return out.select("event_type", *[rounded(a, 6).alias(b) for a, b in
                                      [("_hs", "head_slope"), ("_hi", "head_icept"), ("_ts", "tail_slope"), ("_ti", "tail_icept")]])


def ts_phase_means(spark, folder):
    rows = positions(hourly(spark, folder), "ts", "value", series_cols=TYPE)
    out = phase_means(rows, F.col("value"), PERIOD, "additive", series_cols=TYPE)
    return out.select("event_type", F.posexplode("_season").alias("phase", "_s")).select("event_type", "phase", rounded("_s").alias("seasonal"))


def _decomposed(window_rows: int):
    def run(spark, folder):
        return _parts(decompose(hourly(spark, folder), "ts", "value", PERIOD, series_cols=TYPE, window_rows=window_rows))

    return run


def _parts(out):
    return out.select("event_type", stamp("ts").alias("hour"), *[rounded(c).alias(c) for c in ["observed", "trend", "seasonal", "resid"]])


def ts_decompose_multiplicative(spark, folder):
    out = decompose(hourly(spark, folder), "ts", "value", PERIOD, "multiplicative", series_cols=TYPE)
    return out.select("event_type", stamp("ts").alias("hour"), *[rounded(c).alias(c) for c in ["observed", "trend", "seasonal", "resid"]])


def ts_season_strength(spark, folder):
    out = season_strength(hourly(spark, folder), "ts", "value", PERIOD, series_cols=TYPE)
    return out.select("event_type", "n", "status", rounded("trend_strength", 6).alias("trend_strength"), rounded("season_strength", 6).alias("season_strength"))


def ts_season_strength_users(spark, folder):
    """Raw readings of every user, period 7: many short series, some too short."""
    out = season_strength(table(spark, folder, "events"), "ts", "value", 7, series_cols=["user_id", "event_type"], tie_cols=["event_id"])
    return out.select("user_id", "event_type", "n", F.when(F.col("status") == "ok", "ok").otherwise("short").alias("status"),
                      rounded("trend_strength", 5).alias("trend_strength"), rounded("season_strength", 5).alias("season_strength"))


def ts_infer_period(spark, folder):
    """Frequency of the hourly, daily and monthly means of orders and events."""
    e, o = table(spark, folder, "events"), table(spark, folder, "orders")
    parts = [
        resample_mean(e, "ts", rule, ["value"]).select(F.lit("events " + rule).alias("grid"), "ts") for rule in ["h", "D", "15min"]
    ] + [
        resample_mean(o, "o_orderdate", rule, ["o_totalprice"]).select(F.lit("orders " + rule).alias("grid"), F.col("o_orderdate").alias("ts"))
        for rule in ["W", "2W", "M", "MS"]
    ]
    grids = parts[0]
    for p in parts[1:]:
        grids = grids.unionByName(p)
    return infer_period(grids, "ts", series_cols=["grid"]).select("grid", "n", "frequency", "period")


def ts_zscore(spark, folder):
    out = zscore_outliers(table(spark, folder, "events"), "value", 3.0, series_cols=TYPE)
    return out.select("event_id", rounded("z").alias("z"), "is_outlier")


def ts_outlier_share(spark, folder):
    flagged = zscore_outliers(table(spark, folder, "events"), "value", 2.0, series_cols=["user_id"])
    out = outlier_share(flagged, series_cols=["user_id"])
    return out.select("user_id", "n", "n_outliers", rounded("pct_outliers").alias("pct_outliers"))


def ts_iforest(spark, folder):
    """Every reading with its isolation score and flag within its event type."""
    out = iforest_outliers(busy_table(spark, folder, "events", "event_type", "event_id", "value"), "value", ["event_id"], series_cols=TYPE)
    return out.select("event_type", "event_id", "value", "score", "is_outlier")


def ts_iforest_share(spark, folder):
    out = iforest_outliers(busy_table(spark, folder, "events", "event_type", "event_id", "value"), "value", ["event_id"], series_cols=TYPE)
    return outlier_share(out, series_cols=TYPE)


def ts_iforest_planted(spark, folder):
    """Readings with far spikes put in per event type: all spikes are flagged, and no more rows than the share allows."""
    spikes = F.pmod("event_id", F.lit(500)) == 7
    events = busy_table(spark, folder, "events", "event_type", "event_id", "value")
    out = iforest_outliers(events.withColumn("value", F.when(spikes, F.lit(1e6) + F.col("event_id")).otherwise(F.col("value"))), "value", ["event_id"], series_cols=TYPE)
    return out.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(spikes).alias("spikes"), F.count_if(spikes & F.col("is_outlier")).alias("spikes_found"),
        # rows strictly above the interpolated quantile at rank 0.95 * (n - 1)
        (F.count_if("is_outlier") <= F.ceil(0.05 * (F.count(F.lit(1)) - 1))).alias("share_ok"),
    )


def _wide_hours(spark, folder):
    """Hourly mean per event type as one column each, every one with a unit column."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    hours = hourly(spark, folder).withColumnRenamed("event_type", "tag").withColumnRenamed("ts", "timestamp")
    wide = long_to_wide(hours, "timestamp", kinds)
    return wide.select("timestamp", *[x for k in kinds for x in (F.col(k), F.lit("unit of " + k).alias(k + "_unit"))])


def ts_wide_to_long(spark, folder):
    long = wide_to_long(_wide_hours(spark, folder), "timestamp").where(F.col("value").isNotNull())
    return long.select(stamp("timestamp").alias("hour"), "tag", rounded("value").alias("value"), "unit")


def ts_csv_load(spark, folder):
    """Wide hours written as CSV, loaded back and put in long form."""
    path = scratch_path(spark, "csv")
    _wide_hours(spark, folder).withColumn("timestamp", stamp("timestamp")).write.option("header", True).csv(path)
    kinds = ["click", "error", "purchase", "signup", "view"]
    schema = "timestamp string, " + ", ".join(f"{k} double, {k}_unit string" for k in kinds)
    long = wide_to_long(load_timeseries(spark, path, schema=schema), "timestamp").where(F.col("value").isNotNull())
    return long.select(stamp("timestamp").alias("hour"), "tag", rounded("value").alias("value"), "unit")


def _sensor_files(spark, folder, plants: dict[str, list[str]]):
    """One CSV folder per plant with other columns in each, read together into readings and a tag dimension."""
    path = scratch_path(spark, "sensors")
    e = table(spark, folder, "events").withColumn("plant", pick(F.col("user_id"), ["PLA", "PLB", "PLC"]))
    for plant, kinds in plants.items():
        long = e.where((F.col("plant") == plant) & F.col("event_type").isin(kinds)).select(
            F.date_trunc("hour", "ts").alias("timestamp"), "value",
            F.concat(F.lit(f"{plant}-SMT-EAF1-"), F.upper(F.col("event_type")), F.lit("-001")).alias("tag"),
        )
        tags = [f"{plant}-SMT-EAF1-{k.upper()}-001" for k in kinds]
        wide = long_to_wide(long, "timestamp", tags)
        wide.select(stamp("timestamp").alias("timestamp"), *[x for t in tags for x in (F.col(f"`{t}`"), F.lit("u").alias(t + "_unit"))]).write.option(
            "header", True).csv(f"{path}/{plant}")
    long = file_name(read_sensor_files(spark, f"{path}/*"))
    return tag_dimension(long).select("plant", "area", "equipment", "tag", "measure", "instance", "unit", "n", stamp("first").alias("first"), stamp("last").alias("last"))


def ts_sensor_files(spark, folder):
    """Some kinds of readings of each plant."""
    return _sensor_files(spark, folder, {"PLA": ["click", "error"], "PLB": ["view", "error", "signup"], "PLC": ["purchase"]})


def ts_sensor_files_all(spark, folder):
    """All readings of all plants; every plant has tags of its own."""
    return _sensor_files(spark, folder, {plant: ["click", "error", "purchase", "signup", "view"] for plant in ["PLA", "PLB", "PLC"]})


def ts_dataset_roundtrip(spark, folder):
    """Prepared events kept as a table by day, read back and summed up by day."""
    path = scratch_path(spark, "dataset")
    write_dataset(table(spark, folder, "events").withColumn("day", F.to_date("ts")), path, by=["day"])
    back = spark.read.parquet(path)
    return back.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value")).alias("total"))


def ts_summary_json(spark, folder):
    """The dataset summary written as JSON and read back, one row per statistic."""
    path = scratch_path(spark, "summary")
    write_json(summarize(table(spark, folder, "events").select("ts", "value", "user_id"), "ts"), path)
    back = spark.read.schema("shape array<bigint>, stats map<string,map<string,double>>").json(path)
    rows = back.select(F.col("shape")[0].alias("n_rows"), F.explode("stats").alias("column", "_s"))
    return rows.select("n_rows", "column", F.explode("_s").alias("statistic", "_v")).select("n_rows", "column", "statistic", rounded("_v").alias("value"))


def ts_outlier_chart(spark, folder):
    """Rows behind the outlier chart: time, value and flag per reading."""
    out = zscore_outliers(table(spark, folder, "events"), "value", 2.5, series_cols=TYPE)
    return out.select("event_type", "event_id", stamp("ts").alias("at"), rounded("value").alias("value"), "is_outlier")


QUERIES = {
    "ts_positions": _positions(WINDOW_ROWS),
    # in chunks, as for series too long for one task
    "ts_positions_chunked": _positions(0),
    "ts_describe": _described(PERCENTILE_ROWS),
    # by value bands, as for series too long to hold
    "ts_describe_bands": _described(0),
    "ts_decompose": _decomposed(WINDOW_ROWS),
    "ts_decompose_chunked": _decomposed(0),
    "ts_resample_hour": _resampled("h", "events", "ts", "value", TYPE),
    "ts_resample_15min": _resampled("15min", "events", "ts", "value", TYPE),
    "ts_resample_7h": _resampled("7h", "events", "ts", "value", TYPE),
    "ts_resample_day": _resampled("D", "events", "ts", "value", TYPE),
    "ts_resample_week": _resampled("W", "orders", "o_orderdate", "o_totalprice", ["o_orderpriority"]),
    "ts_resample_month_end": _resampled("M", "orders", "o_orderdate", "o_totalprice", ["o_orderpriority"]),
    "ts_resample_month_start": _resampled("MS", "orders", "o_orderdate", "o_totalprice", ["o_orderpriority"]),
    "ts_resample_quarter": _resampled("Q", "orders", "o_orderdate", "o_totalprice", ["o_orderpriority"]),
    "ts_resample_business_day": _resampled("B", "orders", "o_orderdate", "o_totalprice", ["o_orderpriority"]),
    "ts_resample_week_monday": _resampled("W-MON", "orders", "o_orderdate", "o_totalprice", ["o_orderpriority"]),
    "ts_resample_quarter_start": _resampled("QS", "orders", "o_orderdate", "o_totalprice", ["o_orderpriority"]),
    "ts_resample_year": _resampled("Y", "orders", "o_orderdate", "o_totalprice", ["o_orderpriority"]),
    **{f.__name__: f for f in [
        ts_overview, ts_describe_labels, ts_histogram, ts_slice, ts_by_time, ts_numeric_columns, ts_present, ts_correlation,
        ts_correlation_matrix, ts_strong_pairs, ts_correlation_wide, ts_moving_average, ts_moving_average_odd,
        ts_end_lines, ts_phase_means, ts_decompose_multiplicative, ts_season_strength, ts_season_strength_users,
        ts_infer_period, ts_zscore, ts_outlier_share, ts_iforest, ts_iforest_share, ts_iforest_planted, ts_wide_to_long, ts_csv_load, ts_sensor_files, ts_sensor_files_all,
        ts_dataset_roundtrip, ts_summary_json, ts_outlier_chart,
    ]},
}

HOURLY_SQL = "h AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY ALL)"


def _positions_sql(source: str, order: str, keys: str = "event_type") -> str:
    return (f"p AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS pos, "
            f"count(*) OVER (PARTITION BY {keys}) AS n FROM {source})")


def _average_sql(period: int, keys: str = "event_type") -> str:
    k = period // 2
    total = "sum(v) OVER w" if period % 2 else "(sum(v) OVER w - (first_value(v) OVER w + last_value(v) OVER w) / 2)"
    return (f"m AS (SELECT *, CASE WHEN count(*) OVER w = {2 * k + 1} THEN {total} / {period} END AS t0 FROM p "
            f"WINDOW w AS (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING))")


def _lines_sql(period: int, keys: str = "event_type") -> str:
    k = period // 2
    head = f"pos >= {k} AND pos < least({k + period}, n - 1 - {k})"
    tail = f"pos >= greatest({k}, n - 1 - {k} - {period}) AND pos < n - 1 - {k}"
    x = f"(pos - {k})"
    return (f"f AS (SELECT {keys}, regr_slope(t0, {x}) FILTER ({head}) AS hs, regr_intercept(t0, {x}) FILTER ({head}) AS hi, "
            f"regr_slope(t0, {x}) FILTER ({tail}) AS ts_, regr_intercept(t0, {x}) FILTER ({tail}) AS ti FROM m GROUP BY {keys})")


def _decompose_sql(period: int, additive: bool = True, keys: str = "event_type") -> list[str]:
    k = period // 2
    de, centre = ("v - trend", "a - avg(a) OVER (PARTITION BY {0})") if additive else ("v / trend", "a / avg(a) OVER (PARTITION BY {0})")
    resid = "v - trend - seasonal" if additive else "v / seasonal / trend"
    same = " AND ".join(f"m.{c} = f.{c}" for c in keys.split(", "))
    same_s = " AND ".join(f"t.{c} = s.{c}" for c in keys.split(", "))
    return [
        f"t AS (SELECT m.*, CASE WHEN pos < {k} THEN hi + hs * (pos - {k}) WHEN pos > n - 1 - {k} THEN ti + ts_ * (pos - {k}) ELSE t0 END AS trend "
        f"FROM m JOIN f ON {same} WHERE n >= {2 * period})",
        f"s AS (SELECT {keys}, phase, {centre.format(keys)} AS seasonal FROM (SELECT {keys}, pos % {period} AS phase, avg({de}) AS a FROM t GROUP BY ALL))",
        f"d AS (SELECT *, {resid} AS resid FROM (SELECT t.*, s.seasonal FROM t JOIN s ON {same_s} AND t.pos % {period} = s.phase))",
    ]


def _chain(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_PARTS = [HOURLY_SQL, _positions_sql("h", "ts"), _average_sql(PERIOD), _lines_sql(PERIOD)]
_ROWS = """SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS hour, round(3e-9 + v, 4) + 0.0 AS observed, round(3e-9 + trend, 4) + 0.0 AS trend,
round(3e-9 + seasonal, 4) + 0.0 AS seasonal, round(3e-9 + resid, 4) + 0.0 AS resid FROM d"""
_STRENGTH = """greatest(0, 1 - var_pop(resid) / nullif(var_pop({0} + resid), 0))"""
_WIDE_LONG = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type AS tag, round(3e-9 + avg(value), 4) + 0.0 AS value,
'unit of ' || event_type AS unit FROM events GROUP BY ALL"""
_PAIRS = """SELECT l_returnflag, '{a}' AS a, '{b}' AS b, count(*) AS n, round(3e-9 + corr({a}, {b}), 6) + 0.0 AS r FROM lineitem GROUP BY ALL"""
_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NET = {"l_extendedprice": "l_extendedprice", "net": "(l_extendedprice * (1 - l_discount))", "l_tax": "l_tax", "l_quantity": "l_quantity"}
_STATS = {
    "count": "CAST(count({c}) AS DOUBLE)", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})",
    "q25": "quantile_cont({c}, 0.25)", "q50": "quantile_cont({c}, 0.5)", "q75": "quantile_cont({c}, 0.75)", "max": "max({c})",
}

ORACLES = {
    "ts_resample_hour": _fixed_sql("3600", "TIMESTAMP '1970-01-01'"),
    "ts_resample_15min": _fixed_sql("900", "TIMESTAMP '1970-01-01'"),
    "ts_resample_7h": _fixed_sql("25200", "date_trunc('day', min(ts) OVER (PARTITION BY event_type))"),
    "ts_resample_day": _fixed_sql("86400", "TIMESTAMP '1970-01-01'"),
    "ts_resample_week": _calendar_sql(WEEK_NO, "DATE '1970-01-01' + CAST(g.u * 7 + 3 AS INTEGER)"),
    "ts_resample_business_day": _calendar_sql(
        f"CAST(floor(({DAY_NO} + 3) / 7.0) * 5 + least(({DAY_NO} + 3) % 7, 4) AS BIGINT)", "DATE '1970-01-01' + CAST(floor(g.u / 5.0) * 7 + g.u % 5 - 3 AS INTEGER)"),
    "ts_resample_week_monday": _calendar_sql(f"CAST(floor(({DAY_NO} + 9) / 7.0) AS BIGINT)", "DATE '1970-01-01' + CAST(g.u * 7 - 3 AS INTEGER)"),
    "ts_resample_quarter_start": _calendar_sql(f"CAST(floor(({MONTH_NO}) / 3.0) AS BIGINT)", _month_sql("g.u * 3")),
    "ts_resample_month_end": _calendar_sql(MONTH_NO, f"last_day({_month_sql('g.u')})"),
    "ts_resample_month_start": _calendar_sql(MONTH_NO, _month_sql("g.u")),
    "ts_resample_quarter": _calendar_sql(f"CAST(floor({MONTH_NO} / 3) AS BIGINT)", f"last_day({_month_sql('g.u * 3 + 2')})"),
    "ts_resample_year": _calendar_sql("year(o_orderdate)", "make_date(g.u, 12, 31)"),
    "ts_overview": """SELECT event_type, count(*) AS n_rows, CAST(4 AS BIGINT) AS n_columns, 'event_id,user_id,value,props' AS columns,
strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end",
count(*) - count(value) AS missing_value, count(*) - count(props) AS missing_props FROM events GROUP BY event_type""",
    "ts_describe": _describe_sql(_COLUMNS),
    "ts_describe_bands": _describe_sql(_COLUMNS),
    "ts_describe_labels": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique", arg_min(v, (-n, v)) AS top, max(n) AS freq
FROM (SELECT {c} AS v, count(*) AS n FROM events GROUP BY 1)""" for c in ["event_type", "props"]),
    "ts_histogram": """WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
c AS (SELECT e.event_type, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((value - lo) / ((hi - lo) / 20)) AS INTEGER), 19) END AS bin, count(*) AS n
FROM events e JOIN s ON e.event_type = s.event_type GROUP BY ALL),
g AS (SELECT event_type, lo, hi, CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM s)
SELECT g.event_type, g.bin, round(3e-9 + lo + g.bin * ((hi - lo) / 20), 4) + 0.0 AS low, round(3e-9 + lo + (g.bin + 1) * ((hi - lo) / 20), 4) + 0.0 AS high,
coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.event_type = c.event_type AND g.bin = c.bin""",
    "ts_slice": """SELECT event_type, count(*) AS n, round(3e-9 + sum(value), 4) + 0.0 AS total FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00' GROUP BY 1""",
    "ts_by_time": """SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at", event_id FROM events""",
    "ts_numeric_columns": " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n FROM lineitem" for c in [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_COLUMNS]),
    "ts_present": _chain(HOURLY_SQL) + "SELECT event_type, count(*) AS n, round(3e-9 + sum(v), 4) + 0.0 AS total FROM h GROUP BY 1",
    "ts_correlation": " UNION ALL ".join(_PAIRS.format(a=a, b=b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1:]),
    "ts_correlation_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(3e-9 + {'1.0' if a == b else f'corr({_NET[a]}, {_NET[b]})'}, 6) + 0.0 AS r FROM lineitem"
        + (" HAVING count(*) > 0" if a == b else "")
        for a in ["l_extendedprice", "net", "l_tax"] for b in ["l_extendedprice", "net", "l_tax"]),
    "ts_strong_pairs": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(3e-9 + corr({_NET[a]}, {_NET[b]}), 6) + 0.0 AS r FROM lineitem"
        for i, a in enumerate(["l_quantity", "l_extendedprice", "net", "l_tax"])
        for b in ["l_quantity", "l_extendedprice", "net", "l_tax"][i + 1:]) + ") WHERE abs(r) > 0.7",
    "ts_correlation_wide": """WITH names AS (SELECT 'n' || i || s AS tag, i * 2 + j AS no FROM range(0, 25) t(i), (VALUES ('F', 0), ('X', 1)) u(s, j)),
d AS (SELECT o_orderdate AS ts, 'n' || c_nationkey || CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'X' END AS tag, avg(o_totalprice) AS v
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
x AS (SELECT d.*, no FROM d JOIN names USING (tag)),
r AS (SELECT p.tag AS a, q.tag AS b, count(*) AS n, corr(p.v, q.v) AS r FROM x p JOIN x q ON p.ts = q.ts AND p.no < q.no GROUP BY ALL)
SELECT n1.tag AS a, n2.tag AS b, coalesce(n, 0) AS n, CASE WHEN isfinite(r) THEN round(3e-9 + r, 6) + 0.0 END AS r
FROM names n1 JOIN names n2 ON n1.no < n2.no LEFT JOIN r ON r.a = n1.tag AND r.b = n2.tag""",
    "ts_positions": _chain(_positions_sql("events", "ts, event_id")) + """SELECT event_type, CAST(floor(pos / 100) AS BIGINT) AS block, count(*) AS n,
round(3e-9 + sum(pos * value), 2) + 0.0 AS moment, max(n) AS series_rows FROM p GROUP BY 1, 2""",
    "ts_positions_chunked": _chain(_positions_sql("events", "ts, event_id")) + """SELECT event_type, CAST(floor(pos / 100) AS BIGINT) AS block, count(*) AS n,
round(3e-9 + sum(pos * value), 2) + 0.0 AS moment, max(n) AS series_rows FROM p GROUP BY 1, 2""",
    "ts_moving_average": _chain(*_PARTS[:3]) + "SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS hour, pos, round(3e-9 + t0, 4) + 0.0 AS average FROM m",
    "ts_moving_average_odd": _chain("h AS (SELECT event_type, ts, event_id, value AS v FROM events)", _positions_sql("h", "ts, event_id"), _average_sql(7))
    + "SELECT event_type, pos, round(3e-9 + t0, 4) + 0.0 AS average FROM m",
    "ts_end_lines": _chain(*_PARTS) + """SELECT event_type, round(3e-9 + hs, 6) + 0.0 AS head_slope, round(3e-9 + hi, 6) + 0.0 AS head_icept,
round(3e-9 + ts_, 6) + 0.0 AS tail_slope, round(3e-9 + ti, 6) + 0.0 AS tail_icept FROM f""",
    "ts_phase_means": _chain(*_PARTS[:2]) + """SELECT event_type, CAST(phase AS INTEGER) AS phase, round(3e-9 + a - avg(a) OVER (PARTITION BY event_type), 4) + 0.0 AS seasonal
FROM (SELECT event_type, pos % 24 AS phase, avg(v) AS a FROM p GROUP BY 1, 2)""",
    "ts_decompose": _chain(*_PARTS, *_decompose_sql(PERIOD)) + _ROWS,
    "ts_decompose_multiplicative": _chain(*_PARTS, *_decompose_sql(PERIOD, additive=False)) + _ROWS,
    "ts_season_strength": _chain(*_PARTS, *_decompose_sql(PERIOD)) + f""", e AS (SELECT event_type, {_STRENGTH.format('trend')} AS t, {_STRENGTH.format('seasonal')} AS s FROM d GROUP BY 1)
SELECT h.event_type, count(*) AS n, CASE WHEN count(*) < 48 THEN 'need at least 48 rows, found ' || count(*) ELSE 'ok' END AS status,
round(3e-9 + any_value(t), 6) + 0.0 AS trend_strength, round(3e-9 + any_value(s), 6) + 0.0 AS season_strength FROM h LEFT JOIN e ON h.event_type = e.event_type GROUP BY 1""".lstrip(),
    "ts_season_strength_users": _chain(
        "h AS (SELECT user_id, event_type, ts, event_id, value AS v FROM events)", _positions_sql("h", "ts, event_id", "user_id, event_type"),
        _average_sql(7, "user_id, event_type"), _lines_sql(7, "user_id, event_type"), *_decompose_sql(7, keys="user_id, event_type"))
    + f""", e AS (SELECT user_id, event_type, {_STRENGTH.format('trend')} AS t, {_STRENGTH.format('seasonal')} AS s FROM d GROUP BY 1, 2)
SELECT h.user_id, h.event_type, count(*) AS n, CASE WHEN count(*) < 14 THEN 'short' ELSE 'ok' END AS status,
round(3e-9 + any_value(t), 5) + 0.0 AS trend_strength, round(3e-9 + any_value(s), 5) + 0.0 AS season_strength
FROM h LEFT JOIN e ON h.user_id = e.user_id AND h.event_type = e.event_type GROUP BY 1, 2""".lstrip(),
    "ts_infer_period": f"""WITH e AS (SELECT min(ts) AS a, max(ts) AS b FROM events), o AS (SELECT min({WEEK_NO}) AS wa, max({WEEK_NO}) AS wb, min({MONTH_NO}) AS ma, max({MONTH_NO}) AS mb FROM orders)
SELECT 'events h' AS grid, date_diff('hour', a, b) + 1 AS n, 'hour' AS frequency, 24 AS period FROM e UNION ALL
SELECT 'events D', date_diff('day', a, b) + 1, 'day', 7 FROM e UNION ALL
SELECT 'events 15min', CAST(floor(epoch(b) / 900) - floor(epoch(a) / 900) AS BIGINT) + 1, NULL, NULL FROM e UNION ALL
SELECT 'orders W', wb - wa + 1, 'week', 52 FROM o UNION ALL
SELECT 'orders 2W', CAST(ceil((wb - wa) / 2) AS BIGINT) + 1, 'week', 26 FROM o UNION ALL
SELECT 'orders M', mb - ma + 1, 'month', 12 FROM o UNION ALL SELECT 'orders MS', mb - ma + 1, 'month', 12 FROM o""",
    "ts_decompose_chunked": _chain(*_PARTS, *_decompose_sql(PERIOD)) + _ROWS,
    "ts_iforest_planted": """SELECT event_type, count(v) AS n, count(v) FILTER (spike) AS spikes, count(v) FILTER (spike) AS spikes_found, true AS share_ok
FROM (SELECT event_type, event_id % 500 = 7 AS spike, CASE WHEN event_id % 500 = 7 THEN 1e6 + event_id ELSE value END AS v FROM events) WHERE v IS NOT NULL GROUP BY event_type""",
    "ts_zscore": """SELECT event_id, round(3e-9 + (value - m) / s, 4) + 0.0 AS z, abs((value - m) / s) > 3 AS is_outlier
FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) USING (event_type)""",
    "ts_outlier_share": """SELECT user_id, count(*) AS n, count(*) FILTER (abs((value - m) / s) > 2) AS n_outliers,
round(3e-9 + count(*) FILTER (abs((value - m) / s) > 2) * 100.0 / count(*), 4) + 0.0 AS pct_outliers
FROM events JOIN (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) USING (user_id) GROUP BY 1""",
    "ts_wide_to_long": _WIDE_LONG,
    "ts_csv_load": _WIDE_LONG,
    "ts_sensor_files": f"""WITH e AS (SELECT {pick_sql('user_id', ['PLA', 'PLB', 'PLC'])} AS plant, upper(event_type) AS measure, date_trunc('hour', ts) AS ts FROM events),
k AS (SELECT * FROM (VALUES ('PLA', 'CLICK'), ('PLA', 'ERROR'), ('PLB', 'VIEW'), ('PLB', 'ERROR'), ('PLB', 'SIGNUP'), ('PLC', 'PURCHASE')) t(plant, measure)),
w AS (SELECT e.plant, min(ts) AS first, max(ts) AS last FROM e JOIN k ON e.plant = k.plant AND e.measure = k.measure GROUP BY 1)
SELECT e.plant, 'SMT' AS area, e.plant || '-SMT-EAF1' AS equipment, e.plant || '-SMT-EAF1-' || e.measure || '-001' AS tag, e.measure, 1 AS instance, 'u' AS unit,
count(DISTINCT ts) AS n, strftime(any_value(first), '%Y-%m-%d %H:%M:%S') AS first, strftime(any_value(last), '%Y-%m-%d %H:%M:%S') AS last
FROM e JOIN k ON e.plant = k.plant AND e.measure = k.measure JOIN w ON e.plant = w.plant GROUP BY e.plant, e.measure""",
    "ts_sensor_files_all": f"""WITH e AS (SELECT {pick_sql('user_id', ['PLA', 'PLB', 'PLC'])} AS plant, upper(event_type) AS measure, date_trunc('hour', ts) AS ts FROM events),
w AS (SELECT plant, min(ts) AS first, max(ts) AS last FROM e GROUP BY 1)
SELECT e.plant, 'SMT' AS area, e.plant || '-SMT-EAF1' AS equipment, e.plant || '-SMT-EAF1-' || e.measure || '-001' AS tag, e.measure, 1 AS instance, 'u' AS unit,
count(DISTINCT ts) AS n, strftime(any_value(first), '%Y-%m-%d %H:%M:%S') AS first, strftime(any_value(last), '%Y-%m-%d %H:%M:%S') AS last
FROM e JOIN w ON e.plant = w.plant GROUP BY e.plant, e.measure""",
    "ts_dataset_roundtrip": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(3e-9 + sum(value), 4) + 0.0 AS total FROM events GROUP BY 1",
    "ts_summary_json": " UNION ALL ".join(
        f"""SELECT count(*) AS n_rows, '{c}' AS "column", '{s}' AS statistic, round(3e-9 + {e.format(c=c)}, 4) + 0.0 AS value FROM events"""
        for c in ["value", "user_id"] for s, e in _STATS.items()),
    "ts_outlier_chart": """SELECT event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at", round(3e-9 + value, 4) + 0.0 AS value, abs((value - m) / s) > 2.5 AS is_outlier
FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) USING (event_type)""",
}
