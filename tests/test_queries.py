"""Every registered query against its SQL twin, and the shape of the plans."""

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry_point
from plantlake.plans import ALL_ORACLES, ALL_QUERIES
from verify import TABLES, rows_of

QUERIES, ORACLES = ALL_QUERIES, ALL_ORACLES
NO_SQL = {"ts_iforest", "ts_iforest_share", "doc_top_k_hashed", "doc_top_k_cells", "doc_answers_text"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def test_registry():
    assert set(QUERIES) - set(ORACLES) == NO_SQL and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    got, want = rows_of(QUERIES[name](spark, SMALL).toPandas()), rows_of(con.execute(ORACLES[name]).fetchdf())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 5 and {r.status for r in rows} == {"ok"}


def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "ts_resample_hour", "ts_resample_week", "ts_describe_labels", "ts_correlation", "ts_moving_average", "ts_zscore", "ev_attribute_downtime",
    "ev_event_chain", "ev_report_kpis", "ev_quality", "ev_degrees", "doc_clean_markup", "doc_windows", "doc_unit_phrases", "doc_merge_pieces"])
def test_native_plans(spark, name):
    """No Python worker, no pairing of everything with everything."""
    text = plan(spark, name)
    for word in ["Python", "InPandas", "CartesianProduct", "NestedLoop"]:
        assert word not in text


def test_pushdown_and_pruning(spark):
    text = plan(spark, "ts_slice")
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
    assert "props" not in plan(spark, "ts_correlation")


def test_top_lists_are_cut_before_the_shuffle(spark):
    text = plan(spark, "ev_report_downtime")
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_keyed_windows_have_keys(spark):
    for name in ["ts_positions_chunked", "ts_decompose_chunked", "ev_attribute_downtime_chunked", "doc_merge_pieces_chunked"]:
        assert "SinglePartition" not in plan(spark, name)
