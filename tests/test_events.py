import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plantlake.functions.ids import entity_kind, id_plant, ids_in_text, link_kind, of_plant, short_id, tag_parts
from plantlake.joins import fits_broadcast, hot_keys, join_hot, join_sized, left_join_key
from plantlake.operators import causes, graph, links, quality, report
from plantlake.sources.plant import ALARMS, BATCHES, DOWNTIME, INVENTORY, LAB, PLANTS, WORK_ORDERS, areas, read_alarms, read_inventory, write_inventory
from plantlake.sources.timeseries import (
    load_timeseries, load_timeseries_lenient, read_sensor_files, readings, tag_dimension, wide_to_long, write_dataset,
)

T0 = dt.datetime(2024, 2, 1, 8, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def alarm(i, minutes=0, tag="PLA-SMT-EAF1", priority="High", resolved=False):
    return (f"ALM-PLA-{i:08X}", at(minutes), tag, "Temp", priority, "m", False, resolved, None, None)


def down(i, minutes=0, tag="PLA-SMT-EAF1", hours=5.0, reason="Equipment Failure", alarm_id=None, mwo=None):
    return (f"DWT-PLA-{i:08X}", tag, at(minutes), at(minutes + 60), hours, reason, alarm_id, mwo)


def order(i, day=T0.date(), tag="PLA-SMT-EAF1", kind="Corrective", cost=100.0, alarm_id=None, downtime_id=None):
    return (f"MWO-PLA-{i:08X}", day, tag, kind, "d", "t", 1.0, "None", cost, "Completed", alarm_id, downtime_id)


def test_ids(spark):
    df = spark.createDataFrame([("PLA-SMT-EAF12-TE-001",), ("MWO-PLA-0000ABCD",), ("odd",)], "t string")
    p = df.select(tag_parts(F.col("t")).alias("p")).collect()
    assert tuple(p[0].p) == ("PLA", "SMT", "PLA-SMT-EAF12", "EAF", 12, "TE", 1)
    assert p[2].p.plant == "odd" and p[2].p.instance is None
    row = df.where("t like 'MWO%'").select(entity_kind(F.col("t")), id_plant(F.col("t")), short_id(F.col("t")), of_plant(F.col("t"), F.lit("PLA")), of_plant(F.col("t"), F.lit("PL"))).first()
    assert tuple(row) == ("work order", "PLA", "0000ABCD", True, False)
    text = spark.createDataFrame([("Ref MWO-PLA-0000ABCD). then RCA-PLB-12345678, mwo-PLA-1",)], "x string")
    assert text.select(ids_in_text(F.col("x"))).first()[0] == ["MWO-PLA-0000ABCD", "RCA-PLB-12345678"]
    assert spark.range(1).select(link_kind(F.lit("ProductionBatchID"))).first()[0] == "batch"


def test_filters(spark):
    a = spark.createDataFrame([alarm(1, priority="Low"), alarm(2, priority="Medium"), alarm(3), alarm(4, priority="Critical", resolved=True)], ALARMS)
    assert [r.AlarmID[-1] for r in links.needs_downtime(a).collect()] == ["3"]
    assert [r.AlarmID[-1] for r in links.triggers_maintenance(a).collect()] == ["2", "3"]
    d = spark.createDataFrame([down(1), down(2, reason="Planned Maintenance"), down(3, reason="Safety Stop")], DOWNTIME)
    assert links.maintenance_downtime(d).count() == 2


def test_attribution_edges(spark):
    a = spark.createDataFrame([alarm(1, 0), alarm(2, 20), alarm(3, 20, tag="PLA-REF-REF1"), alarm(4, 20)], ALARMS)
    d = spark.createDataFrame([down(1, 4), down(2, 5), down(3, 24), down(4, 25), down(5, 80), down(6, 81), down(7, 25, tag="PLA-CST-X1")], DOWNTIME)
    got = {r.DowntimeID[-1]: (r.AlarmID[-1], r.lag_minutes) for r in links.attribute_downtime(a, d).collect()}
    assert got == {"2": ("1", 5.0), "3": ("1", 24.0), "4": ("4", 5.0), "5": ("4", 60.0)}
    day = T0.date()
    m = spark.createDataFrame([order(i, day + dt.timedelta(days=n)) for i, n in enumerate([-1, 0, 2, 3])], WORK_ORDERS)
    got = {r.MWO_ID[-1]: (r.AlarmID[-1], r.lag_days) for r in links.attribute_work_orders(a, m).collect()}
    assert got == {"1": ("4", 0), "2": ("4", 2)}
    assert [(r.MWO_ID[-1], r.DowntimeID[-1]) for r in links.same_day_downtime(d, m).collect()] == [("1", "1")]


def test_recorded_links_and_resolution(spark):
    a = spark.createDataFrame([alarm(1), alarm(2), alarm(3, resolved=True)], ALARMS)
    d = spark.createDataFrame([down(1, alarm_id="ALM-PLA-00000001"), down(2, alarm_id="ALM-PLA-000000FF"), down(3)], DOWNTIME)
    m = spark.createDataFrame([order(1, alarm_id="ALM-PLA-00000002"), order(2, alarm_id="ALM-PLA-00000002"), order(3, downtime_id="DWT-PLA-00000001"), order(4)], WORK_ORDERS)
    got = {r.DowntimeID[-1]: r.alarm_AlarmID for r in links.downtime_with_alarm(d, a).collect()}
    assert got == {"1": "ALM-PLA-00000001", "2": None, "3": None}
    assert [r.DowntimeID[-1] for r in links.dangling(d, "TriggeringAlarmID", a, "AlarmID").collect()] == ["2"]
    got = {r.MWO_ID[-1]: (r.alarm_AlarmID, r.downtime_DowntimeID) for r in links.work_order_with_causes(m, a, d).collect()}
    assert got == {"1": ("ALM-PLA-00000002", None), "2": ("ALM-PLA-00000002", None), "3": (None, "DWT-PLA-00000001"), "4": (None, None)}
    assert [r.MWO_ID[-1] for r in links.unlinked(m, "TriggeringAlarmID", "RelatedDowntimeID").collect()] == ["4"]
    got = {r.AlarmID[-1]: (r.Resolved, r.TriggeredMaintenanceID) for r in links.propagate_resolution(a, m).collect()}
    assert got == {"1": (False, None), "2": (True, "MWO-PLA-00000001"), "3": (True, None)}


def test_event_chain(spark):
    a = spark.createDataFrame([alarm(1, 0), alarm(2, 0, tag="PLA-X-Y1")], ALARMS)
    d = spark.createDataFrame([down(1, 30), down(2, 30, tag="PLA-X-Y1", alarm_id="ALM-PLA-00000002"), down(3, 500)], DOWNTIME)
    m = spark.createDataFrame([order(1, downtime_id="DWT-PLA-00000002"), order(2)], WORK_ORDERS)
    rca = spark.createDataFrame([("RCA-PLA-00000009", "DWT-PLA-00000001", T0.date() + dt.timedelta(days=4))], "rca_id string, trigger_id string, rca_date date")
    got = {r.DowntimeID[-1]: r for r in links.event_chain(a, d, m, rca).collect()}
    assert (got["1"].alarm_link, got["1"].alarm_lag_minutes, got["1"].work_order_link, got["1"].rca_lag_days) == ("interval", 30.0, "interval", 4)
    assert (got["2"].alarm_link, got["2"].MWO_ID[-1], got["2"].work_order_link, got["2"].n_work_orders) == ("recorded", "1", "recorded", 1)
    assert (got["3"].AlarmID, got["3"].MWO_ID, got["3"].n_work_orders) == (None, None, 0)


def batch(i, day, alloy="FeMn-HC", tons=10.0, energy=1000.0, targets=(70.0, 1.0, 6.0)):
    return (f"BCH-PLA-{i:08X}", day, alloy, "PLA-SMT-EAF1", 1.0, 1.0, 0.0, 1.0, 1.0, energy, tons, *targets, "op")


def test_production_report(spark):
    first = dt.date(2024, 1, 1)
    b = spark.createDataFrame([batch(1, first), batch(2, first, tons=40.0, energy=2000.0), batch(3, first, tons=0.0), batch(4, first, alloy="SiMn-Std", tons=0.0),
                               batch(5, dt.date(2023, 12, 31))], BATCHES).withColumn("plant", F.lit("PLA"))
    d = spark.createDataFrame([down(i, hours=float(h)) for i, h in enumerate([4, 5, 6, 6, 7, 8, 9])], DOWNTIME).withColumn("plant", F.lit("PLA"))
    m = spark.createDataFrame([order(1, cost=1000.0), order(2, cost=1001.0), order(3, cost=5.0, kind="Breakdown"), order(4, first, cost=2000.0, alarm_id="ALM-PLA-0000000A")],
                              WORK_ORDERS).withColumn("plant", F.lit("PLA"))
    out = report.production_report(b, d, m, as_of=F.lit("2024-02-15").cast("date"), price=0.1)
    k = out["kpis"].first()
    # mean of ratios over batches with tons: (100 + 50) / 2; ratio of sums per alloy
    assert (k.n_batches, k.kwh_per_ton, k.downtime_hours, k.maintenance_cost, k.energy_cost) == (4, 75.0, 45.0, 4006.0, 375.0)
    alloys = {r.AlloyType: (r.n_batches, r.tons, r.kwh_per_ton) for r in out["alloys"].collect()}
    assert alloys == {"FeMn-HC": (3, 50.0, 80.0), "SiMn-Std": (1, 0.0, 0.0)}
    assert [(r["rank"], r.downtime[-1]) for r in out["downtime"].orderBy("rank").collect()] == [(1, "6"), (2, "5"), (3, "4"), (4, "2"), (5, "3")]
    assert [(r.work_order[-1], r.alarm) for r in out["work_orders"].orderBy("rank").collect()] == [("4", "0000000A"), ("2", None), ("3", None)]
    tags = report.distinct_links(m, {"AlarmID": "TriggeringAlarmID"}).collect()
    assert sorted(tuple(r) for r in tags) == [("AlarmID", "ALM-PLA-0000000A"), ("EquipmentTag", "PLA-SMT-EAF1")]


def test_causes(spark):
    i = spark.createDataFrame([("INC-PLA-00000001", T0, "SMT", "PLA-SMT-EAF1", "Near Miss", "Minor", ["Area inspected."]),
                               ("INC-PLA-00000002", T0, "SMT", None, "Property Damage", "Major", ["(Ref MWO-PLA-00000001).", "RCA initiated (Ref RCA-PLA-00000001)."])],
                              "incident_id string, ts timestamp, area string, equipment string, type string, severity string, actions array<string>")
    d = spark.createDataFrame([down(1, hours=24.0), down(2, hours=24.5)], DOWNTIME)
    m = spark.createDataFrame([order(1, cost=5000.0), order(2, cost=5001.0), order(3, kind="Breakdown")], WORK_ORDERS)
    got = sorted(r.trigger_id for r in causes.candidates(i, d, m).collect())
    assert got == ["DWT-PLA-00000002", "INC-PLA-00000002", "MWO-PLA-00000002", "MWO-PLA-00000003"]
    inv = spark.createDataFrame([("PLA/Safety_Data/INC-PLA-00000002_SafetyIncidentReport.docx", "PLA", "Safety_Data", "DOCX", "desc", "2024-02-03", ["PLA-SMT-EAF1"], {})], INVENTORY)
    reports = spark.createDataFrame([("r1", "INC-PLA-00000002"), ("r2", "DWT-PLA-00000001"), ("r3", "MWO-PLA-00000002"), ("r4", "MWO-PLA-000000FF")], "rca_id string, trigger_id string")
    rows = {r.rca_id: r for r in causes.look_up_triggers(reports, d, m, inv).collect()}
    assert rows["r1"].description == "desc" and rows["r1"].event_date == dt.date(2024, 2, 3) and rows["r1"].tag == "PLA-SMT-EAF1"
    assert rows["r2"].description == "Downtime Event: Equipment Failure on PLA-SMT-EAF1 (24.0h)"
    assert rows["r3"].description == "Maintenance Event: Corrective on PLA-SMT-EAF1 (Cost: $5001)"
    assert rows["r4"].description == "Analysis of Event MWO-PLA-000000FF" and rows["r4"].kind is None
    roll = {r.severity: (r.n, r.n_work_order, r.n_root_cause) for r in quality.incident_rollup(i).collect()}
    assert roll == {"Minor": (1, 0, 0), "Major": (1, 1, 1)}


def test_graph(spark):
    inv = spark.createDataFrame([("f1", "PLA", "c", "CSV", "d", None, [], {"AlarmID": ["A", "B"], "MWO_ID": ["M"]}), ("f2", "PLA", "c", "CSV", "d", None, [], {"ActiveAlarmID": ["B"]})], INVENTORY)
    edges = graph.file_edges(inv)
    assert sorted(tuple(r) for r in edges.collect()) == [("f1", "A", "alarm"), ("f1", "B", "alarm"), ("f1", "M", "work order"), ("f2", "B", "alarm")]
    assert {r.node: r.degree for r in graph.degrees(edges).collect()} == {"f1": 3, "f2": 1, "A": 1, "B": 2, "M": 1}
    seeds = spark.createDataFrame([("A",)], "node string")
    assert {r.node: r.distance for r in graph.neighbourhood(edges, seeds, 3).collect()} == {"A": 0, "f1": 1, "B": 2, "M": 2, "f2": 3}
    assert {r.node: r.distance for r in graph.neighbourhood(edges, seeds, 4).collect()} == {"A": 0, "f1": 1, "B": 2, "M": 2, "f2": 3}
    with pytest.raises(ValueError):
        graph.neighbourhood(edges, seeds, -1)
    m = spark.createDataFrame([order(1, alarm_id="ALM-1", downtime_id=None)], WORK_ORDERS)
    assert [tuple(r) for r in graph.entity_edges(m, "MWO_ID", {"TriggeringAlarmID": "AlarmID", "RelatedDowntimeID": "DowntimeID"}).collect()] == [("MWO-PLA-00000001", "ALM-1", "alarm")]


def test_quality(spark):
    day = dt.date(2024, 1, 1)
    b = spark.createDataFrame([batch(1, day), batch(2, day)], BATCHES)
    lab = spark.createDataFrame([("L1", day, "BCH-PLA-00000001", 71.0, 1.5, 6.0, 0.1, 0.01, None, "a"), ("L2", day, "gone", 60.0, 1.0, 5.0, 0.2, 0.02, None, "a")], LAB)
    joined = quality.target_deviation(quality.lab_with_batch(lab, b))
    rows = {r.LabAnalysisID: r for r in joined.collect()}
    assert (rows["L1"].Mn_deviation, rows["L1"].AlloyType, rows["L2"].AlloyType, rows["L2"].Mn_deviation) == (1.0, "FeMn-HC", "unknown", None)
    per = {(r.AlloyType, r.element): (r.n, r.mean_deviation) for r in quality.quality_by_alloy(joined).collect()}
    assert per["FeMn-HC", "Si"] == (1, 0.5) and per["unknown", "Si"] == (0, None)
    fe = lab.select(quality.iron_closure(*[F.col(f"{e}_pct") for e in ["Mn", "Si", "C", "P", "S"]])).collect()
    assert [r[0] for r in fe] == [21.39, 33.78]
    assert spark.range(1).select(quality.iron_closure(F.lit(101.0)), quality.raw_material_total(F.lit(1.0), F.lit(None).cast("double"))).first()[:] == (0.0, 1.0)
    e = spark.createDataFrame([("PLA", T0, "SOx", 60.0), ("PLA", T0, "Dust (Stack)", 5.1), ("PLA", T0, "CO2 eq.", 9.0), ("PLA", T0, "Dust (Fugitive)", 9.0), ("PLA", T0, "Other", 1.0)],
                              "plant string, ts timestamp, parameter string, value double")
    got = {r.parameter: (r.month, r.status) for r in quality.monthly_compliance(e, "ts").collect()}
    assert got == {"SOx": ("2024_02", "Compliant"), "Dust (Stack)": ("2024_02", "Action Required"), "CO2 eq.": ("2024_02", "N/A"),
                   "Dust (Fugitive)": ("2024_02", "Monitored"), "Other": ("2024_02", "N/A")}


def test_json_sources(spark, tmp_path):
    record = dict(AlarmID="ALM-PLA-00000001", Timestamp="2024-02-01 08:00:00", EquipmentTag="t", AlarmType="x", Priority="Low", Message="m",
                  Acknowledged=True, Resolved=False, TriggeredDowntimeID=None, TriggeredMaintenanceID="MWO-PLA-00000001")
    (tmp_path / "a.json").write_text(json.dumps([record, record], indent=2))
    rows = read_alarms(spark, str(tmp_path / "a.json")).collect()
    assert len(rows) == 2 and rows[0].Timestamp == T0 and rows[0].TriggeredMaintenanceID == "MWO-PLA-00000001"
    (tmp_path / "bad.json").write_text('[{"AlarmID": ')
    with pytest.raises(Exception):
        read_alarms(spark, str(tmp_path / "bad.json")).collect()
    inv = [dict(file_path=f, plant_code="PLA", category="c", file_format="CSV", description="d", date_range=None, equipment_tags=["t"], linked_ids={"MWO_ID": ["M"]}) for f in ["b", "a"]]
    (tmp_path / "inv.json").write_text(json.dumps(inv, indent=4))
    back = read_inventory(spark, str(tmp_path / "inv.json"))
    assert back.first().linked_ids == {"MWO_ID": ["M"]}
    write_inventory(back, str(tmp_path / "out"))
    assert [r.file_path for r in read_inventory(spark, str(tmp_path / "out")).collect()] == ["a", "b"]
    plants = spark.createDataFrame([("PLA", "n", "l", {"SMT": "Smelting", "REF": "Refining"}, (2, True, True, True, True, ["Ladles"]))], PLANTS)
    assert sorted(tuple(r) for r in areas(plants).collect()) == [("PLA", "REF", "Refining"), ("PLA", "SMT", "Smelting")]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("timestamp,a,a_unit,flag\n2024-01-02 00:00:00,2.5,°C,True\n2024-01-01 00:00:00,,°C,False\nbroken,1,°C,True\n")
    path = str(tmp_path / "s.csv")
    with pytest.raises(ValueError, match="available columns"):
        load_timeseries(spark, path, "time")
    with pytest.raises(Exception):
        load_timeseries(spark, path).collect()
    good, bad = load_timeseries_lenient(spark, path)
    assert good.count() == 2 and [r.timestamp for r in bad.collect()] == ["broken"]
    long = sorted((r.tag, r.value, r.unit) for r in wide_to_long(good, "timestamp").where("value is not null").collect())
    assert long == [("a", 2.5, "°C")]
    assert wide_to_long(good.select("timestamp"), "timestamp").count() == 0
    write_dataset(good, str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2


def test_sensor_files_of_different_shape(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,P-S-EAF1-TE-001,P-S-EAF1-TE-001_unit,P-S-EAF1-P-001,P-S-EAF1-P-001_unit\n2024-01-01 00:00:00,1500.5,°C,100,kPa\n2024-01-01 00:15:00,,°C,101,kPa\n")
    (tmp_path / "b.csv").write_text("P-R-REF1-F-001,timestamp,P-R-REF1-F-001_unit\n500,2024-01-01 00:00:00,\"Nm3/h, dry\"\n")
    (tmp_path / "c.csv").write_text("timestamp\n2024-01-01 00:00:00\n")
    long = read_sensor_files(spark, str(tmp_path / "*.csv"))
    # a line is parsed for its cells, and before that if it might be a header; not once per column
    assert long._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 2
    rows = sorted((r.tag, r.value, r.unit) for r in long.collect() if r.value is not None)
    assert rows == [("P-R-REF1-F-001", 500.0, "Nm3/h, dry"), ("P-S-EAF1-P-001", 100.0, "kPa"), ("P-S-EAF1-P-001", 101.0, "kPa"), ("P-S-EAF1-TE-001", 1500.5, "°C")]
    dim = {r.tag: (r.equipment, r.measure, r.n) for r in tag_dimension(long).collect()}
    assert dim["P-S-EAF1-TE-001"] == ("P-S-EAF1", "TE", 1)
    assert readings(long).columns[:6] == ["plant", "area", "equipment", "tag", "measure", "instance"]
    with pytest.raises(ValueError):
        read_sensor_files(spark, str(tmp_path / "*.csv"), "time")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_key_join_equals_plain_join(spark, how):
    """A third of the rows share one key, many of them as exact copies."""
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"), (F.col("id") % 11).alias("v"))
    small = spark.range(0, 400, 2).select(F.col("id").alias("k"), *([(F.col("id") * 2).alias("w")] if how in ("left", "inner") else []))
    want = sorted(map(str, big.join(small, "k", how).collect()))
    assert sorted(map(str, join_hot(big, small, ["k"], how, rows=100).collect())) == want
    if how in ("left", "inner"):
        assert sorted(map(str, join_sized(big, small, ["k"], how, max_bytes=0).collect())) == want
        assert sorted(map(str, join_sized(big, small, ["k"], how).collect())) == want


def test_hot_keys_are_few(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert hot_keys(df, ["k"]) is None
    assert [tuple(r) for r in hot_keys(df, ["k"], rows=100).collect()] == [(7, 11)]


def test_size_check_and_null_keys(spark):
    df = spark.createDataFrame([(1, "x" * 100, [1.0, 2.0])] * 50, "a int, b string, c array<double>")
    assert fits_broadcast(df, 8000) and not fits_broadcast(df, 5000)
    left = spark.createDataFrame([(i, None if i % 2 else f"k{i}") for i in range(10)], "id int, fk string")
    right = spark.createDataFrame([(f"k{i}", i) for i in range(0, 10, 4)], "k string, w int")
    got = {r.id: r.w for r in left_join_key(left, right, "fk", "k", "id").collect()}
    assert got == {i: (i if i % 4 == 0 else None) for i in range(10)}


def test_hot_rows_spread_whatever_they_hold(spark):
    """Fifty equal rows with a map column: all salts are used, no row is lost or repeated."""
    big = spark.range(50).select(F.lit(1).alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m")).unionByName(
        spark.range(3).select((F.col("id") + 5).cast("int").alias("k"), F.create_map(F.lit("a"), F.lit(2)).alias("m")))
    small = spark.createDataFrame([(1, "x"), (5, "y")], "k int, v string")
    hot = hot_keys(big, ["k"], rows=10)
    assert [tuple(r) for r in hot.collect()] == [(1, 5)]
    for how, n in [("left", 53), ("inner", 51), ("left_semi", 51), ("left_anti", 2)]:
        assert join_hot(big, small, ["k"], how, rows=10).count() == n
    empty = big.where("k < 0")
    assert join_hot(empty, small, ["k"], "left", rows=10).count() == 0
