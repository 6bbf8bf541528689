"""Plant-event queries over views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantlake.functions.calendar import date_range_end, date_range_start
from plantlake.functions.ids import entity_kind, ids_in_text, of_plant, prefix, short_id, tag_parts
from plantlake.operators import causes, graph, links, quality, report
from plantlake.ordered import WINDOW_ROWS
from plantlake.plans.views import (
    BATCHES_SQL, EVENT_VIEWS_SQL, LAB_SQL, PLANT_EVENTS_SQL, alarms, batches, downtime, incidents,
    inventory, lab, plant_events, rounded, stamp, with_sql, work_orders,
)
from plantlake.session import scratch_path
from plantlake.sources.plant import read_alarms, read_inventory, write_inventory

AS_OF_EVENTS = "2024-02-10"
AS_OF_ORDERS = "2001-07-20"
# event numbers per written file
RECORDS_PER_FILE = 100_000


def ev_needs_downtime(spark, folder):
    return links.needs_downtime(alarms(spark, folder)).select("AlarmID", "Priority")


def ev_triggers_maintenance(spark, folder):
    one = links.triggers_maintenance(alarms(spark, folder)).select(F.col("AlarmID").alias("id"), F.lit("alarm").alias("kind"))
    two = links.maintenance_downtime(downtime(spark, folder)).select(F.col("DowntimeID").alias("id"), F.lit("downtime").alias("kind"))
    return one.unionByName(two)


def ev_of_plant(spark, folder):
    return alarms(spark, folder).where(of_plant(F.col("AlarmID"), F.lit("PLB"))).select("AlarmID", "EquipmentTag")


def ev_downtime_with_alarm(spark, folder):
    out = links.downtime_with_alarm(downtime(spark, folder), alarms(spark, folder))
    return out.select("DowntimeID", "TriggeringAlarmID", stamp("alarm_Timestamp").alias("alarm_time"), F.col("alarm_Priority").alias("priority"))


def ev_work_order_causes(spark, folder):
    out = links.work_order_with_causes(work_orders(spark, folder), alarms(spark, folder), downtime(spark, folder))
    return out.select("MWO_ID", F.col("alarm_AlarmID").alias("alarm"), F.col("downtime_DowntimeID").alias("downtime"), rounded("downtime_DurationHours").alias("hours"))


def ev_resolution(spark, folder):
    out = links.propagate_resolution(alarms(spark, folder), work_orders(spark, folder))
    return out.select("AlarmID", "Resolved", "TriggeredMaintenanceID")


def ev_unlinked(spark, folder):
    one = links.unlinked(downtime(spark, folder), "TriggeringAlarmID").select(F.col("DowntimeID").alias("id"), F.lit("downtime").alias("kind"))
    two = links.unlinked(work_orders(spark, folder), "TriggeringAlarmID", "RelatedDowntimeID").select(F.col("MWO_ID").alias("id"), F.lit("work order").alias("kind"))
    return one.unionByName(two)


def ev_dangling(spark, folder):
    out = links.dangling(downtime(spark, folder), "TriggeringAlarmID", alarms(spark, folder), "AlarmID")
    return out.select("DowntimeID", "TriggeringAlarmID")


def _attributed(window_rows: int):
    def run(spark, folder):
        out = links.attribute_downtime(alarms(spark, folder), downtime(spark, folder), window_rows=window_rows)
        return out.select("EquipmentTag", "DowntimeID", "AlarmID", rounded("lag_minutes").alias("lag_minutes"))

    return run


def ev_attribute_work_orders(spark, folder):
    return links.attribute_work_orders(alarms(spark, folder), work_orders(spark, folder))


def ev_same_day_downtime(spark, folder):
    return links.same_day_downtime(downtime(spark, folder), work_orders(spark, folder))


def _reports(spark, folder) -> DataFrame:
    """One root-cause report per incident and per long downtime."""
    i = incidents(spark, folder).select(F.regexp_replace("incident_id", "^INC", "RCA").alias("rca_id"), F.col("incident_id").alias("trigger_id"), F.date_add(F.to_date("ts"), 3).alias("rca_date"))
    d = downtime(spark, folder).select(F.regexp_replace("DowntimeID", "^DWT", "RCA").alias("rca_id"), F.col("DowntimeID").alias("trigger_id"), F.date_add(F.to_date("StartTime"), 5).alias("rca_date"))
    return i.unionByName(d)


def ev_event_chain(spark, folder):
    out = links.event_chain(alarms(spark, folder), downtime(spark, folder), work_orders(spark, folder), _reports(spark, folder))
    return out.select(
        "DowntimeID", "AlarmID", "alarm_link", rounded("alarm_lag_minutes").alias("alarm_lag_minutes"), "MWO_ID", "work_order_link",
        "work_order_lag_days", "n_work_orders", "rca_id", "rca_lag_days",
    )


def ev_trigger_lookup(spark, folder):
    out = causes.look_up_triggers(_reports(spark, folder), downtime(spark, folder), work_orders(spark, folder), inventory(spark, folder))
    return out.select("rca_id", "trigger_id", "prefix", "tag", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "alarm_id", "linked_id")


def ev_trigger_lookup_all(spark, folder):
    """Reports of all three kinds of events, and one per batch order that no event table knows."""
    m = work_orders(spark, folder).select(F.regexp_replace("MWO_ID", "^MWO", "RCA").alias("rca_id"), F.col("MWO_ID").alias("trigger_id"))
    unknown = m.select("rca_id", F.regexp_replace("trigger_id", "^MWO", "ORD").alias("trigger_id"))
    reports = _reports(spark, folder).select("rca_id", "trigger_id").unionByName(m).unionByName(unknown)
    out = causes.look_up_triggers(reports, downtime(spark, folder), work_orders(spark, folder), inventory(spark, folder))
    generic = F.when(F.col("kind").isNull(), F.col("description")).alias("description")
    return out.select("rca_id", "trigger_id", "prefix", "kind", "tag", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "alarm_id", "linked_id", generic)


def ev_cause_candidates(spark, folder):
    out = causes.candidates(incidents(spark, folder), downtime(spark, folder), work_orders(spark, folder))
    return out.select("trigger_id", "kind", "tag", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), rounded("magnitude").alias("magnitude"),
                      "alarm_id", "linked_id", F.when(F.col("kind") == "incident", F.col("description")).alias("description"))


def _report(spark, folder):
    as_of = F.lit(AS_OF_ORDERS).cast("date")
    return report.in_period(batches(spark, folder), "Date", as_of)


def ev_report_kpis(spark, folder):
    events = F.lit(AS_OF_EVENTS).cast("date")
    d = report.in_period(downtime(spark, folder), "StartTime", events)
    m = report.in_period(work_orders(spark, folder), "Date", events)
    # the event plants have no orders: plant is the region of the batches here, the code of the events there
    out = report.period_kpis(_report(spark, folder), d, m, ["plant"], price=0.1)
    return out.select("plant", "n_batches", *[rounded(c).alias(c) for c in ["kwh_per_ton", "tons", "downtime_hours", "maintenance_cost", "energy_cost"]])


def ev_report_months(spark, folder):
    """Report of every plant and month of the year; batches, downtime and work orders share both keys."""
    made = batches(spark, folder).withColumn("plant", F.element_at(F.array(*[F.lit(f"PL{c}") for c in "ABC"]), (F.col("BatchID") % 3 + 1).cast("int")))
    out = report.production_report(made, downtime(spark, folder), work_orders(spark, folder), month="MM")["kpis"]
    return out.select("plant", "month", "n_batches", *[rounded(c).alias(c) for c in ["kwh_per_ton", "tons", "downtime_hours", "maintenance_cost", "energy_cost"]])


def ev_report_alloys(spark, folder):
    return report.alloy_table(_report(spark, folder)).select("plant", "AlloyType", "n_batches", rounded("tons").alias("tons"), rounded("kwh_per_ton").alias("kwh_per_ton"))


def ev_report_downtime(spark, folder):
    d = report.in_period(downtime(spark, folder), "StartTime", F.lit(AS_OF_EVENTS).cast("date"))
    return report.top_downtime(d).withColumn("DurationHours", rounded("DurationHours"))


def ev_report_work_orders(spark, folder):
    m = report.in_period(work_orders(spark, folder), "Date", F.lit(AS_OF_EVENTS).cast("date"))
    return report.top_work_orders(m).withColumn("Cost", rounded("Cost"))


def ev_distinct_links(spark, folder):
    return report.distinct_links(work_orders(spark, folder), {"AlarmID": "TriggeringAlarmID", "DowntimeID": "RelatedDowntimeID"}, keys=["plant"])


def ev_lab_batches(spark, folder):
    out = quality.lab_with_batch(lab(spark, folder), batches(spark, folder))
    return out.groupBy("AlloyType").agg(F.count(F.lit(1)).alias("n"), F.count("plant").alias("n_matched"), rounded(F.sum("Mn_pct")).alias("mn"))


def ev_quality(spark, folder):
    joined = quality.lab_with_batch(lab(spark, folder), batches(spark, folder)).where(F.col("plant").isNotNull())
    out = quality.quality_by_alloy(quality.target_deviation(joined), ["plant", "AlloyType"])
    return out.select("plant", "AlloyType", "element", "n", *[rounded(c).alias(c) for c in ["mean_deviation", "std_deviation", "mean_abs_deviation"]])


def ev_quality_all(spark, folder):
    """Every lab result; those without a batch are a group of their own, without a target to deviate from."""
    joined = quality.lab_with_batch(lab(spark, folder), batches(spark, folder)).withColumn("plant", F.coalesce("plant", F.lit("unknown")))
    out = quality.quality_by_alloy(quality.target_deviation(joined), ["plant", "AlloyType"])
    return out.select("plant", "AlloyType", "element", "n", "n_results", *[rounded(c).alias(c) for c in ["mean_deviation", "std_deviation", "mean_abs_deviation"]])


def ev_iron_closure(spark, folder):
    out = lab(spark, folder).withColumn("Fe_pct", quality.iron_closure(F.col("Mn_pct"), F.col("Si_pct"), F.col("C_pct")))
    return out.groupBy("part").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("Fe_pct")).alias("iron"), rounded(F.min("Fe_pct")).alias("least"))


def ev_emissions(spark, folder):
    """Monthly event values per plant as emission figures, one event type per parameter."""
    named = F.create_map(*[F.lit(x) for kv in [
        ("click", "CO2 eq."), ("error", "SOx"), ("purchase", "NOx"), ("signup", "Dust (Stack)"), ("view", "Dust (Fugitive)")] for x in kv])
    e = plant_events(spark, folder).select("plant", "ts", named[F.col("event_type")].alias("parameter"), (F.col("value") / 1000).alias("value"))
    out = quality.monthly_compliance(e, "ts")
    return out.select("plant", "month", "parameter", rounded("value").alias("value"), "limit", "status")


def ev_incident_rollup(spark, folder):
    return quality.incident_rollup(incidents(spark, folder))


def ev_file_edges(spark, folder):
    return graph.file_edges(inventory(spark, folder))


def _edges(spark, folder) -> DataFrame:
    m = graph.entity_edges(work_orders(spark, folder), "MWO_ID", {"TriggeringAlarmID": "AlarmID", "RelatedDowntimeID": "DowntimeID"})
    d = graph.entity_edges(downtime(spark, folder), "DowntimeID", {"TriggeringAlarmID": "AlarmID", "RelatedMWO_ID": "MWO_ID"})
    return graph.file_edges(inventory(spark, folder)).unionByName(m).unionByName(d)


def ev_degrees(spark, folder):
    return graph.degrees(_edges(spark, folder))


def ev_neighbourhood(spark, folder):
    """Everything within three steps of a downtime longer than a day."""
    seeds = causes.major_downtime(downtime(spark, folder)).select(F.col("DowntimeID").alias("node"))
    return graph.neighbourhood(_edges(spark, folder), seeds, 3).select("node", "distance")


def ev_text_ids(spark, folder):
    """Ids written in the action texts of incidents."""
    i = incidents(spark, folder).withColumn("text", F.array_join("actions", " "))
    return graph.text_edges(i, "incident_id", "text").select("src", "dst", entity_kind(F.col("dst")).alias("kind"))


def ev_first_ids(spark, folder):
    i = incidents(spark, folder)
    found = ids_in_text(F.array_join("actions", " "))
    return i.select("incident_id", F.size(found).cast("long").alias("n"), F.array_join(F.transform(found, short_id), " ").alias("short"))


def ev_tag_parts(spark, folder):
    e = plant_events(spark, folder).select(F.concat("tag", F.lit("-TE-"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("sensor")).distinct()
    p = tag_parts(F.col("sensor"))
    return e.select("sensor", *[p[c].alias(c) for c in ["plant", "area", "equipment", "equipment_type", "equipment_no", "measure", "instance"]],
                    prefix(F.col("sensor")).alias("first"), short_id(F.col("sensor")).alias("last"))


def ev_alarm_records(spark, folder):
    """Alarms written as JSON arrays, one per file and of bounded size, read back with the given schema."""
    path = scratch_path(spark, "alarms")
    a = alarms(spark, folder)
    record = F.to_json(F.struct(*[c for c in a.columns if c != "plant"]), {"timestampFormat": "yyyy-MM-dd HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"})
    number = F.conv(short_id(F.col("AlarmID")), 16, 10).cast("long")
    blocks = a.select("plant", F.floor(number / RECORDS_PER_FILE).alias("block"), record.alias("r"))
    arrays = blocks.groupBy("plant", "block").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("value"))
    arrays.write.partitionBy("plant", "block").text(path)
    back = read_alarms(spark, f"{path}/*/*")
    return back.groupBy("Priority", "Resolved").agg(F.count(F.lit(1)).alias("n"), stamp(F.min("Timestamp")).alias("first"), stamp(F.max("Timestamp")).alias("last"))


def ev_inventory_roundtrip(spark, folder):
    """Inventory written sorted by path and read back with its forced schema."""
    path = scratch_path(spark, "inventory")
    write_inventory(inventory(spark, folder), path)
    back = read_inventory(spark, path)
    return back.select("file_path", "plant_code", F.size("equipment_tags").cast("long").alias("n_tags"), F.size("linked_ids").cast("long").alias("n_links"),
                       F.date_format(date_range_start(F.col("date_range")), "yyyy-MM-dd").alias("first"), F.date_format(date_range_end(F.col("date_range")), "yyyy-MM-dd").alias("last"))


QUERIES = {
    "ev_attribute_downtime": _attributed(WINDOW_ROWS),
    # in chunks, as for equipment with too many events for one task
    "ev_attribute_downtime_chunked": _attributed(0),
} | {f.__name__: f for f in [
    ev_needs_downtime, ev_triggers_maintenance, ev_of_plant, ev_downtime_with_alarm, ev_work_order_causes, ev_resolution, ev_unlinked,
    ev_dangling, ev_attribute_work_orders, ev_same_day_downtime, ev_event_chain, ev_trigger_lookup, ev_trigger_lookup_all,
    ev_cause_candidates, ev_report_kpis, ev_report_months, ev_report_alloys, ev_report_downtime, ev_report_work_orders, ev_distinct_links, ev_lab_batches,
    ev_quality, ev_quality_all, ev_iron_closure, ev_emissions, ev_incident_rollup, ev_file_edges, ev_degrees, ev_neighbourhood, ev_text_ids, ev_first_ids,
    ev_tag_parts, ev_alarm_records, ev_inventory_roundtrip,
]}

V = EVENT_VIEWS_SQL
_PERIOD_ORDERS = "Date >= DATE '2001-06-01'"
_PERIOD_EVENTS = "{0} >= DATE '2024-01-01'"
_LAG = "(epoch_us({0}) - epoch_us({1})) / 60000000.0"
_ATTRIBUTED = f"""att AS (SELECT EquipmentTag, DowntimeID, AlarmID, lag FROM (
  SELECT d.EquipmentTag, d.DowntimeID, a.AlarmID, {_LAG.format('d.StartTime', 'a.Timestamp')} AS lag,
  row_number() OVER (PARTITION BY d.DowntimeID ORDER BY a.Timestamp DESC, a.AlarmID DESC) AS r
  FROM {{downtime}} d JOIN alarms a ON d.EquipmentTag = a.EquipmentTag AND a.Timestamp <= d.StartTime - INTERVAL 5 MINUTE AND a.Timestamp >= d.StartTime - INTERVAL 60 MINUTE) WHERE r = 1)"""
_SAME_DAY = """sd AS (SELECT m.EquipmentTag, m.MWO_ID, d.DowntimeID FROM {orders} m JOIN (
  SELECT EquipmentTag, CAST(StartTime AS DATE) AS Date, arg_min(DowntimeID, (StartTime, DowntimeID)) AS DowntimeID FROM downtime GROUP BY 1, 2) d
  ON m.EquipmentTag = d.EquipmentTag AND m.Date = d.Date)"""
_REPORTS = """reports AS (SELECT replace(incident_id, 'INC', 'RCA') AS rca_id, incident_id AS trigger_id, CAST(ts AS DATE) + 3 AS rca_date FROM incidents
  UNION ALL SELECT replace(DowntimeID, 'DWT', 'RCA'), DowntimeID, CAST(StartTime AS DATE) + 5 FROM downtime)"""
_FILES = "files AS (SELECT *, plant || '/Safety_Data/' || incident_id || '_SafetyIncidentReport.docx' AS file_path FROM incidents)"
_FILE_EDGES = """fe AS (SELECT DISTINCT file_path AS src, dst, kind FROM (SELECT file_path, mwo AS dst, 'work order' AS kind FROM files WHERE mwo IS NOT NULL
  UNION ALL SELECT file_path, rca, 'root cause' FROM files WHERE rca IS NOT NULL))"""
_EDGES = _FILES + ", " + _FILE_EDGES + """, edges AS (SELECT src, dst, kind FROM fe UNION ALL
  SELECT DISTINCT MWO_ID, TriggeringAlarmID, 'alarm' FROM work_orders WHERE TriggeringAlarmID IS NOT NULL UNION ALL
  SELECT DISTINCT MWO_ID, RelatedDowntimeID, 'downtime' FROM work_orders WHERE RelatedDowntimeID IS NOT NULL UNION ALL
  SELECT DISTINCT DowntimeID, TriggeringAlarmID, 'alarm' FROM downtime WHERE TriggeringAlarmID IS NOT NULL UNION ALL
  SELECT DISTINCT DowntimeID, RelatedMWO_ID, 'work order' FROM downtime WHERE RelatedMWO_ID IS NOT NULL)"""


def _short(c: str) -> str:
    return f"string_split({c}, '-')[-1]"


ORACLES = {
    "ev_needs_downtime": V + "SELECT AlarmID, Priority FROM alarms WHERE Priority IN ('High', 'Critical') AND NOT Resolved",
    "ev_triggers_maintenance": V + """SELECT AlarmID AS id, 'alarm' AS kind FROM alarms WHERE Priority IN ('Medium', 'High', 'Critical') AND NOT Resolved
UNION ALL SELECT DowntimeID, 'downtime' FROM downtime WHERE Reason LIKE '%Maintenance%' OR Reason LIKE '%Failure%'""",
    "ev_of_plant": V + "SELECT AlarmID, EquipmentTag FROM alarms WHERE AlarmID LIKE '%-PLB-%'",
    "ev_downtime_with_alarm": V + """SELECT DowntimeID, TriggeringAlarmID, strftime(Timestamp, '%Y-%m-%d %H:%M:%S') AS alarm_time, Priority AS priority
FROM downtime LEFT JOIN alarms ON TriggeringAlarmID = AlarmID""",
    "ev_work_order_causes": V + """SELECT MWO_ID, AlarmID AS alarm, DowntimeID AS downtime, round(3e-9 + DurationHours, 4) + 0.0 AS hours
FROM work_orders m LEFT JOIN alarms ON m.TriggeringAlarmID = AlarmID LEFT JOIN downtime ON RelatedDowntimeID = DowntimeID""",
    "ev_resolution": V + """SELECT AlarmID, Resolved OR m IS NOT NULL AS Resolved, m AS TriggeredMaintenanceID FROM alarms
LEFT JOIN (SELECT TriggeringAlarmID AS a, min(MWO_ID) AS m FROM work_orders WHERE TriggeringAlarmID IS NOT NULL GROUP BY 1) ON a = AlarmID""",
    "ev_unlinked": V + """SELECT DowntimeID AS id, 'downtime' AS kind FROM downtime WHERE TriggeringAlarmID IS NULL
UNION ALL SELECT MWO_ID, 'work order' FROM work_orders WHERE TriggeringAlarmID IS NULL AND RelatedDowntimeID IS NULL""",
    "ev_dangling": V + "SELECT DowntimeID, TriggeringAlarmID FROM downtime WHERE TriggeringAlarmID IS NOT NULL AND TriggeringAlarmID NOT IN (SELECT AlarmID FROM alarms)",
    "ev_attribute_downtime": V + ", " + _ATTRIBUTED.format(downtime="downtime") + " SELECT EquipmentTag, DowntimeID, AlarmID, round(3e-9 + lag, 4) + 0.0 AS lag_minutes FROM att",
    "ev_attribute_downtime_chunked": V + ", " + _ATTRIBUTED.format(downtime="downtime") + " SELECT EquipmentTag, DowntimeID, AlarmID, round(3e-9 + lag, 4) + 0.0 AS lag_minutes FROM att",
    "ev_attribute_work_orders": V + """SELECT EquipmentTag, MWO_ID, AlarmID, lag_days FROM (
SELECT m.EquipmentTag, MWO_ID, a.AlarmID, date_diff('day', CAST(a.Timestamp AS DATE), m.Date) AS lag_days,
row_number() OVER (PARTITION BY MWO_ID ORDER BY CAST(a.Timestamp AS DATE) DESC, a.AlarmID DESC) AS r FROM work_orders m JOIN alarms a
ON m.EquipmentTag = a.EquipmentTag AND date_diff('day', CAST(a.Timestamp AS DATE), m.Date) BETWEEN 0 AND 2) WHERE r = 1""",
    "ev_same_day_downtime": V + ", " + _SAME_DAY.format(orders="work_orders") + " SELECT EquipmentTag, MWO_ID, DowntimeID FROM sd",
    "ev_event_chain": V + ", " + _ATTRIBUTED.format(downtime="(SELECT * FROM downtime WHERE TriggeringAlarmID IS NULL)") + ", "
    + _SAME_DAY.format(orders="(SELECT * FROM work_orders WHERE TriggeringAlarmID IS NULL AND RelatedDowntimeID IS NULL)") + ", " + _REPORTS + f""",
o AS (SELECT m.*, coalesce(m.RelatedDowntimeID, sd.DowntimeID) AS d, CASE WHEN m.RelatedDowntimeID IS NOT NULL THEN 'recorded' ELSE 'interval' END AS l
  FROM work_orders m LEFT JOIN sd ON sd.MWO_ID = m.MWO_ID),
f AS (SELECT d, arg_min(MWO_ID, (Date, MWO_ID)) AS MWO_ID, arg_min(l, (Date, MWO_ID)) AS l, min(Date) AS Date, count(*) AS n FROM o WHERE d IS NOT NULL GROUP BY 1)
SELECT w.DowntimeID, coalesce(w.TriggeringAlarmID, att.AlarmID) AS AlarmID,
CASE WHEN w.TriggeringAlarmID IS NOT NULL THEN 'recorded' WHEN att.AlarmID IS NOT NULL THEN 'interval' END AS alarm_link,
round(3e-9 + {_LAG.format('w.StartTime', 'a.Timestamp')}, 4) + 0.0 AS alarm_lag_minutes, f.MWO_ID, f.l AS work_order_link,
date_diff('day', CAST(w.StartTime AS DATE), f.Date) AS work_order_lag_days, coalesce(f.n, 0) AS n_work_orders, r.rca_id,
date_diff('day', CAST(w.StartTime AS DATE), r.rca_date) AS rca_lag_days
FROM downtime w LEFT JOIN att ON att.DowntimeID = w.DowntimeID LEFT JOIN alarms a ON a.AlarmID = coalesce(w.TriggeringAlarmID, att.AlarmID)
LEFT JOIN f ON f.d = w.DowntimeID LEFT JOIN reports r ON r.trigger_id = w.DowntimeID""",
    "ev_trigger_lookup": V + ", " + _REPORTS + """ SELECT rca_id, trigger_id, string_split(trigger_id, '-')[1] AS prefix, coalesce(d.EquipmentTag, i.equipment) AS tag,
strftime(coalesce(CAST(d.StartTime AS DATE), CAST(i.ts AS DATE)), '%Y-%m-%d') AS event_date, d.TriggeringAlarmID AS alarm_id, d.RelatedMWO_ID AS linked_id
FROM reports LEFT JOIN downtime d ON trigger_id = d.DowntimeID LEFT JOIN incidents i ON trigger_id = i.incident_id""",
    "ev_trigger_lookup_all": V + ", " + _REPORTS + """, asked AS (SELECT rca_id, trigger_id FROM reports
UNION ALL SELECT replace(MWO_ID, 'MWO', 'RCA'), MWO_ID FROM work_orders UNION ALL SELECT replace(MWO_ID, 'MWO', 'RCA'), replace(MWO_ID, 'MWO', 'ORD') FROM work_orders)
SELECT rca_id, trigger_id, string_split(trigger_id, '-')[1] AS prefix,
CASE WHEN d.DowntimeID IS NOT NULL THEN 'downtime' WHEN m.MWO_ID IS NOT NULL THEN 'work order' WHEN i.incident_id IS NOT NULL THEN 'incident' END AS kind,
coalesce(d.EquipmentTag, m.EquipmentTag, i.equipment) AS tag, strftime(coalesce(CAST(d.StartTime AS DATE), m.Date, CAST(i.ts AS DATE)), '%Y-%m-%d') AS event_date,
coalesce(d.TriggeringAlarmID, m.TriggeringAlarmID) AS alarm_id, coalesce(d.RelatedMWO_ID, m.RelatedDowntimeID) AS linked_id,
CASE WHEN d.DowntimeID IS NULL AND m.MWO_ID IS NULL AND i.incident_id IS NULL THEN 'Analysis of Event ' || trigger_id END AS description
FROM asked LEFT JOIN downtime d ON trigger_id = d.DowntimeID LEFT JOIN work_orders m ON trigger_id = m.MWO_ID LEFT JOIN incidents i ON trigger_id = i.incident_id""",
    "ev_cause_candidates": V + """SELECT incident_id AS trigger_id, 'incident' AS kind, equipment AS tag, strftime(ts, '%Y-%m-%d') AS event_date, NULL::DOUBLE AS magnitude,
NULL AS alarm_id, NULL AS linked_id, 'Safety Incident Report for ' || type || ' (' || severity || ').' AS description FROM incidents WHERE severity IN ('Serious', 'Major')
UNION ALL SELECT DowntimeID, 'downtime', EquipmentTag, strftime(StartTime, '%Y-%m-%d'), round(3e-9 + DurationHours, 4) + 0.0, TriggeringAlarmID, RelatedMWO_ID, NULL FROM downtime WHERE DurationHours > 24
UNION ALL SELECT MWO_ID, 'work order', EquipmentTag, strftime(Date, '%Y-%m-%d'), round(3e-9 + Cost, 4) + 0.0, TriggeringAlarmID, RelatedDowntimeID, NULL FROM work_orders WHERE Cost > 5000 OR MaintenanceType = 'Breakdown'""",
    "ev_report_alloys": with_sql(BATCHES_SQL) + f"""SELECT plant, AlloyType, count(*) AS n_batches, round(3e-9 + sum(TapWeight_tons), 4) + 0.0 AS tons,
round(3e-9 + CASE WHEN sum(TapWeight_tons) > 0 THEN sum(Energy_kWh) / sum(TapWeight_tons) ELSE 0 END, 4) + 0.0 AS kwh_per_ton FROM batches WHERE {_PERIOD_ORDERS} GROUP BY 1, 2""",
    "ev_report_downtime": V + f"""SELECT plant, CAST(r AS INTEGER) AS rank, {_short('DowntimeID')} AS downtime, EquipmentTag, round(3e-9 + DurationHours, 4) + 0.0 AS DurationHours, Reason,
{_short('TriggeringAlarmID')} AS alarm, {_short('RelatedMWO_ID')} AS work_order FROM (SELECT *, row_number() OVER (PARTITION BY plant ORDER BY DurationHours DESC, DowntimeID) AS r
FROM downtime WHERE DurationHours > 4 AND {_PERIOD_EVENTS.format('StartTime')}) WHERE r <= 5""",
    "ev_report_work_orders": V + f"""SELECT plant, CAST(r AS INTEGER) AS rank, {_short('MWO_ID')} AS work_order, EquipmentTag, MaintenanceType, round(3e-9 + Cost, 4) + 0.0 AS Cost,
{_short('TriggeringAlarmID')} AS alarm, {_short('RelatedDowntimeID')} AS downtime FROM (SELECT *, row_number() OVER (PARTITION BY plant ORDER BY Cost DESC, MWO_ID) AS r
FROM work_orders WHERE (Cost > 1000 OR MaintenanceType = 'Breakdown') AND {_PERIOD_EVENTS.format('Date')}) WHERE r <= 5""",
    "ev_distinct_links": V + """SELECT DISTINCT * FROM (SELECT plant, 'EquipmentTag' AS name, EquipmentTag AS value FROM work_orders UNION ALL
SELECT plant, 'AlarmID', TriggeringAlarmID FROM work_orders UNION ALL SELECT plant, 'DowntimeID', RelatedDowntimeID FROM work_orders) WHERE value IS NOT NULL""",
    "ev_lab_batches": with_sql(BATCHES_SQL, LAB_SQL) + """SELECT coalesce(AlloyType, 'unknown') AS AlloyType, count(*) AS n, count(plant) AS n_matched, round(3e-9 + sum(mn_pct), 4) + 0.0 AS mn
FROM lab LEFT JOIN batches ON ProductionBatchID = BatchID GROUP BY 1""",
    "ev_quality": with_sql(BATCHES_SQL, LAB_SQL) + " UNION ALL ".join(
        f"""SELECT plant, AlloyType, '{e}' AS element, count(*) AS n, round(3e-9 + avg({x}_pct - {x}), 4) + 0.0 AS mean_deviation,
round(3e-9 + stddev_samp({x}_pct - {x}), 4) + 0.0 AS std_deviation, round(3e-9 + avg(abs({x}_pct - {x})), 4) + 0.0 AS mean_abs_deviation
FROM lab JOIN batches ON ProductionBatchID = BatchID GROUP BY 1, 2""" for e, x in [("Mn", "mn"), ("Si", "si"), ("C", "c")]),
    "ev_quality_all": with_sql(BATCHES_SQL, LAB_SQL) + " UNION ALL ".join(
        f"""SELECT coalesce(plant, 'unknown') AS plant, coalesce(AlloyType, '{quality.UNKNOWN_ALLOY}') AS AlloyType, '{e}' AS element, count({x}_pct - {x}) AS n, count(*) AS n_results,
round(3e-9 + avg({x}_pct - {x}), 4) + 0.0 AS mean_deviation, round(3e-9 + stddev_samp({x}_pct - {x}), 4) + 0.0 AS std_deviation,
round(3e-9 + avg(abs({x}_pct - {x})), 4) + 0.0 AS mean_abs_deviation
FROM lab LEFT JOIN batches ON ProductionBatchID = BatchID GROUP BY 1, 2""" for e, x in [("Mn", "mn"), ("Si", "si"), ("C", "c")]),
    "ev_iron_closure": with_sql(LAB_SQL, "f AS (SELECT part, greatest(0, round(100.0 - mn_pct - si_pct - c_pct, 2)) AS fe FROM lab)")
    + "SELECT part, count(*) AS n, round(3e-9 + sum(fe), 4) + 0.0 AS iron, round(3e-9 + min(fe), 4) + 0.0 AS least FROM f GROUP BY 1",
    "ev_emissions": with_sql(PLANT_EVENTS_SQL, """m AS (SELECT plant, strftime(ts, '%Y_%m') AS month, CASE event_type WHEN 'click' THEN 'CO2 eq.' WHEN 'error' THEN 'SOx'
  WHEN 'purchase' THEN 'NOx' WHEN 'signup' THEN 'Dust (Stack)' ELSE 'Dust (Fugitive)' END AS parameter, sum(value / 1000) AS value FROM pe GROUP BY ALL)""")
    + """SELECT plant, month, parameter, round(3e-9 + value, 4) + 0.0 AS value, CASE parameter WHEN 'SOx' THEN 60.0::DOUBLE WHEN 'NOx' THEN 30.0::DOUBLE WHEN 'Dust (Stack)' THEN 5.0::DOUBLE END AS "limit",
CASE parameter WHEN 'CO2 eq.' THEN 'N/A' WHEN 'Dust (Fugitive)' THEN 'Monitored' ELSE CASE WHEN value <= CASE parameter WHEN 'SOx' THEN 60 WHEN 'NOx' THEN 30 ELSE 5 END
THEN 'Compliant' ELSE 'Action Required' END END AS status FROM m""",
    "ev_incident_rollup": V + "SELECT type, severity, area, count(*) AS n, count(mwo) AS n_work_order, count(rca) AS n_root_cause FROM incidents GROUP BY 1, 2, 3",
    "ev_file_edges": V + ", " + _FILES + ", " + _FILE_EDGES + " SELECT src, dst, kind FROM fe",
    "ev_degrees": V + ", " + _EDGES + """ SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) + sum(i) AS BIGINT) AS degree
FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1""",
    "ev_neighbourhood": V + ", " + _EDGES + """, b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)),
n0 AS (SELECT DowntimeID AS node, 0 AS distance FROM downtime WHERE DurationHours > 24),
n1 AS (SELECT DISTINCT dst AS node, 1 AS distance FROM b JOIN n0 ON src = node), n2 AS (SELECT DISTINCT dst AS node, 2 AS distance FROM b JOIN n1 ON src = node),
n3 AS (SELECT DISTINCT dst AS node, 3 AS distance FROM b JOIN n2 ON src = node)
SELECT node, min(distance) AS distance FROM (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3) GROUP BY 1""",
    "ev_text_ids": V + """SELECT incident_id AS src, mwo AS dst, 'work order' AS kind FROM incidents WHERE mwo IS NOT NULL
UNION ALL SELECT incident_id, rca, 'root cause' FROM incidents WHERE rca IS NOT NULL""",
    "ev_first_ids": V + f"""SELECT incident_id, CAST((mwo IS NOT NULL) AS BIGINT) + CAST((rca IS NOT NULL) AS BIGINT) AS n,
trim(coalesce({_short('mwo')}, '') || ' ' || coalesce({_short('rca')}, '')) AS short FROM incidents""",
    "ev_tag_parts": with_sql(PLANT_EVENTS_SQL, "s AS (SELECT DISTINCT tag, plant, user_id, k, tag || '-TE-' || lpad(CAST(k AS VARCHAR), 3, '0') AS sensor FROM pe)")
    + """SELECT sensor, plant, string_split(tag, '-')[2] AS area, tag AS equipment, 'EAF' AS equipment_type, CAST(user_id AS INTEGER) AS equipment_no, 'TE' AS measure,
CAST(k AS INTEGER) AS instance, plant AS first, lpad(CAST(k AS VARCHAR), 3, '0') AS last FROM s""",
    "ev_alarm_records": V + """SELECT Priority, Resolved, count(*) AS n, strftime(min(Timestamp), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(Timestamp), '%Y-%m-%d %H:%M:%S') AS last
FROM alarms GROUP BY 1, 2""",
    "ev_inventory_roundtrip": V + ", " + _FILES + """ SELECT file_path, plant AS plant_code, CAST(1 AS BIGINT) AS n_tags, CAST((mwo IS NOT NULL) AS BIGINT) + CAST((rca IS NOT NULL) AS BIGINT) AS n_links,
strftime(ts, '%Y-%m-%d') AS first, strftime(ts, '%Y-%m-%d') AS last FROM files""",
}
ORACLES["ev_report_kpis"] = V[:-1] + ", " + BATCHES_SQL + f""",
b AS (SELECT plant, count(*) AS n_batches, avg(CASE WHEN TapWeight_tons > 0 THEN Energy_kWh / TapWeight_tons END) AS k, sum(TapWeight_tons) AS tons FROM batches WHERE {_PERIOD_ORDERS} GROUP BY 1),
d AS (SELECT plant, sum(DurationHours) AS h FROM downtime WHERE {_PERIOD_EVENTS.format('StartTime')} GROUP BY 1),
m AS (SELECT plant, sum(Cost) AS c FROM work_orders WHERE {_PERIOD_EVENTS.format('Date')} GROUP BY 1)
SELECT plant, coalesce(n_batches, 0) AS n_batches, round(3e-9 + coalesce(k, 0), 4) + 0.0 AS kwh_per_ton, round(3e-9 + coalesce(tons, 0), 4) + 0.0 AS tons,
round(3e-9 + coalesce(h, 0), 4) + 0.0 AS downtime_hours, round(3e-9 + coalesce(c, 0), 4) + 0.0 AS maintenance_cost, round(3e-9 + coalesce(k, 0) * coalesce(tons, 0) * 0.1, 4) + 0.0 AS energy_cost
FROM b FULL JOIN d USING (plant) FULL JOIN m USING (plant)"""

ORACLES["ev_report_months"] = V[:-1] + ", " + BATCHES_SQL + """,
b AS (SELECT 'PL' || chr(CAST(65 + BatchID % 3 AS INTEGER)) AS plant, strftime(Date, '%m') AS month, count(*) AS n_batches,
  avg(CASE WHEN TapWeight_tons > 0 THEN Energy_kWh / TapWeight_tons END) AS k, sum(TapWeight_tons) AS tons FROM batches GROUP BY 1, 2),
d AS (SELECT plant, strftime(StartTime, '%m') AS month, sum(DurationHours) AS h FROM downtime GROUP BY 1, 2),
m AS (SELECT plant, strftime(Date, '%m') AS month, sum(Cost) AS c FROM work_orders GROUP BY 1, 2)
SELECT plant, month, coalesce(n_batches, 0) AS n_batches, round(3e-9 + coalesce(k, 0), 4) + 0.0 AS kwh_per_ton, round(3e-9 + coalesce(tons, 0), 4) + 0.0 AS tons,
round(3e-9 + coalesce(h, 0), 4) + 0.0 AS downtime_hours, round(3e-9 + coalesce(c, 0), 4) + 0.0 AS maintenance_cost, round(3e-9 + coalesce(k, 0) * coalesce(tons, 0) * 0.1, 4) + 0.0 AS energy_cost
FROM b FULL JOIN d USING (plant, month) FULL JOIN m USING (plant, month)"""
