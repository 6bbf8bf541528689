"""Root-cause candidates and the lookup of what triggered a root-cause report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plantlake.functions.calendar import date_range_start
from plantlake.functions.ids import prefix
from plantlake.joins import join_hot

# fixed values: thresholds of the candidate rules
MAJOR_DOWNTIME_HOURS, MAJOR_COST = 24, 5000
SERIOUS = ("Serious", "Major")


def serious_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("severity").isin(*SERIOUS))


def major_downtime(downtime: DataFrame) -> DataFrame:
    return downtime.where(F.col("DurationHours") > MAJOR_DOWNTIME_HOURS)


def major_work_orders(work_orders: DataFrame) -> DataFrame:
    return work_orders.where((F.col("Cost") > MAJOR_COST) | (F.col("MaintenanceType") == "Breakdown"))


def incident_events(incidents: DataFrame) -> DataFrame:
    return incidents.select(
        F.col("incident_id").alias("trigger_id"), F.lit("incident").alias("kind"), F.col("equipment").alias("tag"),
        F.col("ts").cast("date").alias("event_date"), F.lit(None).cast("double").alias("magnitude"),
        F.format_string("Safety Incident Report for %s (%s).", "type", "severity").alias("description"),
        F.lit(None).cast("string").alias("alarm_id"), F.lit(None).cast("string").alias("linked_id"),
    )


def downtime_events(downtime: DataFrame) -> DataFrame:
    return downtime.select(
        F.col("DowntimeID").alias("trigger_id"), F.lit("downtime").alias("kind"), F.col("EquipmentTag").alias("tag"),
        F.col("StartTime").cast("date").alias("event_date"), F.col("DurationHours").alias("magnitude"),
        F.concat(F.lit("Downtime Event: "), "Reason", F.lit(" on "), "EquipmentTag", F.lit(" ("),
                 F.col("DurationHours").cast("string"), F.lit("h)")).alias("description"),
        F.col("TriggeringAlarmID").alias("alarm_id"), F.col("RelatedMWO_ID").alias("linked_id"),
    )


def work_order_events(work_orders: DataFrame) -> DataFrame:
    return work_orders.select(
        F.col("MWO_ID").alias("trigger_id"), F.lit("work order").alias("kind"), F.col("EquipmentTag").alias("tag"),
        F.col("Date").cast("date").alias("event_date"), F.col("Cost").alias("magnitude"),
        F.format_string("Maintenance Event: %s on %s (Cost: $%.0f)", "MaintenanceType", "EquipmentTag", "Cost").alias("description"),
        F.col("TriggeringAlarmID").alias("alarm_id"), F.col("RelatedDowntimeID").alias("linked_id"),
    )


def trigger_union(*events: DataFrame) -> DataFrame:
    """Events of different tables in one shape: id, kind, tag, date, magnitude, description, links."""
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e)
    return out


def candidates(incidents: DataFrame | None, downtime: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Everything that calls for a root-cause report, described."""
    parts = [downtime_events(major_downtime(downtime)), work_order_events(major_work_orders(work_orders))]
    if incidents is not None:
        parts.insert(0, incident_events(serious_incidents(incidents)))
    return trigger_union(*parts)


def inventory_incidents(inventory: DataFrame) -> DataFrame:
    """Incidents known from the inventory: the id stands in the file path."""
    found = F.regexp_extract("file_path", r"(INC-[A-Z]+-[0-9A-F]+)", 1)
    return inventory.where((F.col("category") == "Safety_Data") & (found != "")).groupBy(found.alias("trigger_id")).agg(
        F.min(F.struct("file_path", "date_range", "description", "equipment_tags")).alias("_i")
    ).select(
        "trigger_id", F.lit("incident").alias("kind"), F.try_element_at("_i.equipment_tags", F.lit(1)).alias("tag"),
        date_range_start(F.col("_i.date_range")).alias("event_date"), F.lit(None).cast("double").alias("magnitude"),
        F.col("_i.description").alias("description"),
        F.lit(None).cast("string").alias("alarm_id"), F.lit(None).cast("string").alias("linked_id"),
    )


def look_up_triggers(reports: DataFrame, downtime: DataFrame, work_orders: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Root-cause reports with the event their ``trigger_id`` names; unknown ids keep a generic description."""
    events = [downtime_events(downtime), work_order_events(work_orders)]
    if inventory is not None:
        events.append(inventory_incidents(inventory))
    out = join_hot(reports, trigger_union(*events), ["trigger_id"], "left")
    generic = F.concat(F.lit("Analysis of Event "), "trigger_id")
    return out.withColumn("description", F.coalesce("description", generic)).withColumn("prefix", prefix(F.col("trigger_id")))
