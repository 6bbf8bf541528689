"""Links between alarms, downtime and work orders: recorded keys and interval attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantlake.joins import join_hot, join_sized, left_join_key
from plantlake.ordered import WINDOW_ROWS, last_before
from plantlake.session import settle

# fixed values: lags of the attribution rules
DOWNTIME_LAG_MINUTES = (5, 60)
WORK_ORDER_LAG_DAYS = (0, 2)


def needs_downtime(alarms: DataFrame) -> DataFrame:
    return alarms.where(F.col("Priority").isin("High", "Critical") & ~F.col("Resolved"))


def triggers_maintenance(alarms: DataFrame) -> DataFrame:
    return alarms.where(F.col("Priority").isin("Medium", "High", "Critical") & ~F.col("Resolved"))


def maintenance_downtime(downtime: DataFrame) -> DataFrame:
    return downtime.where(F.col("Reason").contains("Maintenance") | F.col("Reason").contains("Failure"))


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def downtime_with_alarm(downtime: DataFrame, alarms: DataFrame) -> DataFrame:
    """Each downtime with its recorded alarm (columns prefixed ``alarm_``), if any."""
    return left_join_key(downtime, with_prefix(alarms, "alarm_"), "TriggeringAlarmID", "alarm_AlarmID", "DowntimeID")


def work_order_with_causes(work_orders: DataFrame, alarms: DataFrame, downtime: DataFrame) -> DataFrame:
    """Each work order with its recorded alarm and downtime, if any."""
    one = left_join_key(work_orders, with_prefix(alarms, "alarm_"), "TriggeringAlarmID", "alarm_AlarmID", "MWO_ID")
    return left_join_key(one, with_prefix(downtime, "downtime_"), "RelatedDowntimeID", "downtime_DowntimeID", "MWO_ID")


def unlinked(events: DataFrame, *link_columns: str) -> DataFrame:
    """Events none of whose link columns is set."""
    for c in link_columns:
        events = events.where(F.col(c).isNull())
    return events


def dangling(events: DataFrame, link: str, targets: DataFrame, target_id: str) -> DataFrame:
    """Events whose link is set but names no existing target."""
    known = targets.select(F.col(target_id).alias(link)).distinct()
    return join_hot(events.where(F.col(link).isNotNull()), known, [link], "left_anti")


def propagate_resolution(alarms: DataFrame, work_orders: DataFrame) -> DataFrame:
    """Alarms with a work order become resolved and carry the smallest id among their work orders."""
    first = work_orders.where(F.col("TriggeringAlarmID").isNotNull()).groupBy(
        F.col("TriggeringAlarmID").alias("AlarmID")
    ).agg(F.min("MWO_ID").alias("_mwo"))
    joined = alarms.join(first, "AlarmID", "left")
    return joined.withColumn("Resolved", F.col("_mwo").isNotNull() | F.col("Resolved")).withColumn(
        "TriggeredMaintenanceID", F.coalesce("_mwo", "TriggeredMaintenanceID")
    ).drop("_mwo")


def attribute_downtime(
    alarms: DataFrame, downtime: DataFrame, lag_minutes: tuple[int, int] = DOWNTIME_LAG_MINUTES, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """(EquipmentTag, DowntimeID, AlarmID, lag_minutes): the nearest alarm within the lag on the same equipment.

    Downtime without such an alarm is left out. Equal alarm times go to the largest id.
    """
    low, high = lag_minutes
    shifted = downtime.withColumn("_latest", F.col("StartTime") - F.expr(f"interval {low} minutes"))
    found = last_before(
        alarms.withColumnRenamed("Timestamp", "_alarm_time"), shifted, ["EquipmentTag"],
        "_alarm_time", "_latest", "AlarmID", "DowntimeID", window_rows,
    )
    lag = (F.unix_micros(F.col("_latest").cast("timestamp")) - F.unix_micros(F.col("_alarm_time").cast("timestamp"))) / 60e6 + low
    return found.withColumn("lag_minutes", lag).where(F.col("lag_minutes") <= high).select(
        "EquipmentTag", "DowntimeID", "AlarmID", "lag_minutes"
    )


def attribute_work_orders(
    alarms: DataFrame, work_orders: DataFrame, lag_days: tuple[int, int] = WORK_ORDER_LAG_DAYS
) -> DataFrame:
    """(EquipmentTag, MWO_ID, AlarmID, lag_days): the nearest alarm day within the lag on the same equipment."""
    low, high = lag_days
    days = alarms.withColumn("_alarm_day", F.col("Timestamp").cast("date"))
    shifted = work_orders.withColumn("_latest", F.date_sub("Date", low))
    found = last_before(days, shifted, ["EquipmentTag"], "_alarm_day", "_latest", "AlarmID", "MWO_ID")
    lag = F.datediff("_latest", "_alarm_day") + low
    return found.withColumn("lag_days", lag).where(F.col("lag_days") <= high).select(
        "EquipmentTag", "MWO_ID", "AlarmID", "lag_days"
    )


def same_day_downtime(downtime: DataFrame, work_orders: DataFrame) -> DataFrame:
    """(EquipmentTag, MWO_ID, DowntimeID): the first downtime of the work order's day on the same equipment."""
    first = downtime.groupBy("EquipmentTag", F.col("StartTime").cast("date").alias("Date")).agg(
        F.min(F.struct("StartTime", "DowntimeID")).alias("_first")
    )
    keyed = work_orders.select("EquipmentTag", F.col("Date").cast("date").alias("Date"), "MWO_ID")
    return join_sized(keyed, first, ["EquipmentTag", "Date"], "inner").select(
        "EquipmentTag", "MWO_ID", F.col("_first.DowntimeID").alias("DowntimeID")
    )


def _recorded_or_found(events: DataFrame, found: DataFrame, event_id: str, link: str, target: str, source: str) -> DataFrame:
    """Fill a missing link from the attribution and say where it came from."""
    other = found.select(event_id, F.col(target).alias("_found"))
    joined = events.join(other, event_id, "left")
    origin = F.when(F.col(link).isNotNull(), "recorded").when(F.col("_found").isNotNull(), "interval")
    return joined.withColumn(source, origin).withColumn(link, F.coalesce(link, "_found")).drop("_found")


def event_chain(alarms: DataFrame, downtime: DataFrame, work_orders: DataFrame, rca: DataFrame | None = None) -> DataFrame:
    """One row per downtime: its alarm, its work order, its root-cause report, and the lags between them.

    Recorded links come first; a missing one is filled by interval attribution.
    """
    open_downtime = unlinked(downtime, "TriggeringAlarmID")
    down = settle(_recorded_or_found(
        downtime, attribute_downtime(alarms, open_downtime), "DowntimeID", "TriggeringAlarmID", "AlarmID", "alarm_link"
    ), "down")
    open_orders = unlinked(work_orders, "RelatedDowntimeID", "TriggeringAlarmID")
    orders = _recorded_or_found(
        work_orders, same_day_downtime(downtime, open_orders), "MWO_ID", "RelatedDowntimeID", "DowntimeID", "work_order_link"
    )
    first_order = orders.where(F.col("RelatedDowntimeID").isNotNull()).groupBy(F.col("RelatedDowntimeID").alias("DowntimeID")).agg(
        F.min(F.struct(F.col("Date").cast("date").alias("Date"), "MWO_ID", "work_order_link", "Cost")).alias("_o"),
        F.count(F.lit(1)).alias("n_work_orders"),
    )
    times = alarms.select(F.col("AlarmID").alias("alarm_AlarmID"), F.col("Timestamp").alias("_alarm_time"))
    out = left_join_key(down, times, "TriggeringAlarmID", "alarm_AlarmID", "DowntimeID").join(first_order, "DowntimeID", "left")
    start = F.col("StartTime").cast("timestamp")
    lag = (F.unix_micros(start) - F.unix_micros(F.col("_alarm_time").cast("timestamp"))) / 60e6
    columns: list[Column] = [
        F.col("EquipmentTag"), F.col("DowntimeID"), F.col("StartTime"), F.col("DurationHours"),
        F.col("TriggeringAlarmID").alias("AlarmID"), F.col("alarm_link"), lag.alias("alarm_lag_minutes"),
        F.col("_o.MWO_ID").alias("MWO_ID"), F.col("_o.work_order_link").alias("work_order_link"),
        F.datediff(F.col("_o.Date"), start.cast("date")).alias("work_order_lag_days"),
        F.coalesce("n_work_orders", F.lit(0)).alias("n_work_orders"),
    ]
    if rca is not None:
        first_rca = rca.groupBy(F.col("trigger_id").alias("DowntimeID")).agg(F.min(F.struct("rca_date", "rca_id")).alias("_r"))
        out = out.join(first_rca, "DowntimeID", "left")
        columns += [F.col("_r.rca_id").alias("rca_id"), F.datediff(F.col("_r.rca_date"), start.cast("date")).alias("rca_lag_days")]
    return out.select(*columns)
