"""Monthly production report of all plants in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plantlake.functions.calendar import month_label, period_start
from plantlake.functions.ids import short_id

# fixed values: thresholds and length of the two lists
LONG_DOWNTIME_HOURS, COSTLY_WORK_ORDER, LIST_LENGTH = 4, 1000, 5


def in_period(df: DataFrame, time: str, as_of: Column | None = None) -> DataFrame:
    """Rows from the first midnight of the previous month on; with ``as_of`` unset, of today."""
    start = period_start(F.current_date() if as_of is None else as_of)
    return df.where(F.col(time).cast("timestamp") >= start)


def energy_per_ton() -> Column:
    """Mean over batches of each batch's own ratio; batches without tons do not count."""
    return F.avg(F.when(F.col("TapWeight_tons") > 0, F.col("Energy_kWh") / F.col("TapWeight_tons")))


def period_kpis(
    batches: DataFrame, downtime: DataFrame, work_orders: DataFrame, keys: Sequence[str] = ("plant",), price: float | None = None
) -> DataFrame:
    """Batches, downtime hours, maintenance cost, energy per ton, and energy cost at a given price per kWh."""
    keys = list(keys)
    made = batches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_batches"), energy_per_ton().alias("kwh_per_ton"), F.sum("TapWeight_tons").alias("tons")
    )
    down = downtime.groupBy(*keys).agg(F.sum("DurationHours").alias("downtime_hours"))
    cost = work_orders.groupBy(*keys).agg(F.sum("Cost").alias("maintenance_cost"))
    out = made.join(down, keys, "full").join(cost, keys, "full").na.fill(
        0, ["n_batches", "kwh_per_ton", "tons", "downtime_hours", "maintenance_cost"]
    )
    return out if price is None else out.withColumn("energy_cost", F.col("kwh_per_ton") * F.col("tons") * price)


def alloy_table(batches: DataFrame, keys: Sequence[str] = ("plant",)) -> DataFrame:
    """Per alloy: batches, tons, and energy per ton as a ratio of sums."""
    tons, energy = F.sum("TapWeight_tons"), F.sum("Energy_kWh")
    return batches.groupBy(*keys, "AlloyType").agg(
        F.count(F.lit(1)).alias("n_batches"), tons.alias("tons"),
        F.when(tons > 0, energy / tons).otherwise(F.lit(0.0)).alias("kwh_per_ton"),
    )


def _top(df: DataFrame, keys: Sequence[str], by: str, row_id: str, n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc(by), F.asc(row_id))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_downtime(downtime: DataFrame, keys: Sequence[str] = ("plant",), n: int = LIST_LENGTH) -> DataFrame:
    """The longest downtimes above four hours per plant, with the short ids of what they are linked to."""
    long = downtime.where(F.col("DurationHours") > LONG_DOWNTIME_HOURS)
    return _top(long, keys, "DurationHours", "DowntimeID", n).select(
        *keys, "rank", short_id(F.col("DowntimeID")).alias("downtime"), "EquipmentTag", "DurationHours", "Reason",
        short_id(F.col("TriggeringAlarmID")).alias("alarm"), short_id(F.col("RelatedMWO_ID")).alias("work_order"),
    )


def top_work_orders(work_orders: DataFrame, keys: Sequence[str] = ("plant",), n: int = LIST_LENGTH) -> DataFrame:
    """The costliest work orders among those above the cost limit or caused by a breakdown."""
    key = work_orders.where((F.col("Cost") > COSTLY_WORK_ORDER) | (F.col("MaintenanceType") == "Breakdown"))
    return _top(key, keys, "Cost", "MWO_ID", n).select(
        *keys, "rank", short_id(F.col("MWO_ID")).alias("work_order"), "EquipmentTag", "MaintenanceType", "Cost",
        short_id(F.col("TriggeringAlarmID")).alias("alarm"), short_id(F.col("RelatedDowntimeID")).alias("downtime"),
    )


def production_report(
    batches: DataFrame, downtime: DataFrame, work_orders: DataFrame, as_of: Column | None = None,
    keys: Sequence[str] = ("plant",), price: float = 0.1, month: str | None = None,
) -> dict[str, DataFrame]:
    """The four tables of the report, each keyed by plant, or by plant and month.

    ``month`` is a date pattern such as ``yyyy_MM``: every month of the tables then has its own report, instead of the
    period up to ``as_of``.
    """
    if month is None:
        b, d, m = in_period(batches, "Date", as_of), in_period(downtime, "StartTime", as_of), in_period(work_orders, "Date", as_of)
    else:
        b, d, m = (df.withColumn("month", month_label(F.col(time), month)) for df, time in [(batches, "Date"), (downtime, "StartTime"), (work_orders, "Date")])
        keys = [*keys, "month"]
    return {
        "kpis": period_kpis(b, d, m, keys, price),
        "alloys": alloy_table(b, keys),
        "downtime": top_downtime(d, keys),
        "work_orders": top_work_orders(m, keys),
    }


def distinct_links(events: DataFrame, columns: dict[str, str], tag: str | None = "EquipmentTag", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, name, value): the distinct tags and linked ids of a table, nulls left out, one row each."""
    names = ({"EquipmentTag": tag} if tag else {}) | columns
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in names.items()])
    return events.select(*keys, F.inline(cells)).where(F.col("value").isNotNull()).distinct()
