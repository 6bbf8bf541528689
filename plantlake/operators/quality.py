"""Lab results against batch targets, emission limits, incident roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plantlake.functions.calendar import month_label
from plantlake.functions.ids import ENTITY_ID
from plantlake.joins import join_hot

ELEMENTS = ("Mn", "Si", "C")
UNKNOWN_ALLOY = "unknown"

# fixed values: emission limits in tons/month; a null limit is not regulated
EMISSION_LIMITS = {"CO2 eq.": None, "SOx": 60.0, "NOx": 30.0, "Dust (Stack)": 5.0, "Dust (Fugitive)": None}
# fixed values: status of a parameter without a limit
NO_LIMIT_STATUS = {"CO2 eq.": "N/A", "Dust (Fugitive)": "Monitored"}


def iron_closure(*others: Column) -> Column:
    """Iron content as what is left to 100, never negative."""
    rest = F.lit(100.0)
    for c in others:
        rest = rest - c
    return F.greatest(F.lit(0.0), F.round(rest, 2))


def raw_material_total(*parts: Column) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return total


def lab_with_batch(lab: DataFrame, batches: DataFrame, default_alloy: str = UNKNOWN_ALLOY) -> DataFrame:
    """Each lab result with its batch; a missing batch gets the default alloy."""
    details = batches.withColumnRenamed("BatchID", "ProductionBatchID")
    out = join_hot(lab, details, ["ProductionBatchID"], "left")
    return out.withColumn("AlloyType", F.coalesce("AlloyType", F.lit(default_alloy)))


def target_deviation(joined: DataFrame, elements: Sequence[str] = ELEMENTS) -> DataFrame:
    """Adds ``<El>_deviation`` = measured minus target."""
    for e in elements:
        joined = joined.withColumn(f"{e}_deviation", F.col(f"{e}_pct") - F.col(f"{e}_content_pct_Target"))
    return joined


def quality_by_alloy(deviations: DataFrame, keys: Sequence[str] = ("AlloyType",), elements: Sequence[str] = ELEMENTS) -> DataFrame:
    """Per group and element: n, mean, spread and mean size of the deviation, and all lab results of the group (n_results)."""
    cells = F.array(*[F.struct(F.lit(e).alias("element"), F.col(f"{e}_deviation").alias("d")) for e in elements])
    return deviations.select(*keys, F.inline(cells)).groupBy(*keys, "element").agg(
        F.count("d").alias("n"), F.avg("d").alias("mean_deviation"), F.stddev_samp("d").alias("std_deviation"),
        F.avg(F.abs("d")).alias("mean_abs_deviation"), F.count(F.lit(1)).alias("n_results"),
    )


def emission_status(emissions: DataFrame) -> DataFrame:
    """Adds limit and status; an own ``limit`` column overrides the fixed limits."""
    limits = F.create_map(*[x for k, v in EMISSION_LIMITS.items() for x in (F.lit(k), F.lit(v).cast("double"))])
    unlimited = F.create_map(*[x for k, v in NO_LIMIT_STATUS.items() for x in (F.lit(k), F.lit(v))])
    known = limits[F.col("parameter")]
    limit = F.coalesce(F.col("limit"), known) if "limit" in emissions.columns else known
    status = (
        F.when(F.col("limit").isNull(), F.coalesce(unlimited[F.col("parameter")], F.lit("N/A")))
        .when(F.col("value") <= F.col("limit"), "Compliant").otherwise("Action Required")
    )
    return emissions.withColumn("limit", limit).withColumn("status", status)


def monthly_compliance(emissions: DataFrame, time: str, keys: Sequence[str] = ("plant",)) -> DataFrame:
    """Total per plant, month and parameter, judged against its limit."""
    monthly = emissions.groupBy(*keys, month_label(F.col(time)).alias("month"), "parameter").agg(F.sum("value").alias("value"))
    return emission_status(monthly)


def incident_rollup(incidents: DataFrame, keys: Sequence[str] = ("type", "severity", "area")) -> DataFrame:
    """Incidents per group, and how many of them asked for maintenance or for a root-cause report."""
    text = F.array_join("actions", " ")
    found = F.regexp_extract_all(text, F.lit(ENTITY_ID), 1)
    return incidents.select(*keys, found.alias("_ids")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.exists("_ids", lambda i: i.startswith("MWO-"))).alias("n_work_order"),
        F.count_if(F.exists("_ids", lambda i: i.startswith("RCA-"))).alias("n_root_cause"),
    )
