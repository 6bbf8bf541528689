"""Schemas and readers of plant event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# fixed values: field names of the event tables
ALARMS = (
    "AlarmID string, Timestamp timestamp, EquipmentTag string, AlarmType string, Priority string, Message string, "
    "Acknowledged boolean, Resolved boolean, TriggeredDowntimeID string, TriggeredMaintenanceID string"
)
DOWNTIME = (
    "DowntimeID string, EquipmentTag string, StartTime timestamp, EndTime timestamp, DurationHours double, Reason string, "
    "TriggeringAlarmID string, RelatedMWO_ID string"
)
WORK_ORDERS = (
    "MWO_ID string, Date date, EquipmentTag string, MaintenanceType string, Description string, Technician string, "
    "DurationHours double, PartsUsed string, Cost double, Status string, TriggeringAlarmID string, RelatedDowntimeID string"
)
BATCHES = (
    "BatchID string, Date date, AlloyType string, FurnaceTag string, ManganeseOre_kg double, Coke_kg double, "
    "Quartz_kg double, FeScrap_kg double, Flux_CaO_kg double, Energy_kWh double, TapWeight_tons double, "
    "Mn_content_pct_Target double, Si_content_pct_Target double, C_content_pct_Target double, Operator string"
)
LAB = (
    "LabAnalysisID string, AnalysisDate date, ProductionBatchID string, Mn_pct double, Si_pct double, C_pct double, "
    "P_pct double, S_pct double, Fe_pct double, Analyst string"
)
INVENTORY = (
    "file_path string, plant_code string, category string, file_format string, description string, date_range string, "
    "equipment_tags array<string>, linked_ids map<string,array<string>>"
)
PLANTS = (
    "code string, name string, location string, areas map<string,string>, facilities struct<eaf_count:int, "
    "refinery:boolean, crushing_plant:boolean, water_gas_cleaning:boolean, heat_recovery:boolean, other_equipment:array<string>>"
)
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array of records. A malformed file fails the job."""
    return (
        spark.read.schema(schema).option("multiLine", True).option("timestampFormat", TIME_FORMAT)
        .option("mode", "FAILFAST").json(path)
    )


def read_alarms(spark: SparkSession, path: str) -> DataFrame:
    return read_json_records(spark, path, ALARMS)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The metadata inventory as a JSON array, or as our own sorted records, one per line.

    Its schema is given because inference would turn the link map into a struct.
    """
    whole = spark.read.text(path).where(F.col("value").rlike(r"^\s*\[")).isEmpty()
    if whole:
        return spark.read.schema(INVENTORY).option("mode", "FAILFAST").json(path)
    return read_json_records(spark, path, INVENTORY)


def write_inventory(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per line, sorted by file path over all part files."""
    df.orderBy("file_path").write.mode(mode).json(path)


def read_csv_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("timestampFormat", TIME_FORMAT).csv(path)


def areas(plants: DataFrame) -> DataFrame:
    """(plant, area, area_name): the plant dimension with one row per area."""
    return plants.select(F.col("code").alias("plant"), F.explode("areas").alias("area", "area_name"))
