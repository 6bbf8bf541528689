"""Plant tables as views over the given tables, in Spark and as the same SQL text for comparison.

error = alarm, purchase = downtime, signup = work order, view = incident; user = equipment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantlake.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def busy_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table for work that is heavy per row: spread over all cores when it comes in one piece."""
    return spread(table(spark, folder, name).select(*columns))


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def rounded(c: str | Column, digits: int = 4) -> Column:
    """Rounded for comparison, and never minus zero.

    The tiny shift keeps exact halves off the rounding border, where two engines may part.
    """
    value = F.col(c) if isinstance(c, str) else c
    return F.round(value + F.lit(3e-9), digits) + F.lit(0.0)


def pick(no: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (no % len(values) + 1).cast("int"))


def pick_sql(no: str, values: list[str]) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[({no}) % {len(values)} + 1]"


PLANT_CODES = ["PLA", "PLB", "PLC"]
PRIORITIES = ["Low", "Medium", "High", "Critical"]
# fixed values among them: words that operators look for
REASONS = ["worn part", "Planned Maintenance", "Equipment Failure", "power dip", "Unplanned Maintenance", "crew change", "Safety Stop"]
MAINTENANCE = ["inspect", "Corrective", "Breakdown", "lubricate", "calibrate"]
INCIDENTS = ["trip hazard", "hot metal splash", "dropped load", "gas smell", "blocked exit"]
# fixed values: severities, two of which the cause operators count as serious
SEVERITIES = ["Minor", "Moderate", "Serious", "Major"]
AREAS = ["RMH", "SMT", "REF", "CST"]


def _id(prefix: str, back: int = 0) -> Column:
    number = F.lpad(F.hex(F.col("event_id") - back), 8, "0")
    return F.concat(F.lit(prefix + "-"), F.col("plant"), F.lit("-"), number)


def _id_sql(prefix: str, back: int = 0) -> str:
    return f"('{prefix}-' || plant || '-' || lpad(printf('%X', event_id - {back}), 8, '0'))"


def plant_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the number in their properties, the plant and the equipment tag."""
    plant = pick(F.col("user_id"), PLANT_CODES)
    return table(spark, folder, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("long")
    ).withColumn("plant", plant).withColumn(
        "tag", F.concat("plant", F.lit("-"), pick(F.col("user_id"), AREAS), F.lit("-EAF"), F.col("user_id").cast("string"))
    )


PLANT_EVENTS_SQL = f"""pe0 AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, {pick_sql('user_id', PLANT_CODES)} AS plant FROM events),
pe AS (SELECT *, plant || '-' || {pick_sql('user_id', AREAS)} || '-EAF' || user_id AS tag FROM pe0)"""


def alarms(spark: SparkSession, folder: str) -> DataFrame:
    e = plant_events(spark, folder).where(F.col("event_type") == "error")
    return e.select(
        "plant", _id("ALM").alias("AlarmID"), F.col("ts").alias("Timestamp"), F.col("tag").alias("EquipmentTag"),
        F.lit("Process").alias("AlarmType"), pick(F.col("k"), PRIORITIES).alias("Priority"),
        F.concat(F.lit("value "), F.col("value").cast("string")).alias("Message"),
        (F.col("k") % 3 == 0).alias("Acknowledged"), (F.col("k") % 5 == 0).alias("Resolved"),
        F.lit(None).cast("string").alias("TriggeredDowntimeID"), F.lit(None).cast("string").alias("TriggeredMaintenanceID"),
    )


ALARMS_SQL = f"""alarms AS (SELECT plant, {_id_sql('ALM')} AS AlarmID, ts AS Timestamp, tag AS EquipmentTag,
  {pick_sql('k', PRIORITIES)} AS Priority, k % 3 = 0 AS Acknowledged, k % 5 = 0 AS Resolved FROM pe WHERE event_type = 'error')"""


def downtime(spark: SparkSession, folder: str) -> DataFrame:
    e = plant_events(spark, folder).where(F.col("event_type") == "purchase")
    return e.select(
        "plant", _id("DWT").alias("DowntimeID"), F.col("tag").alias("EquipmentTag"), F.col("ts").alias("StartTime"),
        F.col("value").alias("DurationHours"), pick(F.col("k"), REASONS).alias("Reason"),
        F.when(F.col("k") % 3 == 0, _id("ALM", 1)).alias("TriggeringAlarmID"),
        F.when(F.col("k") % 4 == 0, _id("MWO", 1)).alias("RelatedMWO_ID"),
    )


DOWNTIME_SQL = f"""downtime AS (SELECT plant, {_id_sql('DWT')} AS DowntimeID, tag AS EquipmentTag, ts AS StartTime,
  value AS DurationHours, {pick_sql('k', REASONS)} AS Reason,
  CASE WHEN k % 3 = 0 THEN {_id_sql('ALM', 1)} END AS TriggeringAlarmID,
  CASE WHEN k % 4 = 0 THEN {_id_sql('MWO', 1)} END AS RelatedMWO_ID FROM pe WHERE event_type = 'purchase')"""


def work_orders(spark: SparkSession, folder: str) -> DataFrame:
    e = plant_events(spark, folder).where(F.col("event_type") == "signup")
    return e.select(
        "plant", _id("MWO").alias("MWO_ID"), F.col("ts").cast("date").alias("Date"), F.col("tag").alias("EquipmentTag"),
        pick(F.col("k"), MAINTENANCE).alias("MaintenanceType"), F.round(F.col("value") * 20, 2).alias("Cost"),
        F.when(F.col("k") % 2 == 0, _id("ALM", 1)).alias("TriggeringAlarmID"),
        F.when(F.col("k") % 4 == 1, _id("DWT", 1)).alias("RelatedDowntimeID"),
    )


WORK_ORDERS_SQL = f"""work_orders AS (SELECT plant, {_id_sql('MWO')} AS MWO_ID, CAST(ts AS DATE) AS Date, tag AS EquipmentTag,
  {pick_sql('k', MAINTENANCE)} AS MaintenanceType, round(value * 20, 2) AS Cost,
  CASE WHEN k % 2 = 0 THEN {_id_sql('ALM', 1)} END AS TriggeringAlarmID,
  CASE WHEN k % 4 = 1 THEN {_id_sql('DWT', 1)} END AS RelatedDowntimeID FROM pe WHERE event_type = 'signup')"""


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    e = plant_events(spark, folder).where(F.col("event_type") == "view")
    actions = F.concat(
        F.array(F.lit("Area inspected.")),
        F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("Maintenance requested (Ref "), _id("MWO", 1), F.lit(")."))))
        .otherwise(F.array().cast("array<string>")),
        F.when(F.col("k") % 4 >= 2, F.array(F.concat(F.lit("RCA initiated (Ref "), _id("RCA"), F.lit(")."))))
        .otherwise(F.array().cast("array<string>")),
    )
    return e.select(
        "plant", _id("INC").alias("incident_id"), "ts", F.element_at(F.split("tag", "-"), 2).alias("area"),
        F.col("tag").alias("equipment"), pick(F.col("k"), INCIDENTS).alias("type"), pick(F.col("k"), SEVERITIES).alias("severity"),
        actions.alias("actions"),
    )


INCIDENTS_SQL = f"""incidents AS (SELECT plant, {_id_sql('INC')} AS incident_id, ts, string_split(tag, '-')[2] AS area,
  tag AS equipment, {pick_sql('k', INCIDENTS)} AS type, {pick_sql('k', SEVERITIES)} AS severity,
  CASE WHEN k % 2 = 0 THEN {_id_sql('MWO', 1)} END AS mwo, CASE WHEN k % 4 >= 2 THEN {_id_sql('RCA')} END AS rca
  FROM pe WHERE event_type = 'view')"""


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """One record per incident report, linked to the ids its actions name."""
    i = incidents(spark, folder)
    mwo = F.regexp_extract_all(F.array_join("actions", " "), F.lit(r"(MWO-[A-Z]{3}-[0-9A-F]{8})"), 1)
    rca = F.regexp_extract_all(F.array_join("actions", " "), F.lit(r"(RCA-[A-Z]{3}-[0-9A-F]{8})"), 1)
    links = F.create_map(F.lit("MWO_ID"), mwo, F.lit("RCA_ID"), rca)
    return i.select(
        F.concat("plant", F.lit("/Safety_Data/"), "incident_id", F.lit("_SafetyIncidentReport.docx")).alias("file_path"),
        F.col("plant").alias("plant_code"), F.lit("Safety_Data").alias("category"), F.lit("DOCX").alias("file_format"),
        F.format_string("Safety Incident Report for %s (%s).", "type", "severity").alias("description"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_range"), F.array("equipment").alias("equipment_tags"),
        F.map_filter(links, lambda k, v: F.size(v) > 0).alias("linked_ids"),
    )


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """One batch per order, its plant the customer's region."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    # nation and region have a fixed number of rows
    place = F.broadcast(table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    return o.join(c, o.o_custkey == c.c_custkey).join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("plant"), F.col("o_orderkey").alias("BatchID"), F.col("o_orderdate").cast("date").alias("Date"),
        F.col("o_orderpriority").alias("AlloyType"), F.col("o_totalprice").alias("Energy_kWh"),
        (F.col("o_orderkey") % 40).cast("double").alias("TapWeight_tons"),
        (F.col("o_custkey") % 50).cast("double").alias("Mn_content_pct_Target"),
        (F.col("o_custkey") % 10).cast("double").alias("Si_content_pct_Target"),
        (F.col("o_custkey") % 8).cast("double").alias("C_content_pct_Target"),
    )


BATCHES_SQL = """batches AS (SELECT r_name AS plant, o_orderkey AS BatchID, CAST(o_orderdate AS DATE) AS Date,
  o_orderpriority AS AlloyType, o_totalprice AS Energy_kWh, CAST(o_orderkey % 40 AS DOUBLE) AS TapWeight_tons,
  CAST(o_custkey % 50 AS DOUBLE) AS mn, CAST(o_custkey % 10 AS DOUBLE) AS si, CAST(o_custkey % 8 AS DOUBLE) AS c
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def lab(spark: SparkSession, folder: str) -> DataFrame:
    """One lab result per order line; every line on the other side of the key range has no batch."""
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")).alias("ProductionBatchID"),
        F.col("l_partkey").alias("part"), F.col("l_quantity").alias("Mn_pct"),
        (F.col("l_discount") * 100).alias("Si_pct"), (F.col("l_tax") * 100).alias("C_pct"),
    )


LAB_SQL = """lab AS (SELECT CASE WHEN l_linenumber = 7 THEN -l_orderkey - 1 ELSE l_orderkey END AS ProductionBatchID,
  l_partkey AS part, l_quantity AS mn_pct, l_discount * 100 AS si_pct, l_tax * 100 AS c_pct FROM lineitem)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


EVENT_VIEWS_SQL = with_sql(PLANT_EVENTS_SQL, ALARMS_SQL, DOWNTIME_SQL, WORK_ORDERS_SQL, INCIDENTS_SQL)
