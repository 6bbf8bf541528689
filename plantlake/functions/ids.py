"""Parsing of equipment tags, sensor tags and entity ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: entity kind by id prefix
KINDS = {
    "ALM": "alarm", "DWT": "downtime", "MWO": "work order", "BCH": "batch",
    "LAB": "lab analysis", "INC": "incident", "RCA": "root cause", "SOP": "procedure",
}
# fixed values: entity kind by the names used in inventory links
LINK_NAMES = {
    "AlarmID": "alarm", "ActiveAlarmID": "alarm", "DowntimeID": "downtime", "MWO_ID": "work order",
    "BatchID": "batch", "ProductionBatchID": "batch", "IncidentID": "incident", "RCA_ID": "root cause",
}
ENTITY_ID = r"((?:ALM|DWT|MWO|BCH|INC|RCA)-[A-Z]{3}-[0-9A-F]{8})"


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[key]


def part(text: Column, no: int) -> Column:
    """The no-th piece between dashes (negative counts from the end), null when there is none."""
    return F.try_element_at(F.split(text, "-"), F.lit(no))


def prefix(entity_id: Column) -> Column:
    return part(entity_id, 1)


def short_id(entity_id: Column) -> Column:
    return part(entity_id, -1)


def id_plant(entity_id: Column) -> Column:
    return part(entity_id, 2)


def entity_kind(entity_id: Column) -> Column:
    return _lookup(prefix(entity_id), KINDS)


def link_kind(name: Column) -> Column:
    return _lookup(name, LINK_NAMES)


def of_plant(entity_id: Column, plant: Column) -> Column:
    """True when the id carries ``-<plant>-``."""
    return F.contains(entity_id, F.concat(F.lit("-"), plant, F.lit("-")))


def ids_in_text(text: Column) -> Column:
    """All entity ids written in a text, in order."""
    return F.regexp_extract_all(text, F.lit(ENTITY_ID), 1)


def tag_parts(tag: Column) -> Column:
    """Struct of plant, area, equipment, equipment type and number, measure, instance of a tag."""
    return F.struct(
        part(tag, 1).alias("plant"),
        part(tag, 2).alias("area"),
        F.concat_ws("-", part(tag, 1), part(tag, 2), part(tag, 3)).alias("equipment"),
        F.regexp_extract(part(tag, 3), r"^(.*?)\d*$", 1).alias("equipment_type"),
        F.nullif(F.regexp_extract(part(tag, 3), r"(\d+)$", 1), F.lit("")).try_cast("int").alias("equipment_no"),
        part(tag, 4).alias("measure"),
        part(tag, 5).try_cast("int").alias("instance"),
    )
