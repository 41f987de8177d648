"""Links between objects that headers hold as uuids: common attributes, subsystems, order.

The uuids of each header are exploded once, in first-seen order; everything else joins
them to the objects' own uuids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the form of a uuid.
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def header_uuids(objects: DataFrame) -> DataFrame:
    """id, pos, uuid: the distinct uuids of each header with their first position; only whole values count."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("header_json", F.lit(f'"({UUID})"'), F.lit(1)), lambda u: F.lower(u)))
    return objects.select("id", F.posexplode(found).alias("pos", "uuid"))


def _targets(objects: DataFrame, kind: str) -> DataFrame:
    """id, pos, target_id: known objects, other than itself, in the headers of one type."""
    known = objects.where("uuid is not null").select(F.lower("uuid").alias("uuid"), F.col("id").alias("target_id"))
    return header_uuids(objects.where(F.col("type") == kind)).join(known, "uuid").where("id <> target_id").select("id", "pos", "target_id")


def common_targets(objects: DataFrame) -> DataFrame:
    """common_id, target_id: what common attributes are bound to."""
    return _targets(objects, "CommonAttribute").select(F.col("id").alias("common_id"), "target_id").distinct()


def subsystem_content(objects: DataFrame) -> DataFrame:
    """subsystem_id, target_id, ord: members in first-seen order, without itself and its parent."""
    parents = objects.select("id", "parent_id")
    rows = _targets(objects, "Subsystem").join(parents, "id").where(~F.col("target_id").eqNullSafe(F.col("parent_id")))
    first = rows.groupBy("id", "target_id").agg(F.min("pos").alias("pos"))
    ordinal = (F.row_number().over(Window.partitionBy("id").orderBy("pos", "target_id")) - 1).cast("int")
    return first.select(F.col("id").alias("subsystem_id"), "target_id", ordinal.alias("ord"))


def sibling_order(objects: DataFrame) -> DataFrame:
    """id, ord: where an object's uuid first stands in its parent's header; null if it does not."""
    places = header_uuids(objects).select(F.col("id").alias("parent_id"), "uuid", F.col("pos").alias("ord"))
    own = objects.select("id", "parent_id", F.lower("uuid").alias("uuid"))
    return own.join(places, ["parent_id", "uuid"], "left").select("id", F.col("ord").cast("int").alias("ord"))


def resolve_kinds(subconto: DataFrame, predefined: DataFrame) -> DataFrame:
    """The second pass over sub-kinds: kind_id of the predefined item a uuid names, null without one."""
    kinds = predefined.where("uuid is not null").groupBy(F.lower("uuid").alias("__uuid")).agg(F.min("id").alias("kind_id"))
    return subconto.drop("kind_id").join(kinds, F.lower(subconto["uuid"]) == F.col("__uuid"), "left").drop("__uuid")
