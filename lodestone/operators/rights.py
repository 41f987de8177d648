"""Access-rights analytics on sparse (role, target, right, value) rows.

No row means "not set", never "denied". Keys have nullable parts, so joins are null-safe;
the parts that make up a target's key are named by the caller, as operations differ in
whether flags belong to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RLS_WIDTH = 600


def null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def targets(rights: DataFrame, key: list[str], resolved: str | None = None) -> DataFrame:
    """A role's targets: one row per key with its number of rights (and whether it is resolved)."""
    extra = [F.max(F.col(resolved).isNotNull().cast("int")).alias("resolved")] if resolved else []
    return rights.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rights"), *extra)


def target_stats(rights: DataFrame, key: list[str], resolved: str, rls: str) -> DataFrame:
    """One row: targets, resolved, unresolved, rights, with_rls, long_rls."""
    per = rights.groupBy(*key).agg(F.max(F.col(resolved).isNotNull().cast("int")).alias("ok"), F.count(F.lit(1)).alias("n"),
                                   F.count_if(F.col(rls).isNotNull()).alias("r"), F.count_if(F.length(rls) > RLS_WIDTH).alias("long"))
    return per.agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("ok") == 1).alias("resolved"), F.count_if(F.col("ok") == 0).alias("unresolved"),
                   F.coalesce(F.sum("n"), F.lit(0)).alias("rights"), F.coalesce(F.sum("r"), F.lit(0)).alias("with_rls"), F.coalesce(F.sum("long"), F.lit(0)).alias("long_rls"))


def effective(rights: DataFrame, key: list[str], role: str = "role") -> DataFrame:
    """The union over roles: one row per key with the sorted distinct roles that grant it."""
    return rights.groupBy(*key).agg(F.sort_array(F.collect_set(role)).alias("roles"))


def role_diff(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Every key of either side with ``side``: only_a, only_b or common."""
    both = left.select(*key).withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(
        right.select(*key).withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))  # grouping treats nulls as equal
    return both.groupBy(*key).agg(F.max("a").alias("a"), F.max("b").alias("b")).select(
        *key, F.when((F.col("a") == 1) & (F.col("b") == 1), "common").when(F.col("a") == 1, "only_a").otherwise("only_b").alias("side"))


def lost_targets(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys that the roles before have and those after lack."""
    return role_diff(before, after, key).where("side = 'only_a'").drop("side")


def targets_per_role(rights: DataFrame, role: str, order: list, most: int = 12) -> DataFrame:
    """At most ``most`` targets per role, with the role's total."""
    w = Window.partitionBy(role)
    return rights.withColumn("n_targets", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def ambiguous(rights: DataFrame, key: list[str], flags: str) -> DataFrame:
    """Keys that occur with several flags (null counts as one)."""
    return rights.groupBy(*key).agg(F.count_distinct(F.coalesce(F.col(flags).cast("string"), F.lit("-"))).alias("n_flags")).where("n_flags > 1")


def label(attr, section, obj, marker, sub, flags=None) -> Column:
    """A target's text: attribute, section, object, marker, sub-object, else unresolved."""
    text = (F.when(attr.isNotNull(), F.concat_ws(".", obj, section, attr)).when(section.isNotNull(), F.concat_ws(".", obj, section))
            .when(obj.isNotNull(), obj).when(marker.isNotNull(), F.concat(F.lit("marker "), marker))
            .when(sub.isNotNull(), F.concat(F.lit("sub-object "), sub)).otherwise(F.lit("unresolved")))
    return F.concat_ws(" ", text, F.concat(F.lit("["), flags, F.lit("]"))) if flags is not None else text


def short_text(text, width: int = RLS_WIDTH) -> Column:
    """White space collapsed, cut at ``width`` with a mark."""
    one = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(one) > width, F.concat(F.left(one, F.lit(width)), F.lit("..."))).otherwise(one)


def state(parsed, rights, unresolved) -> Column:
    """What can be said of a role's rights: sparse rows never mean denial."""
    return (F.when(parsed.isNull(), "absent").when(~parsed, "unavailable").when(rights == 0, "unconfirmed")
            .when(unresolved > 0, "partial").otherwise("interpreted"))


def resolve_target(rights: DataFrame, maps: list[tuple[DataFrame, str]], uuid: str = "target_uuid") -> DataFrame:
    """Adds target_kind and target_id from several uuid maps (uuid, id); later maps win."""
    every = reduce(DataFrame.unionByName, (m.select(F.col("uuid").alias("__uuid"), F.col("id").cast("string").alias("target_id"), F.lit(kind).alias("target_kind"), F.lit(i).alias("__rank")) for i, (m, kind) in enumerate(maps)))
    best = every.groupBy("__uuid").agg(F.max_by(F.struct("target_kind", "target_id"), F.struct("__rank", "target_id")).alias("t"))
    return rights.join(best, rights[uuid] == best["__uuid"], "left").select(rights["*"], F.col("t.target_kind").alias("target_kind"), F.col("t.target_id").alias("target_id"))
