"""Comparison of two snapshots given as long tables of (section, key, fingerprint)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The order of sections and kinds in a report.
SECTIONS = ["attrs", "tabulars", "modules", "methods", "children", "queries", "xdto"]
KINDS = ["only_left", "only_right", "changed"]


def snapshot_diff(left: DataFrame, right: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """keys and kind (only_left, only_right, changed) of all differences.

    A null-safe full outer join, written as a grouping (which treats nulls as equal)."""
    both = left.select(*keys, F.col(fingerprint).alias("l"), F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(None).cast(left.schema[fingerprint].dataType).alias("r")).unionByName(
        right.select(*keys, F.lit(None).cast(right.schema[fingerprint].dataType).alias("l"), F.lit(0).alias("a"), F.lit(1).alias("b"), F.col(fingerprint).alias("r")))
    one = both.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("l").alias("l"), F.max("r").alias("r"))
    kind = F.when(F.col("b") == 0, KINDS[0]).when(F.col("a") == 0, KINDS[1]).when(~F.col("l").eqNullSafe(F.col("r")), KINDS[2])
    return one.withColumn("kind", kind).where("kind is not null").select(*keys, "kind")


def section_order(section) -> Column:
    return F.array_position(F.array(*map(F.lit, SECTIONS)), section)


def kind_order(kind) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def config_diff(left: DataFrame, right: DataFrame, key: str, part: str) -> DataFrame:
    """key, n_left, n_right and kind of the objects whose number of parts differs.

    ``left``/``right``: one row per part; a null part stands for an object without any."""
    count = lambda df, name: df.groupBy(key).agg(F.count(part).alias(name))
    both = count(left, "n_left").join(count(right, "n_right"), key, "full")
    kind = F.when(F.col("n_right").isNull(), KINDS[0]).when(F.col("n_left").isNull(), KINDS[1]).when(F.col("n_left") != F.col("n_right"), KINDS[2])
    return both.withColumn("kind", kind).where("kind is not null")


def split_new(extension: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """The extension's own objects: those the base lacks."""
    return extension.join(base.select(key).distinct(), key, "left_anti")


def split_borrowed(extension: DataFrame, base: DataFrame, key: str) -> DataFrame:
    return extension.join(base.select(key).distinct(), key, "left_semi")


def added_items(extension: DataFrame, base: DataFrame, key: str, item: str) -> DataFrame:
    """Items per object that the base's object lacks, with their number."""
    new = extension.select(key, item).distinct().join(base.select(key, item).distinct(), [key, item], "left_anti")
    return new.groupBy(key).agg(F.count(F.lit(1)).alias("n_added"), F.min(item).alias("first_item"))


def ranked_match(calls: DataFrame, methods: DataFrame, on: list[str], same: str, tie: str) -> DataFrame:
    """Every call with its best method: the least ``tie`` of the same module, else of all; null without any.

    The best of each group is found first, so a call meets at most two methods."""
    best = methods.where(F.col(tie).isNotNull())
    near = best.groupBy(*on, F.col(same)).agg(F.min(tie).alias("__near"))
    far = best.groupBy(*on).agg(F.min(F.struct(F.col(tie).alias("found"), F.col(same).alias("found_in"))).alias("__far"))
    both = calls.join(near, [*on, same], "left").join(far, on, "left")
    return both.select(*calls.columns, F.when(F.col("__near").isNotNull(), F.col(same)).otherwise(F.col("__far.found_in")).alias("found_in"),
                       F.coalesce("__near", "__far.found").alias("found"))


def verdict(**aspects: Column) -> Column:
    """The names of the aspects that changed, in the given order; `unchanged` if none did."""
    text = F.concat_ws(", ", *(F.when(test, F.lit(name)) for name, test in aspects.items()))
    return F.when(text == "", "unchanged").otherwise(text)


def normalized(text) -> Column:
    """Text whose formatting does not count: comments and white space outside of it gone, in SQL terms."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "//[^\n]*", ""), "\\s+", ""))
