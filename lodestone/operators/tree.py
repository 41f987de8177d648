"""Hierarchies: subtree in display order, ancestors, buckets, ordinals, nearest parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.errors import DataError

SHALLOW, DEEPEST = 16, 200  # levels climbed without asking whether there are more, and at most


def subtree(nodes: DataFrame, roots: Column, depth: int, node: str = "id", parent: str = "parent_id", order: str = "ord", name: str = "name") -> DataFrame:
    """Pre-order listing below the rows where ``roots`` holds: level, sort_key and the node.

    One join per level, at most ``depth`` levels; sort_key is the concatenation of the
    ancestors' zero-padded ordinals and keys, so ordering by it is the display order."""
    def wide(column: Column, width: int) -> Column:
        """The number in ``width`` digits; a longer one in 20 behind a mark that sorts last."""
        digits = column.cast("string")
        return F.when(F.length(digits) > width, F.concat(F.lit("~"), F.lpad(digits, 20, "0"))).otherwise(F.lpad(digits, width, "0"))

    piece = lambda: F.concat(wide(F.coalesce(F.col(order), F.lit(99999999)), 8), wide(F.col(node), 12))
    cols = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(name).alias("name"), piece().alias("piece"))
    level = nodes.where(roots).select(F.col(node).alias("node"), F.col(name).alias("name"), piece().alias("sort_key")).withColumn("level", F.lit(0))
    out = level
    for k in range(1, depth + 1):
        up = level.select(F.col("node").alias("parent"), F.col("sort_key").alias("above"))
        level = cols.join(up, "parent").select("node", "name", F.concat("above", "piece").alias("sort_key"), F.lit(k).alias("level"))
        out = out.unionByName(level)
    return out


def ancestors(nodes: DataFrame, start: Column, node: str = "id", parent: str = "parent_id", name: str = "name", most: int | None = None) -> DataFrame:
    """The chain from the starting nodes to their roots: start, steps, node, name.

    ``most``: levels to climb; without it all of them, and a chain without an end is an error."""
    base = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.col(name).alias("name"))
    at = nodes.where(start).select(F.col(node).alias("start"), F.lit(0).alias("steps"), F.col(node).alias("node"), F.col(name).alias("name"), F.col(parent).alias("up"))
    out = at
    for k in range(1, (DEEPEST if most is None else most) + 1):
        if most is None and k > SHALLOW and at.where("up is not null").isEmpty():  # few hierarchies are deeper; those pay for the question
            return out.drop("up")
        prior = at.where("up is not null").select("start", F.col("up").alias("node"))
        at = prior.join(base, "node").select("start", F.lit(k).alias("steps"), "node", "name", "up")
        out = out.unionByName(at)
    if most is None:
        raise DataError(f"a chain of parents has more than {DEEPEST} levels")
    return out.drop("up")


def nearest_parent(paths: DataFrame, path: str = "path", key: str = "id", sep: str = "/") -> DataFrame:
    """The row whose path is the longest proper prefix (whole segments) of each row's path.

    Every row names its ancestors' paths (as many as it has segments), which join by
    equality; the longest match wins."""
    parts = F.split(F.col(path), sep)
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    mine = paths.where(F.col(path) != "").select(F.col(key), F.explode(ups).alias("up"))
    other = paths.select(F.col(path).alias("up"), F.col(key).alias("parent_id"))
    return mine.join(other, "up").groupBy(key).agg(F.max_by("parent_id", F.length("up")).alias("parent_id"))


def first_position(df: DataFrame, group: str, items: Column) -> DataFrame:
    """Each distinct item of a row's list with its first position."""
    return df.select(group, F.posexplode(items).alias("pos", "item")).groupBy(group, "item").agg(F.min("pos").alias("ord"))


def ordinal(df: DataFrame, by: list[str], order: list, name: str = "ord") -> DataFrame:
    """A dense 0-based ordinal per group."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def bucket_of(type_col) -> Column:
    """Children's buckets by the end of their type."""
    return (F.when(F.endswith(type_col, F.lit("Form")), "form").when(F.endswith(type_col, F.lit("Command")), "command")
            .when(F.endswith(type_col, F.lit("Template")), "template").otherwise("other"))
