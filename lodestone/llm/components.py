"""Connected components of a distributed graph by alternating stars.

Every step is an aggregate that combines in the map tasks and a join whose other side
has one row a key, so a vertex with a third of all edges is split by adaptive execution.
Each round is cut with a checkpoint; none follows the one that leaves only stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, drop_cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (u > v): all larger (or smaller) neighbours go to the least one."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _tangled(edges: DataFrame) -> bool:
    """Whether edges (u > v) are not yet stars around their least nodes: a u with two edges, or a v that is a u too."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").count() > 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for all ends of ``edges`` (a, b); component: the smallest node.

    Null ends and loops are ignored; repeated edges count once."""
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if not _tangled(e):
            break
        before, e = e, cut(_star(_star(e, False), True))
        drop_cut(before)
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
