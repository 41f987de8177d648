"""Reference graphs: neighbours and bounded breadth-first search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def neighbours(edges: DataFrame, start: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Distinct (start, neighbour) pairs; ``start`` has the column ``node``."""
    return edges.join(start.select(F.col("node").alias(source)), source).select(F.col(source).alias("node"), F.col(target).alias("neighbour")).distinct()


def bfs(edges: DataFrame, start: DataFrame, depth: int, source: str = "src", target: str = "dst") -> DataFrame:
    """(node, depth): the least number of steps to every node within ``depth`` steps.

    A bounded loop: each step joins the frontier and removes what was seen, and ends early when
    nothing is left. Frontier and edges are both shuffled by key; nothing is collected. From the
    third step on, what was seen is cut in the shared checkpoint folder (where one is set)."""
    cuts = edges.sparkSession.sparkContext.getCheckpointDir() is not None
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null").distinct()
    frontier = start.select("node").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for k in range(1, depth + 1):
        step = frontier.join(e, F.col("node") == F.col("s")).select(F.col("t").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(frontier)
        if cuts and k > 2 and k < depth:
            seen = seen.checkpoint()
            frontier = seen.where(F.col("depth") == k)
            if frontier.isEmpty():
                break
    return seen
