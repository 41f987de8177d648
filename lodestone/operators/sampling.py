"""Row numbers and systematic samples without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.search import ranked_first


def row_index(df: DataFrame, key: str, name: str = "i", buckets: int = 64) -> DataFrame:
    """``df`` with the 0-based rank of each row by the numeric ``key`` (unique keys).

    Approximate quantiles (a bounded number, on the driver) cut the keys into buckets;
    rows are numbered inside their bucket and shifted by the counts of the buckets before."""
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), [k / buckets for k in range(1, buckets)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bucket = sum((F.col(key) > F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    rows = df.withColumn("__bucket", bucket)
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    shift = rows.groupBy("__bucket").count().withColumn("__shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(key)) - 1
    return rows.withColumn("__place", place).join(F.broadcast(shift), "__bucket").withColumn(name, F.col("__shift") + F.col("__place")).drop("__bucket", "__shift", "__place")


def systematic_sample(df: DataFrame, key: str, kind: str, size: int) -> DataFrame:
    """Every n/size-th row by ``key``, and the first row of each kind that these lack."""
    n = df.count()
    rows = df.select(key, kind)
    if n <= size:
        return rows
    i = F.col("i")
    picked = row_index(rows, key).where(F.floor(i * size / n) != F.floor((i - 1) * size / n)).select(key, kind)
    first = ranked_first(rows, [kind], [key]).join(picked.select(kind).distinct(), kind, "left_anti").select(key, kind)
    return picked.unionByName(first)
