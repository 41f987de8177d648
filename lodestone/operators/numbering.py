"""Dense numbers in a total order without a task that sees all rows.

Rows are sorted into range partitions and cut (a second scan must meet the same partitions,
also after a lost executor); each partition counts its rows, the counts before it are
summed over one row a partition, and a row's number is that sum and its place in its own
partition. The numbers are those of `row_number()` over the same order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.lineage import cut

_PLACE = (1 << 33) - 1  # monotonically_increasing_id: partition above 33 bits of place


def number(df: DataFrame, order: list, name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name``: first, first + 1, ... in ``order``, which must be total for the numbers to be the same each time."""
    at = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumn("__part", F.shiftright("__at", 33)).withColumn("__place", F.col("__at").bitwiseAND(F.lit(_PLACE)))
    counts = at.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    return at.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__place") + first).drop("__at", "__part", "__place", "__before")
