"""Pages of a totally ordered result, with totals and notes."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The page sizes of the query interface.
DEFAULT_LIMIT, MOST_LIMIT = 20, 200
REMEMBERED = 128  # totals


def clamp(limit: int | None, default: int = DEFAULT_LIMIT, most: int = MOST_LIMIT) -> int:
    """A page size between 1 and ``most``."""
    return max(1, min(int(default if limit is None else limit), most))


def page(df: DataFrame, order: list, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One page; ``order`` must be total, so that pages neither overlap nor leave gaps."""
    return df.orderBy(*order).offset(max(0, int(offset))).limit(clamp(limit))


def page_note(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One row: total, first and last shown (1-based, 0 past the end), next_offset (null at the end)."""
    size, start = clamp(limit), max(0, int(offset))
    total = F.col("total")
    last = F.least(total, F.lit(start + size).cast("long"))
    inside = total > start
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.when(inside, F.lit(start + 1).cast("long")).otherwise(0).alias("first"), F.when(inside, last).otherwise(0).alias("last"),
        F.when(last < total, last).alias("next_offset"))


class Memo:
    """Totals by key, the last ``most`` used. A key holds the contents that were counted, so a base that changes asks under another one."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.known, self.counted = most, OrderedDict(), 0

    def get(self, key: Hashable, count: Callable[[], int]) -> int:
        if key not in self.known:
            self.known[key] = count()
            self.counted += 1
        self.known.move_to_end(key)
        while len(self.known) > self.most:
            self.known.popitem(last=False)
        return self.known[key]


def noted(spark: SparkSession, total: int, limit: int | None = None, offset: int = 0) -> DataFrame:
    """`page_note` of a known total."""
    size, start = clamp(limit), max(0, int(offset))
    last = min(total, start + size)
    row = (total, start + 1 if total > start else 0, last if total > start else 0, last if last < total else None)
    return spark.createDataFrame([row], "total long, first long, last long, next_offset long")
