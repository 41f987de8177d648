"""Alignment of texts line by line, for all pairs of texts at once, and three-way regions.

Two versions of a text (rows key, pos, h: a line's digest) are aligned as patience does:
lines that occur once in both are joined by equality, the longest rising chain of these
pairs anchors the texts, and in each gap between anchors the equal lines at its start and
at its end are added, by joins on the distance from the gap's ends. Only the chain is
found by a helper, over the anchors of one key.

Three versions (old, new, own) are cut at the old lines that are aligned in both others. What
lies between two cuts is a region: lines of each version, compared as sequences.

Each step that several later ones read is cut with a checkpoint, so nothing is parsed or joined twice.

Edge cases: an empty or null text has no lines; two empty texts have no regions; keys that
a version lacks have no lines there; repeated lines are aligned by their place in a gap.
"""

from __future__ import annotations

import bisect
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.lineage import cut


def lines_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos (0-based, blank lines not counted), no (1-based line of the text) and h, the digest of the trimmed line."""
    each = df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)).alias("no", "line"))
    each = each.withColumn("line", F.regexp_replace(F.trim("line", F.lit(" \t\r")), r"\s+", " ")).where("line <> ''")
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("no")) - 1
    return each.select(*keys, pos.alias("pos"), (F.col("no") + 1).alias("no"), F.xxhash64("line").alias("h"), "line")


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that rises on both sides; ``pairs`` are sorted by the first and have no side twice."""
    ends: list[int] = []  # least last value of chains by length
    at: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect.bisect_left(ends, b)
        before.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(b)
            at.append(i)
        else:
            ends[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _chain(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """The anchors (keys, la, lb) of each key's longest rising chain."""
    grouped = anchors.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("la", "lb"))).alias("pairs"))

    def run(batches):
        for batch in batches:
            take, la, lb = [], [], []
            for i, pairs in enumerate(batch.column(len(keys)).to_pylist()):
                for a, b in rising([(p["la"], p["lb"]) for p in pairs]):
                    take.append(i), la.append(a), lb.append(b)
            picked = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(picked) for k in range(len(keys))), pa.array(la, pa.int32()), pa.array(lb, pa.int32())], [*keys, "la", "lb"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.select(*keys).schema.fields) + ", la int, lb int"
    return grouped.mapInArrow(run, schema)


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, la, lb): positions of aligned lines of ``left`` and ``right`` (keys, pos, h)."""
    single = lambda df, name: df.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias(name)).where("n = 1").drop("n")
    chain = cut(_chain(single(left, "la").join(single(right, "lb"), [*keys, "h"]).drop("h"), keys))
    size = lambda df, name: df.groupBy(*keys).agg((F.max("pos") + 1).alias(name))
    whole = size(left, "la").join(size(right, "lb"), keys)  # keys that both have
    marks = chain.unionByName(whole.select(*keys, F.lit(-1).alias("la"), F.lit(-1).alias("lb"))).unionByName(whole.select(*keys, "la", "lb"))
    w = Window.partitionBy(*keys).orderBy("la")
    gaps = marks.select(*keys, F.row_number().over(w).alias("gap"), (F.col("la") + 1).alias("a0"), (F.col("lb") + 1).alias("b0"), F.lead("la").over(w).alias("a1"), F.lead("lb").over(w).alias("b1"))
    gaps = cut(gaps.where("a1 is not null").withColumn("most", F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0"))).where("most > 0"))

    def inside(df: DataFrame, start: str, end: str, pos: str, h: str) -> DataFrame:
        g = gaps.select(*keys, "gap", "most", F.explode(F.sequence(F.col(start), F.col(end) - 1)).alias("pos"), F.col(start).alias("s"), F.col(end).alias("e"))
        own = df.select(*keys, "pos", F.col("h").alias(h)).join(g, [*keys, "pos"])
        return own.select(*keys, "gap", "most", F.col("pos").alias(pos), h, (F.col("pos") - F.col("s")).alias("down"), (F.col("e") - 1 - F.col("pos")).alias("up"))

    a, b = inside(left, "a0", "a1", "la", "ha"), inside(right, "b0", "b1", "lb", "hb")

    def run_of(by: str) -> DataFrame:
        """Pairs at the same distance from an end of their gap, up to the first that differs."""
        both = a.select(*keys, "gap", "most", by, "la", "ha").join(b.select(*keys, "gap", by, "lb", "hb"), [*keys, "gap", by])
        stop = F.min(F.when(F.col("ha") != F.col("hb"), F.col(by))).over(Window.partitionBy(*keys, "gap"))
        return both.withColumn("stop", F.coalesce(stop, F.col("most"))).where(F.col(by) < F.col("stop"))

    first = cut(run_of("down"))
    taken = first.groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("taken"))
    last = run_of("up").join(taken, [*keys, "gap"], "left").where(F.col("up") < F.col("most") - F.coalesce("taken", F.lit(0)))
    return reduce(DataFrame.unionByName, [chain, first.select(*keys, "la", "lb"), last.select(*keys, "la", "lb")])


def _regions_of(df: DataFrame, cuts: DataFrame, keys: list[str], side: str) -> DataFrame:
    """keys, region, and the side's lines in it: first and last line number, count and digests in order."""
    marked = df.join(cuts.select(*keys, F.col(side).alias("pos"), F.lit(1).alias("cut")), [*keys, "pos"], "left")
    w = Window.partitionBy(*keys).orderBy("pos")
    placed = marked.withColumn("region", F.sum(F.coalesce("cut", F.lit(0))).over(w)).where("cut is null")
    hs = F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"])
    return placed.groupBy(*keys, "region").agg(F.min("no").alias(f"{side}_from"), F.max("no").alias(f"{side}_to"), F.count(F.lit(1)).alias(f"n_{side}"), hs.alias(f"{side}_hs"))


def state_of(old: Column, new: Column, own: Column) -> Column:
    """What became of a region's old lines in the new release and in the own text."""
    return (F.when((new == old) & (own == old), "unchanged").when(new == old, "own").when(new == own, "same")
        .when((own == old) & (F.size(new) == 0), "missing").when(own == old, "changed").otherwise("conflicting"))


def three_way(old: DataFrame, new: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """Regions in which three versions (keys, pos, no, h) are not all the same: keys, region, state, line
    ranges and counts of each.

    States: own (only the own text differs), changed (only the release), missing (the release
    dropped the lines), same (both differ alike), conflicting."""
    old, new, own = (cut(df.select(*keys, "pos", "no", "h")) for df in (old, new, own))
    to_new = align(old, new, keys).select(*keys, F.col("la").alias("old"), F.col("lb").alias("new"))
    to_own = align(old, own, keys).select(*keys, F.col("la").alias("old"), F.col("lb").alias("own"))
    cuts = cut(to_new.join(to_own, [*keys, "old"]))
    sides = [_regions_of(df, cuts, keys, name) for df, name in ((old, "old"), (new, "new"), (own, "own"))]
    both = reduce(lambda x, y: x.join(y, [*keys, "region"], "full"), sides)
    empty = F.array().cast("array<bigint>")
    both = both.withColumns({f"{n}_hs": F.coalesce(f"{n}_hs", empty) for n in ("old", "new", "own")} | {f"n_{n}": F.coalesce(f"n_{n}", F.lit(0)) for n in ("old", "new", "own")})
    state = state_of(F.col("old_hs"), F.col("new_hs"), F.col("own_hs"))
    return both.withColumn("state", state).where("state <> 'unchanged'").select(*keys, "region", "state", *(f"{n}_{e}" for n in ("old", "new", "own") for e in ("from", "to")), "n_old", "n_new", "n_own")


#: Marks of what an extension inserts into, and deletes from, the method that it controls.
INSERT, DELETE, END_INSERT, END_DELETE = r"(?iu)^\s*#вставка\s*$", r"(?iu)^\s*#удаление\s*$", r"(?iu)^\s*#конецвставки\s*$", r"(?iu)^\s*#конецудаления\s*$"


def marked_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (of `lines_of`) with ``mark``: inserted, deleted or kept, without the marks' own lines."""
    line = F.col("line")
    turn = F.when(line.rlike(INSERT), "inserted").when(line.rlike(DELETE), "deleted").when(line.rlike(END_INSERT) | line.rlike(END_DELETE), "kept")
    now = F.last("turn", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("pos"))
    return df.withColumn("turn", turn).withColumn("mark", F.coalesce(now, F.lit("kept"))).where("turn is null").drop("turn")


def renumbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with dense positions again."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1)
