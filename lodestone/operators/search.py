"""Search predicates and text operators: masks, bodies, lines, windows, n-grams."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters from which a block of n-grams is made at once (or one text): bounds the worker's memory.
BLOCK_CHARS = 1 << 20
#: Keys in a row of postings: readers take thousands of rows at once.
BLOCK_KEYS = 256


def squeezed(column) -> Column:
    """Lower case without blanks: names match whichever way they are written."""
    return F.lower(F.replace(column if isinstance(column, Column) else F.col(column), F.lit(" "), F.lit("")))


def mask(columns: list[str], text: str, literal: bool = True) -> Column:
    """Any of ``columns`` contains ``text``, as it is or with blanks squeezed out.

    With ``literal=False`` the wildcards % and _ keep their meaning. An empty mask
    matches every row."""
    if not text:
        return F.lit(True)
    if literal:
        tests = [F.contains(squeezed(c), squeezed(F.lit(text))) for c in columns]
    else:
        tests = [F.col(c).ilike(f"%{text}%") | squeezed(c).like("%" + text.replace(" ", "").lower() + "%") for c in columns]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def body_has(body, needle) -> Column:
    """Case-insensitive containment; false for nulls."""
    return F.coalesce(F.contains(F.lower(body), F.lower(needle)), F.lit(False))


def of_type(column: str, value: str | None) -> Column:
    return F.lit(True) if not value else F.lower(column) == value.lower()


def lines(df: DataFrame, body: str, keys: list[str], first_line=1) -> DataFrame:
    """One row per line: keys, pos (0-based), line_no and line."""
    start = first_line if isinstance(first_line, Column) else F.lit(first_line)
    return df.select(*keys, start.alias("__start"), F.posexplode(F.split(F.col(body), "\n", -1)).alias("pos", "line")).select(
        *keys, "pos", (F.col("__start") + F.col("pos")).cast("long").alias("line_no"), "line")


def body_hits(df: DataFrame, body: str, keys: list[str], needle: str, per_body: int = 3, width: int = 150) -> DataFrame:
    """The first hits of each body that has ``needle``: keys, hit (1-based), line_no, text.

    Hits are numbered inside the row's own array, so no shuffle is needed."""
    numbered = F.transform(F.split(F.col(body), "\n", -1), lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line")))
    hits = F.slice(F.filter(numbered, lambda x: F.contains(F.lower(x["line"]), F.lower(F.lit(needle)))), 1, per_body)
    return df.where(body_has(F.col(body), F.lit(needle))).select(*keys, F.posexplode(hits).alias("i", "h")).select(
        *keys, (F.col("i") + 1).cast("long").alias("hit"), F.col("h.line_no").alias("line_no"), F.left(F.trim("h.line"), F.lit(width)).alias("text"))


def context_window(df: DataFrame, body: str, keys: list[str], needle: str, before: int = 1, after: int = 1, hits: int = 3) -> DataFrame:
    """Lines around the first hits of a body: keys, hit_line, line_no, line, and the nearest
    statements (lines that are not blank) in front of and behind the hit."""
    all_lines = F.transform(F.split(F.col(body), "\n", -1), lambda x, i: F.struct((i + 1).cast("long").alias("n"), x.alias("line")))
    full = df.where(body_has(F.col(body), F.lit(needle))).select(*keys, all_lines.alias("ls"))
    found = full.select(*keys, "ls", F.explode(F.slice(F.filter("ls", lambda x: F.contains(F.lower(x["line"]), F.lower(F.lit(needle)))), 1, hits)).alias("h"))
    n = F.col("h.n")
    solid = F.filter("ls", lambda x: F.trim(x["line"]) != "")
    return found.select(
        *keys, n.alias("hit_line"),
        F.try_element_at(F.filter(solid, lambda x: x["n"] < n), F.lit(-1))["line"].alias("previous"),
        F.try_element_at(F.filter(solid, lambda x: x["n"] > n), F.lit(1))["line"].alias("following"),
        F.explode(F.filter("ls", lambda x: (x["n"] >= n - before) & (x["n"] <= n + after))).alias("w")).select(
        *keys, "hit_line", "previous", "following", F.col("w.n").alias("line_no"), F.col("w.line").alias("line"))


def snippet(text, needle: str, before: int = 120, after: int = 240) -> Column:
    """The surroundings of the first hit, line ends as blanks."""
    at = F.instr(F.lower(text), needle.lower())
    start = F.greatest(at - before, F.lit(1))
    return F.regexp_replace(F.substring(text, start, at + after - start), "[\r\n]+", " ")


def _inverted(texts: list[str], n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams, offsets, rows): the distinct n-grams of ``texts`` and, between a gram's offset and the next, rows that have it, ascending.
    A gram is repeated for every BLOCK_KEYS rows."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    at = np.flatnonzero(row[: max(len(row) - n + 1, 0)] == row[n - 1 :])  # where n characters of one text begin
    name = codes[at]
    for k in range(1, n):
        if len(name) and int(name.max()) >> 42:  # a character has 21 bits, and three fill a name
            name = np.unique(name, return_inverse=True)[1].astype(np.int64)
        name = name << 21 | codes[at + k]
    order = np.argsort(name, kind="stable")
    at, name = at[order], name[order]
    rows = row[at]
    first = np.ones(len(name), dtype=bool)
    first[1:] = name[1:] != name[:-1]
    once = first.copy()
    once[1:] |= rows[1:] != rows[:-1]
    starts = np.flatnonzero(first[once])
    inside = np.arange(once.sum()) - np.repeat(starts, np.diff(np.append(starts, once.sum())))
    starts = np.flatnonzero(inside % BLOCK_KEYS == 0)
    chars = codes[at[once][starts][:, None] + np.arange(n)].astype("<u4").tobytes().decode("utf-32-le")
    return [chars[i : i + n] for i in range(0, len(chars), n)], np.append(starts, once.sum()), rows[once]


def ngram_blocks(df: DataFrame, key: str, body: str, n: int = 3) -> DataFrame:
    """(gram, keys): for blocks of bodies, the keys of those that have an n-gram, in lower case. Each pair of a
    row and a gram stands once; a block ends with its Arrow batch, or at BLOCK_CHARS characters, a row at BLOCK_KEYS keys."""
    low = F.lower(F.col(body))
    out = T.StructType([T.StructField("gram", T.StringType()), T.StructField("keys", T.ArrayType(df.schema[key].dataType))])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            at = 0
            while at < len(texts):
                before = ends[at - 1] if at else 0
                end = max(int(np.searchsorted(ends, before + BLOCK_CHARS, side="right")), at + 1)
                grams, offsets, rows = _inverted(texts[at:end], n)
                keys = batch.column(0).take(pa.array(rows + at))
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), keys)], out.names)
                at = end

    return df.where(F.length(low) >= n).select(key, low.alias("__low")).mapInArrow(run, out)


def ngram_postings(df: DataFrame, key: str, body: str, n: int = 3) -> DataFrame:
    """(key, gram): the distinct n-grams of each body. Write `ngram_blocks` sorted by gram to reuse them."""
    return ngram_blocks(df, key, body, n).select(F.explode("keys").alias(key), "gram")


def index_search(df: DataFrame, postings: DataFrame, key: str, body: str, needle: str, n: int = 3) -> DataFrame:
    """The rows whose body has ``needle``: candidates from the postings, then the exact test.

    Needles shorter than n are searched by a scan; both ways give the same rows."""
    low = needle.lower()
    if len(low) < n:
        return df.where(body_has(F.col(body), F.lit(needle)))
    grams = sorted({low[i : i + n] for i in range(len(low) - n + 1)})
    hit = postings.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(grams)).select(key)
    return df.join(hit, key, "left_semi").where(body_has(F.col(body), F.lit(needle)))


def line_col(text, offset) -> tuple[Column, Column]:
    """0-based (line, column) of a 0-based offset."""
    prefix = F.left(text, offset)
    line = F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit("")))
    return line.cast("long"), (F.length(F.substring_index(prefix, "\n", -1))).cast("long")


def ranked_first(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row per key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def resolve_path(paths: DataFrame, path: str, levels: list[tuple[DataFrame, str, str, str | None]]) -> DataFrame:
    """Dotted names to keys, one segment per level: (table, name column, key column, parent column).

    Adds key_1, key_2 ... (null where a segment is missing or unknown). Segments match
    without regard to case and blanks."""
    out = paths.withColumn("__parts", F.split(F.col(path), "\\."))
    for i, (table, name, key, parent) in enumerate(levels):
        t = table.select(squeezed(name).alias("__name"), F.col(key).alias(f"key_{i + 1}"), *([F.col(parent).alias("__parent")] if parent else []))
        on = squeezed(F.get("__parts", F.lit(i))) == F.col("__name")
        if parent:
            on = on & (F.col(f"key_{i}") == F.col("__parent"))
        out = out.join(t, on, "left").drop("__name", "__parent")
    return out.drop("__parts")
