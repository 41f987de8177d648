"""Exact dedup with a log-structured merge index, in DataFrame operations only.

* **Memtables.** Every task sorts the digests of its own rows and flushes them as runs of
  at most ``MEMTABLE`` rows (Parquet files sorted by digest, with min/max statistics). No
  shuffle is needed for that; the runs are the index's level 0. Each flush stores a
  membership filter of its digests beside them.
* **Compaction** merges the runs that are not merged yet, one row per digest with the
  identifier that stays (the largest or the smallest) and the group's size. The aggregate
  combines in the map tasks, so a digest that holds a third of all rows sends one row per
  task. Rows of level 1 take part only where the new runs' filters let them pass; the
  result is sorted by ranges of digests and stored as level 1's newest run, which wins over
  older ones. When level 1 has ``FANOUT`` runs, these are merged into one.
* **Byte verification.** Only digests with two rows or more are hits. A filter of the
  hits' digests lets the other texts go before any shuffle; the texts of the hits are then
  grouped by digest *and* by the text itself, whose grouping compares bytes. Two texts with
  one digest are an error.

Edge cases: a null text counts as the empty one; null identifiers rank below all others;
of repeated rows (same identifier, same text) exactly one stays; an empty table gives an
empty result; other columns, whatever their names, are ignored (`dedup_index`) or kept
(`drop_duplicates`).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, delete_path, filter_of, filter_size, maybe_in, not_null_text, number_rows, passing, scratch, table


MEMTABLE = 4_000_000  # rows of a run
FANOUT = 4  # runs of level 1


class MergeIndex:
    """The index in a folder. One writer at a time; a step that fails leaves what was there.

    ``id_type``: the identifiers' SQL type; ``keep``: "max" or "min" of them stays."""

    def __init__(self, spark: SparkSession, path: str, id_type: str, keep: str = "max"):
        self.spark, self.path, self.pick = spark, path.rstrip("/"), F.max if keep == "max" else F.min
        self.schema0 = f"id {id_type}, digest binary, row long"
        self.schema1 = f"digest binary, keep_id {id_type}, keep_run int, keep_row long, group_size long"

    def _stored(self, kind: str) -> list[tuple[int, ...]]:
        """The numbers in the names of the whole runs of a kind, from the folder."""
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        whole = lambda p: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(tuple(map(int, s.getPath().getName().split("-")[1:])) for s in fs.listStatus(fs_path) if whole(s.getPath()))

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """The rows of ``docs`` (a stored table) as sorted runs with their filter; gives the flush's number."""
        run = max(self._stored("filters"), default=(-1,))[0] + 1
        digest = F.unhex(F.sha2(not_null_text(text_col), 256)).alias("digest")
        rows = number_rows(docs.select(F.col(id_col).alias("id"), digest), "row").sortWithinPartitions("digest")
        rows.write.mode("overwrite").option("maxRecordsPerFile", MEMTABLE).parquet(f"{self.path}/level0/run-{run}")
        size = filter_size(self.run(run).count())
        filter_of(self.run(run), "digest", size).withColumn("__size", F.lit(size)).write.mode("overwrite").parquet(f"{self.path}/filters/run-{run}")
        return run

    def run(self, run: int) -> DataFrame:
        """id, digest, row of a flush."""
        return self.spark.read.schema(self.schema0).parquet(f"{self.path}/level0/run-{run}")

    def _passing(self, rows: DataFrame, run: int) -> DataFrame:
        words = self.spark.read.parquet(f"{self.path}/filters/run-{run}")
        first = words.select("__size").first()
        return passing(rows, "digest", words.drop("__size"), first[0]) if first else rows.limit(0)

    def _merge(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(self.pick(F.struct("keep_id", "keep_run", "keep_row")).alias("best"), F.sum("group_size").alias("group_size")).select(
            "digest", "best.*", "group_size")

    def _write(self, rows: DataFrame, number: int, upto: int) -> None:
        """A run of level 1. Its name says the last flush that level 1 holds with it, so run and mark are one commit."""
        rows.repartitionByRange("digest").sortWithinPartitions("digest").write.mode("overwrite").parquet(f"{self.path}/level1/run-{number}-{upto}")

    def _level1(self, runs: list[tuple[int, ...]]) -> DataFrame:
        """The entries of level 1; of a digest's, the newest run's."""
        read = lambda n, upto: self.spark.read.schema(self.schema1).parquet(f"{self.path}/level1/run-{n}-{upto}")
        if len(runs) < 2:
            return read(*runs[0]) if runs else self.spark.createDataFrame([], self.schema1)
        every = functools.reduce(DataFrame.union, (read(n, upto).withColumn("__n", F.lit(n)) for n, upto in runs))
        return every.groupBy("digest").agg(F.max_by(F.struct("keep_id", "keep_run", "keep_row", "group_size"), "__n").alias("e")).select("digest", "e.*")

    def compact(self) -> None:
        """Merges the flushes that level 1 does not hold yet."""
        level1 = self._stored("level1")
        held = max((upto for _, upto in level1), default=-1)
        fresh = [n for n, in self._stored("filters") if n > held]
        if fresh:
            entry = lambda n: self.run(n).select("digest", F.col("id").alias("keep_id"), F.lit(n).alias("keep_run"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
            rows = self._merge(functools.reduce(DataFrame.union, map(entry, fresh)))
            if level1:  # older entries that no filter lets pass cannot change, and stay where they are
                old = self._level1(level1)
                touched = functools.reduce(DataFrame.union, (self._passing(old, n) for n in fresh)).dropDuplicates(["digest"])
                known = touched.join(rows.select("digest"), "digest", "left_semi")
                rows = self._merge(rows.unionByName(known))
            level1 = [*level1, (max(level1, default=(-1,))[0] + 1, fresh[-1])]
            self._write(rows, *level1[-1])
        if len(level1) >= FANOUT:
            number, upto = level1[-1]
            self._write(self._level1(level1), number + 1, upto)
            for n, last in level1:  # the run that holds them all is there; one that is left over is overruled by it
                delete_path(self.spark, f"{self.path}/level1/run-{n}-{last}")

    def entries(self) -> DataFrame:
        """digest, keep_id, keep_run, keep_row, group_size of each digest of the merged flushes."""
        return self._level1(self._stored("level1"))


def verify(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The hits' groups as their bytes say: digest, text, keep_id, group_size.

    Texts whose digest is surely no hit are dropped by a broadcast filter, before the
    shuffle; the aggregate on (digest, text) combines in the map tasks."""
    pick = F.max if keep == "max" else F.min
    text = not_null_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    maybe = maybe_in(rows, "digest", index.where("group_size > 1").select("digest"))
    return maybe.groupBy("digest", "text").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def dedup_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, digest, row, keep_id, group_size, kept.

    ``path``: a new folder for the index. A digest whose hits turn out to be of different texts
    (a collision) raises instead of merging them, as no such pair is known."""
    store = MergeIndex(docs.sparkSession, path, dict(docs.dtypes)[id_col], keep)
    runs = store.run(store.flush(docs, id_col, text_col))
    store.compact()
    index = store.entries()
    checked = verify(docs, index, id_col, text_col, keep).groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("group_size").alias("seen"))
    hits = index.where("group_size > 1").join(checked, "digest", "left").select(
        "digest", "keep_id", "keep_row",
        F.when((F.col("texts") == 1) & (F.col("seen") == F.col("group_size")), F.col("group_size"))
        .otherwise(F.raise_error(F.lit("byte verification failed: equal digests of different texts"))).cast("long").alias("group_size"))
    hits = cut(hits)  # read from storage, so that the join below is free to split a hot digest
    found = runs.join(hits, "digest", "left")
    return found.select(
        "id", "digest", "row",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its text that stays (largest doc_id)."""
    with scratch(spark) as path:
        return cut(dedup_index(table(spark, sf_dir, "documents"), path).select(
            F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one of each set of equal texts."""
    spark = docs.sparkSession
    with scratch(spark) as path:
        gone = cut(dedup_index(docs, path, id_col, text_col, keep).where("not kept").select(F.col("row").alias("__row")))
    return number_rows(docs, "__row").join(gone, "__row", "left_anti").drop("__row")
