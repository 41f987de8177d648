"""Incremental reading of new source files, as an extension: Structured Streaming over
``binaryFile`` with ``availableNow``, skipping what is known by fingerprint.

Each micro-batch is idempotent: its rows are keyed by fingerprint and the batch's folder
is overwritten on a retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_fingerprints(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of path, size and sha256 of the files in ``folder``."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def ingest_new(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends fingerprints of files not seen before to ``target`` and stops."""
    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["sha256"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (stream_fingerprints(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event counts per session of a key, with a watermark; for streams and tables alike."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")
