"""Writing a base, as a plain folder or as a new version, and single-table sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import BadArguments
from lodestone.schema import DERIVED, REVISION, TABLES, empty
from lodestone.sources import edges, metadata, versions


def write_base(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Replaces the base at ``path``, a folder without versions (`commit_base` keeps them): tables are written beside it, and folders are renamed when all
    are there. Readers never see a part; a crash between the two renames leaves the old base
    whole as ``<path>.before-<id>``, and a rename that fails puts it back."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise BadArguments(f"no such tables: {sorted(unknown)}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    number = uuid.uuid4().hex
    staging, before = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{tag}{number}") for tag in ("", "before-"))
    try:
        for name in TABLES:
            wanted = empty(spark, name).schema
            df = tables.get(name, empty(spark, name))
            cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields]
            df.select(*cols).write.parquet(f"{staging}/{name}")
        replaces = fs.exists(target)
        if replaces and not fs.rename(target, before):
            raise OSError(f"cannot rename {target}")
        if not fs.rename(staging, target):
            if replaces:
                fs.rename(before, target)
            raise OSError(f"cannot rename {staging}")
        if replaces:
            fs.delete(before, True)
    finally:
        if fs.exists(staging):
            fs.delete(staging, True)


def commit_base(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> versions.Version:
    """Commits ``tables`` (those missing are empty) as the latest version of the base at ``path``.

    Readers see the version before until the one step that commits this one, and a crash
    leaves what was there; older versions stay readable until `versions.vacuum`. Call edges
    are derived from the stored tables; modules that are as they were in the version before
    are not parsed again."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise BadArguments(f"no such tables: {sorted(unknown)}")
    id_, folder = versions.new_folder()
    for name in TABLES:
        wanted = empty(spark, name).schema
        df = tables.get(name, empty(spark, name))
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields]
        df.select(*cols).write.parquet(f"{path.rstrip('/')}/{folder}/{name}")
    write_edges(spark, f"{path.rstrip('/')}/{folder}", versions.resolve(spark, path))
    return versions.commit(spark, path, id_, REVISION, [*TABLES, *DERIVED])


def write_edges(spark: SparkSession, folder: str, before: versions.Version | None = None) -> None:
    """Writes call_site and call_edge beside the tables in ``folder``."""
    read = lambda name: spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")
    old = None
    if before is not None and before.tables and "call_site" in before.tables:
        old = spark.read.schema(DERIVED["call_site"]).parquet(f"{before.folder}/call_site")
    edges.refresh(old, read("method"), read("module"))[0].write.parquet(f"{folder}/call_site")
    sites = spark.read.schema(DERIVED["call_site"]).parquet(f"{folder}/call_site")
    objects = read("meta_object")
    events = metadata.event_index(objects).where("handler is not null and method is not null").select(
        F.col("subscription").alias("path"), F.col("handler").alias("handler_path"), "method").distinct()
    edges.resolve(sites, objects, read("method"), read("module"), events).write.parquet(f"{folder}/call_edge")


def write_violations(df: DataFrame, base_path: str) -> None:
    """Overwrites the query_violation table of the base's latest version."""
    where = versions.resolve(df.sparkSession, base_path).folder
    df.write.mode("overwrite").parquet(f"{where}/query_violation")

