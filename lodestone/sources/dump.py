"""Folders of decoded configurations: file map, objects, module texts, report queries.

Everything starts from Spark's ``binaryFile`` source and stays a plan of built-in
functions, except for reading texts in unknown encodings.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.numbering import number
from lodestone.operators.tree import nearest_parent
from lodestone.sources.brace import to_text

#: Kinds of files whose bytes are kept as texts.
TEXT_KINDS = ("bsl", "json", "txt", "html", "xml", "c1brace", "text")


def file_map(spark: SparkSession, path: str, with_binary: bool = False) -> DataFrame:
    """path (relative), dir, kind, size and data (texts always, others on demand); empty files too."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").removeprefix("file://").rpartition("/")[2]
    where = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), f"^.*?/{re.escape(root)}/", "")
    some = raw.select(where.alias("path"), "length", "content")
    empty = _listed(raw).select(where.alias("path")).join(some.select("path"), "path", "left_anti").collect()  # names only; Spark's listing holds them all
    if empty:  # an Arrow table is a local relation: one partition, no Python
        rows = pa.table({"path": pa.array([r.path for r in empty]), "length": pa.array([0] * len(empty), pa.int64()), "content": pa.array([b""] * len(empty), pa.binary())})
        some = some.unionByName(spark.createDataFrame(rows))
    every = some
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    data = F.col("content") if with_binary else F.when(kind.isin(*TEXT_KINDS), F.col("content"))
    return every.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), kind.alias("kind"), F.col("length").alias("size"), data.alias("data"))


def _listed(raw: DataFrame) -> DataFrame:
    """path of every file that Spark listed for ``raw``; its scans leave empty ones out."""
    paths = raw.sparkSession._jvm.org.apache.hadoop.util.StringUtils.join("\n", raw._jdf.inputFiles())  # URIs, so without line feeds
    return raw.sparkSession.createDataFrame([(p,) for p in paths.split("\n") if p], "path string")


def objects(files: DataFrame) -> DataFrame:
    """Folders that hold an object (<Class>.json with <Class>.id.json): path, type, depth, parent and id.

    Ids follow depth, then path: the same for the same tree, parents before children."""
    names = files.where("kind = 'json'").select("dir", F.regexp_extract("path", r"([^/]+?)(\.id)?\.json$", 1).alias("type"), F.regexp_extract("path", r"(\.id)\.json$", 1).alias("mark"))
    found = names.groupBy("dir", "type").agg(F.count_if(F.col("mark") != "").alias("ids"), F.count_if(F.col("mark") == "").alias("heads")).where("ids > 0 and heads > 0")
    one = found.groupBy("dir").agg(F.min("type").alias("type")).withColumnRenamed("dir", "path")
    numbered = one.withColumn("depth", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))))
    with_id = number(numbered, ["depth", "path"], "id")
    return with_id.join(nearest_parent(with_id), "id", "left").select("id", "parent_id", "path", "type", "depth", F.regexp_extract("path", "([^/]*)$", 1).alias("name"))


def modules(files: DataFrame) -> DataFrame:
    """path, stem, code_name and body of module texts (Stem.code.bsl or Stem.code.text)."""
    pattern = r"([^/.]+)\.([^/.]+)\.(bsl|text)$"
    return files.where(F.col("path").rlike(pattern)).select("path", "dir", F.regexp_extract("path", pattern, 1).alias("stem"), F.regexp_extract("path", pattern, 2).alias("code_name"), to_text(F.col("data")).alias("body"))


def report_queries(files: DataFrame) -> DataFrame:
    """dir, ord and query: the texts of <query> elements in templates, unescaped, empty ones left out."""
    bodies = files.where("kind in ('bin', 'xml')").select("dir", to_text(F.col("data")).alias("x"))
    each = bodies.select("dir", F.posexplode(F.regexp_extract_all("x", F.lit(r"(?s)<(?:\w+:)?query(?:\s[^>]*)?>(.*?)</(?:\w+:)?query>"), F.lit(1))).alias("pos", "q"))
    plain = F.col("q")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return each.select("dir", F.col("pos").alias("ord"), F.trim(plain, F.lit(" \t\r\n")).alias("query")).where("query <> ''")


def fingerprint_state(spark: SparkSession, path: str, known: str | None) -> DataFrame:
    """file, sha256 and state (skip, changed or new) of a source file."""
    raw = spark.read.format("binaryFile").load(path)
    sha = F.sha2("content", 256)
    return raw.select("path", sha.alias("sha256"), (F.when(sha == known, "skip").otherwise("changed") if known else F.lit("new")).alias("state"))
