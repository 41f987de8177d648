"""The stored n-gram index of method bodies: postings, document frequencies and a manifest.

An index belongs to one content of a base. It is a folder `grams-<build>` below the base's
path, with the tables

* `postings` (gram, ids): which methods' bodies have an n-gram, in lower case. A row is a gram of
  one block of bodies; rows are sorted by gram within range partitions, so a search reads the
  row groups of its grams;
* `frequencies` (gram, df),

and a pointer file `_grams/<number>.json`, created last: n, the base's content id, the
build's id and counts. A search takes the latest manifest. It is refused if its content id
is not that of the base as it is now, if its n is another, or if a table of it is missing;
the caller then scans, with the same result. A build that never finished has no manifest
and is ignored.

A search takes the rarest `GRAMS_READ` n-grams of the needle by their frequencies,
intersects their postings and tests what is left exactly.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import DataError
from lodestone.operators import search
from lodestone.operators.code import spread
from lodestone.sources import versions

N = 3
LAYOUT = 2  # of the tables; 1 was a row for each gram and body
GRAMS_READ = 4  # more do not exclude much, as neighbours occur together
LOG = "_grams"


class StaleIndex(DataError):
    """The index is not one of the base as it is now."""

    code = "INDEX_STALE"


def content_id(spark: SparkSession, path: str) -> str:
    """Names a base's content: the version's id, or (without versions) a digest of the method files' names, sizes and times."""
    version = versions.resolve(spark, path)
    if version.id:
        return version.id
    fs, Path = versions.file_system(spark, path)
    at = Path(f"{version.folder}/method")
    files = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)) if fs.exists(at) else []
    return str(uuid.uuid5(uuid.NAMESPACE_OID, json.dumps(files)))


def build(spark: SparkSession, path: str, n: int = N, partitions: int | None = None) -> dict:
    """Builds the index of the base's bodies; gives its manifest. The old one serves until this one is there."""
    path = path.rstrip("/")
    version, content, build_id = versions.resolve(spark, path), content_id(spark, path), uuid.uuid4().hex
    where = f"{path}/grams-{build_id}"
    bodies, blocks = spark.read.parquet(f"{version.folder}/method").select("id", "body"), f"{where}/blocks"
    search.ngram_blocks(spread(bodies), "id", "body", n).withColumnRenamed("keys", "ids").write.parquet(blocks)  # ranges are sampled, which must not cut the bodies again
    by = ["gram", F.get("ids", F.lit(0))]  # a gram of many blocks may lie in several partitions
    postings = spark.read.parquet(blocks)
    postings = postings.repartitionByRange(partitions, *by) if partitions else postings.repartitionByRange(*by)
    postings.sortWithinPartitions(*by).write.parquet(f"{where}/postings")
    fs, Path = versions.file_system(spark, blocks)
    fs.delete(Path(blocks), True)
    stored = spark.read.parquet(f"{where}/postings")
    stored.groupBy("gram").agg(F.sum(F.size("ids")).alias("df")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{where}/frequencies")
    counts = spark.read.parquet(f"{where}/frequencies").agg(F.count(F.lit(1)).alias("grams"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings")).first()
    manifest = {"n": n, "layout": LAYOUT, "content": content, "build": build_id, "grams": counts["grams"], "postings": counts["postings"]}
    number = (_numbers(spark, path) or [0])[-1] + 1
    while not versions.create_text(spark, f"{path}/{LOG}/{number:012d}.json", json.dumps(manifest)):
        number += 1
    return manifest


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, Path = versions.file_system(spark, path)
    log = Path(f"{path}/{LOG}")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, n: int = N, content: str | None = None) -> dict:
    """The manifest of an index that serves the base's content (as it is now, or ``content``); StaleIndex says why there is none."""
    path = path.rstrip("/")
    known = _numbers(spark, path)
    if not known:
        raise StaleIndex(f"{path}: no index")
    try:
        found = json.loads(versions.read_text(spark, f"{path}/{LOG}/{known[-1]:012d}.json"))
    except ValueError as e:
        raise StaleIndex(f"{path}: unreadable manifest") from e
    if found.get("n") != n:
        raise StaleIndex(f"{path}: index of {found.get('n')}-grams, not {n}")
    if found.get("layout") != LAYOUT:
        raise StaleIndex(f"{path}: the index was built with another layout")
    if found.get("content") != (content or content_id(spark, path)):
        raise StaleIndex(f"{path}: the base has changed since the index was built")
    fs, Path = versions.file_system(spark, path)
    for table in ("postings", "frequencies"):
        if not fs.exists(Path(f"{path}/grams-{found['build']}/{table}/_SUCCESS")):
            raise StaleIndex(f"{path}: {table} of the index is missing")
    return found


def candidate_ids(spark: SparkSession, path: str, needle: str, found: dict) -> DataFrame | None:
    """(id) of the bodies that may have ``needle``, exactly those with its rarest grams; None for a needle shorter than n."""
    n, low = found["n"], needle.lower()
    grams = sorted({low[i : i + n] for i in range(len(low) - n + 1)})
    if not grams:
        return None
    where = f"{path.rstrip('/')}/grams-{found['build']}"
    known = spark.read.parquet(f"{where}/frequencies").where(F.col("gram").isin(grams)).orderBy("df", "gram").collect()  # the needle's grams
    if len(known) < len(grams):  # one of them occurs nowhere
        return spark.range(0).select("id")
    rare = [r["gram"] for r in known[:GRAMS_READ]]
    hit = spark.read.parquet(f"{where}/postings").where(F.col("gram").isin(rare)).select(F.explode("ids").alias("id"))
    return hit.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("id")


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes all builds but the latest committed one; not to be called while searches or builds run."""
    path = path.rstrip("/")
    fs, Path = versions.file_system(spark, path)
    known = _numbers(spark, path)
    live = json.loads(versions.read_text(spark, f"{path}/{LOG}/{known[-1]:012d}.json"))["build"] if known else None
    for n in known[:-1]:
        fs.delete(Path(f"{path}/{LOG}/{n:012d}.json"), False)
    gone = [s.getPath().getName() for s in fs.listStatus(Path(path)) if s.getPath().getName().startswith("grams-")]
    gone = [g for g in gone if g != f"grams-{live}"]
    for g in gone:
        fs.delete(Path(f"{path}/{g}"), True)
    return gone
