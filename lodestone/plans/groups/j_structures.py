"""Group J: structures that the engine keeps or builds: postings, indexes, edges, pins, numbers, regions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.catalog import Catalog
from lodestone.lineage import cut, ensure_checkpoint_dir
from lodestone.operators import align, needles, numbering, scopes
from lodestone.operators import code as K
from lodestone.plans.groups.g_code import modules
from lodestone.plans.tables import t
from lodestone.schema import TABLES, empty
from lodestone.sources import edges, gram_index, sinks, versions
from lodestone.tools import Tools


def base_tables(spark, d, where="true"):
    """A base of one common module for each part: meta_object, module and method, cut once."""
    m = modules(spark, d).where(where)
    name, none = F.col("module"), lambda kind: F.lit(None).cast(kind)
    objects = m.select(F.col("p_partkey").alias("id"), F.lit(1).cast("long").alias("source_id"), none("long").alias("parent_id"), F.lit(0).alias("ord"), F.concat(F.lit("CommonModule/"), name).alias("path"),
                       F.lit("CommonModule").alias("type"), name.alias("name"), name.alias("uuid"), *(none("string").alias(c) for c in ("comment", "obj_version", "type_ru")), F.lit("[]").alias("header_json"))
    module = m.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("object_id"), F.lit("obj").alias("code_name"), none("string").alias("context"), F.lit("").alias("body"))
    method = K.methods(m.withColumnRenamed("p_partkey", "module_id"), ["module_id"], "text").withColumn("id", F.col("module_id"))
    return {"meta_object": objects, "module": module, "method": cut(method.select(*(c.split()[0] for c in TABLES["method"].split(", "))))}


def needle_hits(spark, d):
    """Pieces of part names in all part names, by postings: how many names have each piece, and the first."""
    p = t(spark, d, "part")
    wanted = p.select(F.substring("p_name", 3, 7).alias("needle")).distinct()
    found = needles.hits(wanted, "needle", p.select("p_partkey", "p_name"), ["p_partkey"], "p_name")
    return found.groupBy("needle").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


def indexed_methods(spark, d):
    """`find_methods` through the stored index of a base that is written first."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/base-{uuid.uuid4().hex}"
    fs, Path = versions.file_system(spark, path)
    try:
        sinks.commit_base(spark, base_tables(spark, d), path)
        gram_index.build(spark, path)
        c = Catalog(spark)
        c.open(path, "base")
        return cut(Tools(c).find_methods(text="имя77", limit=200).select("path", "name"))
    finally:
        fs.delete(Path(path), True)


def call_edges(spark, d):
    """Typed edges of all modules, resolved by joins."""
    b = base_tables(spark, d)
    found = edges.resolve(edges.parse(b["method"], b["module"]), b["meta_object"], b["method"], b["module"])
    return found.select("kind", "src", "dst", F.col("line").cast("long").alias("line"))


def pinned_bases(spark, d):
    """Prefixes of fingerprints resolved to bases: one for each customer, of 1 to 12 characters."""
    c = t(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("fingerprint"))
    pins = c.select(F.col("c_custkey").alias("pin"), F.expr("left(fingerprint, cast(1 + c_custkey % 12 as int))").alias("prefix"))
    found = scopes.resolve_pins(pins, c.select(F.col("c_custkey").cast("string").alias("alias"), "fingerprint"))
    return found.select("pin", F.col("n_bases").cast("long").alias("n_bases"), "base", "state")


def dense_numbers(spark, d):
    """All events numbered by value, then id, without a task that sees them all."""
    e = t(spark, d, "events").select("event_id", "value")
    return numbering.number(e, [F.col("value").asc_nulls_first(), "event_id"], "number")


def dependencies_of_bases(spark, d):
    """What one method uses, in two bases with the same names: the one has the module that it calls, the other lacks it."""
    c = Catalog(spark)
    for alias, where in (("whole", "true"), ("odd", "p_partkey % 2 = 1")):
        rows = base_tables(spark, d, where)
        c.open(f"{d}/{alias}", alias, {n: rows.get(n) or empty(spark, n) for n in TABLES})
    out = Tools(c).method_dependencies("CommonModule/М7", "Имя7", scope=[], db=["whole", "odd"])
    return out.where("kind = 'call'").select("base", F.col("line").cast("long").alias("line"), "target", "state", "place")


def three_way_regions(spark, d):
    """Regions of three versions of every document: the second has its lines' first letters raised, the third lacks every seventh line."""
    docs = t(spark, d, "documents").where("text is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    lines = cut(align.lines_of(docs, ["doc_id"], "text"))
    new = lines.withColumn("h", F.when(F.col("pos") % 5 == 2, F.xxhash64(F.initcap("line"))).otherwise(F.col("h")))
    own = align.renumbered(lines.where("pos % 7 <> 3"), ["doc_id"])
    found = align.three_way(lines, new, own, ["doc_id"])
    return found.groupBy("doc_id", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("n_old").alias("n_old"))


QUERIES = {f.__name__: f for f in (needle_hits, indexed_methods, call_edges, pinned_bases, dense_numbers, dependencies_of_bases, three_way_regions)}

_NEXT = "(p_partkey + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END)"
SQL = {
    "needle_hits": """SELECT needle, count(*) AS n, min(p_partkey) AS first_part FROM (SELECT DISTINCT substr(p_name, 3, 7) AS needle FROM part WHERE length(p_name) > 2) JOIN part ON contains(lower(p_name), lower(needle)) GROUP BY needle""",
    "indexed_methods": f"""SELECT 'CommonModule/М' || p_partkey AS path, 'Имя' || p_partkey AS name FROM part
        WHERE starts_with('имя' || p_partkey, 'имя77') OR starts_with('имя' || {_NEXT}, 'имя77') ORDER BY p_partkey LIMIT 200""",
    "call_edges": f"""SELECT CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN 'unconfirmed' ELSE 'code' END AS kind, 'commonmodule/м' || p_partkey || '/имя' || p_partkey AS src,
        CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN '' ELSE 'commonmodule/м' || (p_partkey + 1) END || '/имя' || {_NEXT} AS dst, 6::BIGINT AS line FROM part""",
    "pinned_bases": """WITH c AS (SELECT c_custkey, sha256(c_name) AS f FROM customer), p AS (SELECT c_custkey AS pin, left(f, (1 + c_custkey % 12)::INTEGER) AS prefix FROM c),
        n AS (SELECT pin, count(*) AS n_bases, min(c_custkey) AS one FROM p JOIN c ON starts_with(f, prefix) GROUP BY pin)
        SELECT pin, n_bases, CASE WHEN n_bases = 1 THEN one::VARCHAR END AS base, CASE WHEN n_bases = 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM n""",
    "dense_numbers": "SELECT event_id, value, row_number() OVER (ORDER BY value NULLS FIRST, event_id) AS number FROM events",
    "dependencies_of_bases": f"""SELECT base, 6::BIGINT AS line, 'М8.Имя' || {_NEXT} AS target, CASE WHEN base = 'odd' THEN 'outside' WHEN p_size % 3 = 0 THEN 'missing_method' ELSE 'ok' END AS state, 'whole' AS place
        FROM part, (VALUES ('whole'), ('odd')) b(base) WHERE p_partkey = 7""",
}
