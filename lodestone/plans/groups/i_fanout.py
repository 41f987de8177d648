"""Group I: several bases at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import Catalog
from lodestone.plans.tables import t


def _catalog(spark, d):
    """Two bases cut from the same table, and one whose schema is too old."""
    c = Catalog(spark)
    c.open(f"{d}/part.parquet", alias="left", tables={"part": t(spark, d, "part").where("p_partkey % 2 = 0")})
    c.open(f"{d}/part.parquet", alias="right", tables={"part": t(spark, d, "part").where("p_partkey % 3 = 0")})
    c.open(f"{d}/part.parquet", alias="old", tables={"part": t(spark, d, "part")}, revision=7)
    return c


def fanout_union(spark, d):
    out = _catalog(spark, d).table("part", ["left", "right"]).where(F.contains("p_name", F.lit("blue")))
    return out.select("base", "p_partkey", "p_name")


def fanout_status(spark, d):
    return _catalog(spark, d).status(["left", "right", "old", "missing"]).select("base", "status", "error")


def scope_resolution(spark, d):
    """Names found in one base only are certain, in several ambiguous."""
    hits = _catalog(spark, d).table("part", ["left", "right"]).groupBy("p_partkey").agg(F.count_distinct("base").alias("n"), F.min("base").alias("base"))
    return hits.select("p_partkey", F.when(F.col("n") > 1, "ambiguous").otherwise("in_scope").alias("state"), F.when(F.col("n") == 1, F.col("base")).alias("base"))


def event_index(spark, d):
    """Subscriptions with their sources and handlers; what is not found is counted."""
    e = t(spark, d, "events").select("event_id", "event_type", F.explode(F.array(F.col("user_id"), F.col("user_id") + 90)).alias("source"), F.get_json_object("props", "$.k").cast("long").alias("handler"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), "s_name")
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("handler"), "n_name")
    both = e.join(s, "source", "left").join(n, "handler", "left")
    return both.groupBy("event_type", "n_name").agg(F.count("s_name").alias("n_sources"), F.count_if(F.col("s_name").isNull()).alias("n_unresolved"))


def kind_of(spark, d):
    kinds = F.create_map(*(F.lit(x) for p in ((".com", "configuration"), (".net", "extension"), (".org", "report")) for x in p))
    ext = F.lower(F.regexp_extract("url", "^[a-z]+://[^/:]*(\\.[a-z]+)", 1))
    return t(spark, d, "pages").select("page_id", F.coalesce(kinds[ext], F.when(F.contains("url", F.lit("/en/")), "processor"), F.lit("unknown")).alias("kind"))


QUERIES = {f.__name__: f for f in (fanout_union, fanout_status, scope_resolution, event_index, kind_of)}
SQL = {
    "fanout_union": "SELECT 'left' AS base, p_partkey, p_name FROM part WHERE p_partkey % 2 = 0 AND contains(p_name, 'blue') UNION ALL SELECT 'right', p_partkey, p_name FROM part WHERE p_partkey % 3 = 0 AND contains(p_name, 'blue')",
    "fanout_status": "SELECT * FROM (VALUES ('left', 'ok', NULL), ('right', 'ok', NULL), ('old', 'error', 'DB_SCHEMA'), ('missing', 'error', 'BAD_ARGS')) t(base, status, error)",
    "scope_resolution": """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'ambiguous' ELSE 'in_scope' END AS state, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS base
        FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""",
    "event_index": """WITH e AS (SELECT event_type, unnest([user_id, user_id + 90]) AS source, json_extract_string(props, '$.k')::BIGINT AS handler FROM events)
        SELECT event_type, n_name, count(s_name) AS n_sources, count(*) FILTER (s_name IS NULL) AS n_unresolved FROM e LEFT JOIN supplier ON s_suppkey = source LEFT JOIN nation ON n_nationkey = handler GROUP BY 1, 2""",
    "kind_of": """WITH x AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://[^/:]*(\\.[a-z]+)', 1)) AS e FROM pages)
        SELECT page_id, CASE e WHEN '.com' THEN 'configuration' WHEN '.net' THEN 'extension' WHEN '.org' THEN 'report' ELSE CASE WHEN contains(url, '/en/') THEN 'processor' ELSE 'unknown' END END AS kind FROM x""".replace("\\\\", "\\"),
}
