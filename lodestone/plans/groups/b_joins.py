"""Group B: references and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import paging
from lodestone.plans.tables import t


def _links(spark, d):
    """customer -> part through orders and lines: who refers to what."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(t(spark, d, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"))


def refs_forward(spark, d):
    out = _links(spark, d).where("src BETWEEN 100 AND 109").distinct().join(t(spark, d, "part"), F.col("dst") == F.col("p_partkey"))
    return paging.page(out, ["src", "p_name", "dst"], 200).select("src", "dst", "p_name")


def refs_reverse(spark, d):
    out = _links(spark, d).where("dst IN (5, 6, 7)").distinct().join(t(spark, d, "customer"), F.col("src") == F.col("c_custkey"))
    return out.select("dst", "src", "c_name").orderBy("dst", "c_name")


def refs_totals(spark, d):
    return _links(spark, d).groupBy("src").agg(F.count_distinct("dst").alias("n_targets"), F.count(F.lit(1)).alias("n_links"))


def sections_with_fields(spark, d):
    """Sections without fields stay, with nulls."""
    items = t(spark, d, "lineitem")
    return t(spark, d, "part").join(items, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_name", "l_orderkey", "l_linenumber", "l_suppkey")


def suffix_join(spark, d):
    """An equi key and, as residual, the end of one text."""
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    return c.join(o, (F.col("c_custkey") == F.col("o_custkey")) & F.endswith(F.col("c_name"), F.right(F.col("o_orderkey").cast("string"), F.lit(1)))).select("c_custkey", "o_orderkey")


def common_scope(spark, d):
    """Objects without any binding are common to all."""
    n, s = t(spark, d, "nation"), t(spark, d, "supplier")
    both = n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return both.groupBy("n_name").agg(F.bool_or(F.col("s_suppkey").isNull()).alias("for_all"), F.count("s_suppkey").alias("n_bound"))


def card_refs(spark, d):
    items = t(spark, d, "lineitem").where("l_partkey = 11").select("l_suppkey").distinct().join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return items.orderBy("s_name").limit(12).select("s_suppkey", "s_name")


def external_refs(spark, d):
    """Names found in distinct texts by a pattern, counted, with those that are known left out."""
    hosts = t(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host")).distinct()
    names = hosts.select(F.explode(F.split("host", "\\.")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    known = t(spark, d, "documents").select(F.col("lang").alias("name")).distinct()
    return names.join(known, "name", "left_anti").where("n >= 2")


QUERIES = {f.__name__: f for f in (refs_forward, refs_reverse, refs_totals, sections_with_fields, suffix_join, common_scope, card_refs, external_refs)}

_LINKS = "links AS (SELECT o_custkey AS src, l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
SQL = {
    "refs_forward": f"WITH {_LINKS} SELECT DISTINCT src, dst, p_name FROM links JOIN part ON dst = p_partkey WHERE src BETWEEN 100 AND 109 ORDER BY src, p_name, dst LIMIT 200",
    "refs_reverse": f"WITH {_LINKS} SELECT DISTINCT dst, src, c_name FROM links JOIN customer ON src = c_custkey WHERE dst IN (5, 6, 7) ORDER BY dst, c_name",
    "refs_totals": f"WITH {_LINKS} SELECT src, count(DISTINCT dst) AS n_targets, count(*) AS n_links FROM links GROUP BY src",
    "sections_with_fields": "SELECT p_partkey, p_name, l_orderkey, l_linenumber, l_suppkey FROM part LEFT JOIN lineitem ON p_partkey = l_partkey",
    "suffix_join": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND ends_with(c_name, right(o_orderkey::VARCHAR, 1))",
    "common_scope": "SELECT n_name, bool_or(s_suppkey IS NULL) AS for_all, count(s_suppkey) AS n_bound FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name",
    "card_refs": "SELECT DISTINCT s_suppkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = 11 ORDER BY s_name LIMIT 12",
    "external_refs": """
        WITH h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages),
        n AS (SELECT name, count(*) AS n FROM (SELECT unnest(string_split(host, '.')) AS name FROM h) GROUP BY name)
        SELECT name, n FROM n WHERE n >= 2 AND name NOT IN (SELECT DISTINCT lang FROM documents)""",
}
