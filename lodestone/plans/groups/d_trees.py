"""Group D: trees and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import tree as T
from lodestone.operators.search import ranked_first
from lodestone.plans.tables import TREE_SQL, t, tree


def object_tree(spark, d):
    out = T.subtree(tree(spark, d), F.col("name") == "ASIA", 2)
    return out.orderBy("sort_key").limit(200).select("sort_key", "level", "node", "name")


def ancestors(spark, d):
    return T.ancestors(tree(spark, d), F.col("type").startswith("Customer"), most=4)


def child_buckets(spark, d):
    n = tree(spark, d)
    kids = n.where("parent_id >= 1000").groupBy("parent_id", T.bucket_of(F.col("type")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))
    return kids


def predefined_tree(spark, d):
    """Depth by recursion below a hidden root; ord already is depth-first."""
    spark_sql = T.subtree(tree(spark, d).where("type <> 'CustomerForm'"), F.col("id") == 3, 2).where("level > 0")
    return spark_sql.select("node", "name", "level").orderBy("level", "node").limit(60)


def _supply(spark, d):
    """Supplier and part as one graph, both ways, over large lines only."""
    e = t(spark, d, "lineitem").where("l_quantity >= 48").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def callers_bfs(spark, d):
    start = spark.createDataFrame([("p10",), ("p11",)], "node string")
    return G.bfs(_supply(spark, d), start, 3, source="dst", target="src")


def callees_bfs(spark, d):
    start = spark.createDataFrame([("s3",)], "node string")
    return G.bfs(_supply(spark, d), start, 2)


def parent_resolve(spark, d):
    """Nearest existing prefix of a path."""
    r, n, c = t(spark, d, "region"), t(spark, d, "nation").where("n_nationkey % 3 <> 0"), t(spark, d, "customer")
    all_n = t(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    paths = r.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("path")).unionByName(
        n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.concat_ws("/", "r_name", "n_name").alias("path"))).unionByName(
        c.join(all_n, F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") + 10000).alias("id"), F.concat_ws("/", "r_name", "n_name", "c_name").alias("path")))
    return T.nearest_parent(paths)


def ordered_membership(spark, d):
    """Members in first-seen order, without the owner itself, densely numbered."""
    m = t(spark, d, "lineitem").where("l_suppkey <> l_orderkey").select("l_orderkey", "l_suppkey", "l_linenumber")
    first = ranked_first(m, ["l_orderkey", "l_suppkey"], ["l_linenumber"])
    return T.ordinal(first, ["l_orderkey"], ["l_linenumber", "l_suppkey"]).select("l_orderkey", "l_suppkey", "ord")


def common_targets(spark, d):
    """Numbers in a text list that are known objects, other than itself, once each."""
    items = t(spark, d, "events").select("event_id", F.explode(F.array(F.col("user_id"), F.get_json_object("props", "$.k").cast("long"))).alias("target"))
    return items.where("event_id <> target").join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("target")), "target").dropDuplicates(["event_id", "target"]).select("event_id", "target")


def nested_types(spark, d):
    """Types, their properties and nested types, as paths."""
    out = T.subtree(tree(spark, d).where("ord is not null"), F.col("parent_id").isNull(), 2)
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("sort_key").alias("last_key"))


def ancestors_sql(spark, d):
    """The same walk as a recursive query, for users of SQL."""
    tree(spark, d).createOrReplaceTempView("lodestone_tree")
    return spark.sql("""
        WITH RECURSIVE up(start, steps, node, name, above) AS (
          SELECT id, 0, id, name, parent_id FROM lodestone_tree WHERE id = 10007
          UNION ALL SELECT up.start, up.steps + 1, t.id, t.name, t.parent_id FROM up JOIN lodestone_tree t ON t.id = up.above)
        SELECT start, steps, node, name FROM up""")


QUERIES = {f.__name__: f for f in (object_tree, ancestors, child_buckets, predefined_tree, callers_bfs, callees_bfs, parent_resolve, ordered_membership, common_targets, nested_types, ancestors_sql)}

_SUB = """
sub AS (
  SELECT id AS node, name, lpad(coalesce(ord, 99999999)::VARCHAR, 8, '0') || lpad(id::VARCHAR, 12, '0') AS sort_key, 0 AS level FROM nodes WHERE {root}
  UNION ALL SELECT t.id, t.name, s.sort_key || lpad(coalesce(t.ord, 99999999)::VARCHAR, 8, '0') || lpad(t.id::VARCHAR, 12, '0'), s.level + 1
  FROM sub s JOIN nodes t ON t.parent_id = s.node WHERE s.level < 2)"""
_BFS = """
e AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS t FROM lineitem WHERE l_quantity >= 48),
g AS (SELECT s, t FROM e UNION SELECT t, s FROM e),
b AS (SELECT unnest({start}) AS node, 0 AS depth UNION SELECT g.t, b.depth + 1 FROM b JOIN g ON g.s = b.node WHERE b.depth < {depth})
SELECT node, min(depth) AS depth FROM b GROUP BY node"""
SQL = {
    "object_tree": f"WITH RECURSIVE {TREE_SQL}, nodes AS (SELECT * FROM tree), {_SUB.format(root="name = 'ASIA'")} SELECT sort_key, level, node, name FROM sub ORDER BY sort_key LIMIT 200",
    "ancestors": f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT id AS start, 0 AS steps, id AS node, name, parent_id FROM tree WHERE starts_with(type, 'Customer')
        UNION ALL SELECT up.start, up.steps + 1, t.id, t.name, t.parent_id FROM up JOIN tree t ON t.id = up.parent_id) SELECT start, steps, node, name FROM up""",
    "child_buckets": f"""WITH {TREE_SQL} SELECT parent_id, CASE WHEN ends_with(type, 'Form') THEN 'form' WHEN ends_with(type, 'Command') THEN 'command' WHEN ends_with(type, 'Template') THEN 'template' ELSE 'other' END AS bucket,
        count(*) AS n, min(name) AS first_name FROM tree WHERE parent_id >= 1000 GROUP BY 1, 2""",
    "predefined_tree": f"WITH RECURSIVE {TREE_SQL}, nodes AS (SELECT * FROM tree WHERE type <> 'CustomerForm'), {_SUB.format(root='id = 3')} SELECT node, name, level FROM sub WHERE level > 0 ORDER BY level, node LIMIT 60",
    "callers_bfs": "WITH RECURSIVE " + _BFS.format(start="['p10', 'p11']", depth=3),
    "callees_bfs": "WITH RECURSIVE " + _BFS.format(start="['s3']", depth=2),
    "parent_resolve": """
        WITH p AS (SELECT r_regionkey::BIGINT AS id, r_name AS path FROM region
          UNION ALL SELECT n_nationkey + 1000, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0
          UNION ALL SELECT c_custkey + 10000, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT a.id, arg_max(b.id, length(b.path)) AS parent_id FROM p a JOIN p b ON starts_with(a.path, b.path || '/') GROUP BY a.id""",
    "ordered_membership": """SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first, l_suppkey) - 1 AS ord FROM
        (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first FROM lineitem WHERE l_suppkey <> l_orderkey GROUP BY 1, 2)""",
    "common_targets": """WITH i AS (SELECT event_id, user_id AS target FROM events UNION SELECT event_id, json_extract_string(props, '$.k')::BIGINT FROM events)
        SELECT event_id, target FROM i WHERE event_id <> target AND target IN (SELECT s_suppkey FROM supplier)""",
    "nested_types": f"WITH RECURSIVE {TREE_SQL}, nodes AS (SELECT * FROM tree WHERE ord IS NOT NULL), {_SUB.format(root='parent_id IS NULL')} SELECT level, count(*) AS n, max(sort_key) AS last_key FROM sub GROUP BY level",
    "ancestors_sql": f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT id AS start, 0 AS steps, id AS node, name, parent_id FROM tree WHERE id = 10007
        UNION ALL SELECT up.start, up.steps + 1, t.id, t.name, t.parent_id FROM up JOIN tree t ON t.id = up.parent_id) SELECT start, steps, node, name FROM up""",
}
