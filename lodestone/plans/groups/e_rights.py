"""Group E: access rights."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import rights as R
from lodestone.operators.search import body_has
from lodestone.plans.tables import RIGHTS_SQL, rights, t

TARGET = ["target", "right_no", "sub_index", "value"]


def effective_rights(spark, d):
    out = R.effective(rights(spark, d).where("role < 20"), TARGET)
    return out.select(*TARGET, F.concat_ws(",", F.transform("roles", lambda x: x.cast("string"))).alias("roles"))


def role_diff(spark, d):
    r = rights(spark, d)
    return R.role_diff(r.where("role BETWEEN 0 AND 9"), r.where("role BETWEEN 5 AND 14"), TARGET)


def lost_targets(spark, d):
    r = rights(spark, d)
    return R.lost_targets(r.where("role BETWEEN 0 AND 9"), r.where("role BETWEEN 5 AND 9"), TARGET)


def role_impact(spark, d):
    """Lost targets and the texts that name them."""
    r = rights(spark, d)
    lost = R.lost_targets(r.where("role = 3"), r.where("role = 4"), ["target", "right_no"])
    bodies = t(spark, d, "pages").select("page_id", "url")
    words = lost.select("target", "right_no", F.concat(F.lit("page="), F.col("right_no").cast("string")).alias("needle"))
    return words.join(bodies, body_has(F.col("url"), F.col("needle"))).groupBy("target", "right_no").agg(F.count(F.lit(1)).alias("n_texts"), F.min("page_id").alias("first_page"))


def object_rights(spark, d):
    r = rights(spark, d).where("target = 'view'").select("role", "right_no", "sub_index", "flags").distinct()
    order = [F.col("right_no").asc_nulls_last(), F.col("sub_index").asc_nulls_first(), "flags"]
    return R.targets_per_role(r, "role", order, 12)


def target_label(spark, d):
    s, n, g = t(spark, d, "supplier"), t(spark, d, "nation"), t(spark, d, "region")
    both = s.join(n, (F.col("s_nationkey") == F.col("n_nationkey")) & (F.col("n_nationkey") % 2 == 0), "left").join(g, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("r_regionkey") > 1), "left")
    marker = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string"))
    return both.select("s_suppkey", R.label(F.when(F.col("s_suppkey") % 5 == 0, F.col("s_name")), F.col("n_name"), F.col("r_name"), marker, F.when(F.col("s_suppkey") % 2 == 0, F.lit("x")), F.when(F.col("s_suppkey") % 4 == 0, F.lit("1/1"))).alias("label"))


def rights_state(spark, d):
    per = rights(spark, d).where("role % 3 <> 0").groupBy("role").agg(F.count_if(F.col("value") == 1).alias("n"), F.count_if(F.col("sub_index").isNull() & (F.col("right_no") == 3)).alias("open"))
    roles = spark.range(0, 160).select(F.col("id").alias("role"), F.when(F.col("id") % 5 != 0, F.col("id") % 7 != 0).alias("parsed"))
    return roles.join(per, "role", "left").select("role", R.state(F.col("parsed"), F.coalesce("n", F.lit(0)), F.coalesce("open", F.lit(0))).alias("state"))


def rights_by_keys(spark, d):
    """Exact tuples, not the product of two lists."""
    keys = spark.createDataFrame([(1, "view"), (2, "click"), (3, "error"), (3, "view")], "role long, target string")
    return rights(spark, d).join(keys, ["role", "target"], "left_semi").select("event_id", "role", "target", "right_no")


def text_truncate(spark, d):
    return rights(spark, d).where("rls is not null").select("event_id", R.short_text(F.col("rls")).alias("rls"))


def target_resolve(spark, d):
    """Several uuid maps; later ones win."""
    u = lambda c: F.md5((F.col(c) % 700).cast("string"))
    maps = [(t(spark, d, "customer").select(u("c_custkey").alias("uuid"), F.col("c_custkey").alias("id")), "object"),
            (t(spark, d, "part").select(u("p_partkey").alias("uuid"), F.col("p_partkey").alias("id")), "attribute"),
            (t(spark, d, "supplier").select(u("s_suppkey").alias("uuid"), F.col("s_suppkey").alias("id")), "section")]
    r = t(spark, d, "orders").select("o_orderkey", u("o_orderkey").alias("target_uuid"))
    return R.resolve_target(r, maps)


def two_pass_resolve(spark, d):
    """The owner must exist; the kind may be missing."""
    link = t(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 140).alias("kind_no"))
    owner = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    kind = t(spark, d, "supplier").select(F.col("s_suppkey").alias("kind_no"), F.col("s_suppkey").alias("kind_id"))
    return link.join(owner, "o_custkey").join(kind, "kind_no", "left").select("o_orderkey", "c_name", "kind_id")


QUERIES = {f.__name__: f for f in (effective_rights, role_diff, lost_targets, role_impact, object_rights, target_label, rights_state, rights_by_keys, text_truncate, target_resolve, two_pass_resolve)}

_K = "target, right_no, sub_index, value"
SQL = {
    "effective_rights": f"WITH {RIGHTS_SQL} SELECT {_K}, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM rights WHERE role < 20 GROUP BY {_K}",
    "role_diff": f"""WITH {RIGHTS_SQL}, a AS (SELECT DISTINCT {_K} FROM rights WHERE role BETWEEN 0 AND 9), b AS (SELECT DISTINCT {_K} FROM rights WHERE role BETWEEN 5 AND 14)
        SELECT *, 'only_a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'only_b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'common' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""",
    "lost_targets": f"WITH {RIGHTS_SQL} SELECT {_K} FROM rights WHERE role BETWEEN 0 AND 9 EXCEPT SELECT {_K} FROM rights WHERE role BETWEEN 5 AND 9",
    "role_impact": f"""WITH {RIGHTS_SQL}, lost AS (SELECT target, right_no FROM rights WHERE role = 3 EXCEPT SELECT target, right_no FROM rights WHERE role = 4)
        SELECT target, right_no, count(*) AS n_texts, min(page_id) AS first_page FROM lost JOIN pages ON contains(lower(url), 'page=' || right_no) GROUP BY 1, 2""",
    "object_rights": f"""WITH {RIGHTS_SQL}, r AS (SELECT DISTINCT role, right_no, sub_index, flags FROM rights WHERE target = 'view')
        SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY role) AS n_targets, row_number() OVER (PARTITION BY role ORDER BY right_no NULLS LAST, sub_index NULLS FIRST, flags) AS rank FROM r) WHERE rank <= 12""",
    "target_label": """SELECT s_suppkey, concat_ws(' ', CASE WHEN s_suppkey % 5 = 0 THEN concat_ws('.', r_name, n_name, s_name) WHEN n_name IS NOT NULL THEN concat_ws('.', r_name, n_name) WHEN r_name IS NOT NULL THEN r_name
        WHEN s_suppkey % 3 = 0 THEN 'marker ' || s_suppkey WHEN s_suppkey % 2 = 0 THEN 'sub-object x' ELSE 'unresolved' END, CASE WHEN s_suppkey % 4 = 0 THEN '[1/1]' END) AS label
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1""",
    "rights_state": f"""WITH {RIGHTS_SQL}, p AS (SELECT role, count(*) FILTER (value = 1) AS n, count(*) FILTER (sub_index IS NULL AND right_no = 3) AS o FROM rights WHERE role % 3 <> 0 GROUP BY role),
        r AS (SELECT i AS role, CASE WHEN i % 5 <> 0 THEN i % 7 <> 0 END AS parsed FROM range(160) t(i))
        SELECT r.role, CASE WHEN parsed IS NULL THEN 'absent' WHEN NOT parsed THEN 'unavailable' WHEN coalesce(n, 0) = 0 THEN 'unconfirmed' WHEN coalesce(o, 0) > 0 THEN 'partial' ELSE 'interpreted' END AS state
        FROM r LEFT JOIN p ON r.role = p.role""",
    "rights_by_keys": f"WITH {RIGHTS_SQL} SELECT event_id, role, target, right_no FROM rights WHERE (role, target) IN ((1, 'view'), (2, 'click'), (3, 'error'), (3, 'view'))",
    "text_truncate": f"""WITH {RIGHTS_SQL}, o AS (SELECT event_id, trim(regexp_replace(rls, '\\s+', ' ', 'g')) AS x FROM rights WHERE rls IS NOT NULL)
        SELECT event_id, CASE WHEN length(x) > 600 THEN left(x, 600) || '...' ELSE x END AS rls FROM o""",
    "target_resolve": """
        WITH m AS (SELECT md5((c_custkey % 700)::VARCHAR) AS u, c_custkey::VARCHAR AS id, 'object' AS k, 0 AS r FROM customer
          UNION ALL SELECT md5((p_partkey % 700)::VARCHAR), p_partkey::VARCHAR, 'attribute', 1 FROM part
          UNION ALL SELECT md5((s_suppkey % 700)::VARCHAR), s_suppkey::VARCHAR, 'section', 2 FROM supplier),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY r DESC, id DESC) AS n FROM m) WHERE n = 1)
        SELECT o_orderkey, md5((o_orderkey % 700)::VARCHAR) AS target_uuid, k AS target_kind, id AS target_id FROM orders LEFT JOIN b ON u = md5((o_orderkey % 700)::VARCHAR)""",
    "two_pass_resolve": """SELECT o_orderkey, c_name, s_suppkey AS kind_id FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN supplier ON s_suppkey = o_orderkey % 140""",
}
