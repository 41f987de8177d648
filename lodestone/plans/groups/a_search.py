"""Group A: catalog search, paging, cards and presets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import paging, search
from lodestone.operators import tree as T
from lodestone.plans.tables import RIGHTS_SQL, TREE_SQL, rights, t, tree


def _parts(spark, d):
    return t(spark, d, "part")


def _found(spark, d, text="ring"):
    return _parts(spark, d).where(search.mask(["p_name"], text))


def find_objects(spark, d):
    return paging.page(_found(spark, d), [F.length("p_name"), "p_name", "p_partkey"], 20).select("p_partkey", "p_name", "p_type")


def find_objects_typed(spark, d):
    found = _parts(spark, d).where(search.mask(["p_name", "p_brand"], "brand# 1") & search.of_type("p_type", "economy"))
    return paging.page(found, [F.length("p_name"), "p_name", "p_partkey"], 50, 10).select("p_partkey", "p_name", "p_brand", "p_type")


def find_field(spark, d):
    both = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where(search.mask(["c_name"], "#00000001"))
    return paging.page(both, ["n_name", "c_name", "c_custkey"], 100, 5).select("n_name", "c_name", "c_custkey", "c_mktsegment")


def search_total(spark, d):
    return _found(spark, d).agg(F.count(F.lit(1)).alias("total"))


def resolve_path(spark, d):
    paths = spark.createDataFrame([("AFRICA.Nation_0.Customer#000000004",), ("america . nation_1",), ("ASIA.NATION_2.Customer#999999999",), ("NOWHERE.NATION_0",), ("EUROPE.NATION_0",), ("ASIA",), ("",)], "path string")
    return search.resolve_path(paths, "path", [(t(spark, d, "region"), "r_name", "r_regionkey", None), (t(spark, d, "nation"), "n_name", "n_nationkey", "n_regionkey"),
                                               (t(spark, d, "customer"), "c_name", "c_custkey", "c_nationkey")])


def page_note(spark, d):
    return paging.page_note(_found(spark, d), 20, 40).unionByName(paging.page_note(_found(spark, d), 500, 0)).unionByName(paging.page_note(_found(spark, d), 10, 100000))


def object_card(spark, d):
    """One object's sections as rows (section, ord, text)."""
    part = _parts(spark, d).where("p_partkey = 7")
    items = t(spark, d, "lineitem").where("l_partkey = 7")
    head = part.select(F.lit("header").alias("section"), F.lit(0).cast("long").alias("ord"), F.concat_ws(" | ", "p_name", "p_brand", "p_type").alias("text"))
    props = part.select(F.lit("properties").alias("section"), F.posexplode(F.array(F.concat(F.lit("size="), F.col("p_size").cast("string")), F.concat(F.lit("brand="), F.col("p_brand")))).alias("ord", "text")).select("section", F.col("ord").cast("long"), "text")
    flags = items.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).select(F.lit("movements").alias("section"), F.ascii("l_returnflag").cast("long").alias("ord"), F.concat_ws("=", "l_returnflag", F.col("n").cast("string")).alias("text"))
    refs = items.select("l_suppkey").distinct().orderBy("l_suppkey").limit(12).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.lit("references").alias("section"), F.col("l_suppkey").alias("ord"), F.col("s_name").alias("text"))
    counts = items.agg(F.count(F.lit(1)).alias("n")).select(F.lit("counts").alias("section"), F.lit(0).cast("long").alias("ord"), F.col("n").cast("string").alias("text"))
    return head.unionByName(props).unionByName(flags).unionByName(refs).unionByName(counts)


# presets: fixed questions with bound parameters


def preset_composition(spark, d):
    return _parts(spark, d).groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "p_type")


def preset_objects_by_name(spark, d):
    return _parts(spark, d).where(F.col("p_name").ilike("%BLUE%")).orderBy("p_name", "p_partkey").limit(50).select("p_partkey", "p_name")


def preset_modules(spark, d):
    return t(spark, d, "conversations").where("conv_id = 3").select("turn", "role", F.length("text").cast("long").alias("size")).orderBy("turn")


def preset_children(spark, d):
    region = t(spark, d, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    return t(spark, d, "nation").join(region, "n_regionkey", "left_semi").select("n_nationkey", "n_name").orderBy("n_name")


def preset_module_text(spark, d):
    return t(spark, d, "conversations").where("conv_id = 3 AND turn = 1").select("role", "text")


def preset_methods(spark, d):
    c = t(spark, d, "customer").where("c_custkey BETWEEN 10 AND 14")
    o = c.join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return o.join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("c_custkey", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy("o_orderkey", "l_linenumber")


def preset_method_body(spark, d):
    return t(spark, d, "documents").where("doc_id = 5").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", "text", "quality")


def preset_report_queries(spark, d):
    return t(spark, d, "documents").where(F.instr("text", "Apache License") > 0).select("doc_id", F.left("text", F.lit(40)).alias("head")).orderBy("doc_id")


def preset_attributes(spark, d):
    return t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", "s_name").orderBy("n_name", "s_suppkey")


def preset_attribute_links(spark, d):
    left = t(spark, d, "documents").select("doc_id", "source")
    return left.join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", F.coalesce(F.col("toxic").cast("string"), F.lit("(none)")).alias("target"))


def preset_path_to_root(spark, d):
    return T.ancestors(tree(spark, d), F.col("id") == 10042, most=4).orderBy("steps").select("steps", "node", "name")


def preset_tree(spark, d):
    return T.subtree(tree(spark, d), F.col("parent_id").isNull(), 1).orderBy("sort_key").limit(200).select("level", "name", "sort_key")


def preset_role_rights(spark, d):
    """Rights of one role with what they are on."""
    r = rights(spark, d).where("role = 7")
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("right_no"), "s_name")
    kind = F.when(F.col("sub_index").isNotNull(), "field").otherwise("object")
    return r.join(s, "right_no", "left").select("target", kind.alias("kind"), F.coalesce("s_name", F.lit("-")).alias("owner"), "value", "event_id").orderBy("target", "kind", "event_id")


def preset_object_rights(spark, d):
    return rights(spark, d).where("target = 'click' and right_no = 4").select("role", "sub_index", "flags", "value", "event_id").orderBy("role", F.col("sub_index").asc_nulls_first(), "event_id")


def preset_rights_state(spark, d):
    per = rights(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n_rights"), F.count_distinct("target").alias("n_targets"), F.count("rls").alias("n_rls"))
    return per.orderBy(F.col("n_rls").desc(), "n_targets", F.col("role").desc())


QUERIES = {f.__name__: f for f in (
    preset_path_to_root, preset_tree, preset_role_rights, preset_object_rights, preset_rights_state,
    find_objects, find_objects_typed, find_field, search_total, resolve_path, page_note, object_card, preset_composition, preset_objects_by_name, preset_modules,
    preset_children, preset_module_text, preset_methods, preset_method_body, preset_report_queries, preset_attributes, preset_attribute_links)}

SQL = {
    "preset_path_to_root": f"""WITH RECURSIVE {TREE_SQL}, up AS (SELECT 0 AS steps, id AS node, name, parent_id FROM tree WHERE id = 10042
        UNION ALL SELECT up.steps + 1, t.id, t.name, t.parent_id FROM up JOIN tree t ON t.id = up.parent_id) SELECT steps, node, name FROM up""",
    "preset_tree": f"""WITH {TREE_SQL}, k AS (SELECT *, lpad(coalesce(ord, 99999999)::VARCHAR, 8, '0') || lpad(id::VARCHAR, 12, '0') AS piece FROM tree)
        SELECT * FROM (SELECT 0 AS level, name, piece AS sort_key FROM k WHERE parent_id IS NULL UNION ALL SELECT 1, c.name, p.piece || c.piece FROM k c JOIN k p ON c.parent_id = p.id WHERE p.parent_id IS NULL) ORDER BY sort_key LIMIT 200""",
    "preset_role_rights": f"""WITH {RIGHTS_SQL} SELECT target, CASE WHEN sub_index IS NULL THEN 'object' ELSE 'field' END AS kind, coalesce(s_name, '-') AS owner, value, event_id
        FROM rights LEFT JOIN supplier ON s_suppkey = right_no WHERE role = 7""",
    "preset_object_rights": f"WITH {RIGHTS_SQL} SELECT role, sub_index, flags, value, event_id FROM rights WHERE target = 'click' AND right_no = 4",
    "preset_rights_state": f"WITH {RIGHTS_SQL} SELECT role, count(*) AS n_rights, count(DISTINCT target) AS n_targets, count(rls) AS n_rls FROM rights GROUP BY role",
    "find_objects": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ring') ORDER BY length(p_name), p_name, p_partkey LIMIT 20",
    "find_objects_typed": "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE (contains(lower(replace(p_name, ' ', '')), 'brand#1') OR contains(lower(replace(p_brand, ' ', '')), 'brand#1')) AND lower(p_type) = 'economy' ORDER BY length(p_name), p_name, p_partkey LIMIT 50 OFFSET 10",
    "find_field": "SELECT n_name, c_name, c_custkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name), '#00000001') ORDER BY n_name, c_name, c_custkey LIMIT 100 OFFSET 5",
    "search_total": "SELECT count(*) AS total FROM part WHERE contains(lower(p_name), 'ring')",
    "resolve_path": """
        WITH p(path) AS (VALUES ('AFRICA.Nation_0.Customer#000000004'), ('america . nation_1'), ('ASIA.NATION_2.Customer#999999999'), ('NOWHERE.NATION_0'), ('EUROPE.NATION_0'), ('ASIA'), ('')),
        s AS (SELECT path, string_split(lower(replace(path, ' ', '')), '.') AS x FROM p)
        SELECT path, r_regionkey AS key_1, n_nationkey AS key_2, c_custkey AS key_3 FROM s
        LEFT JOIN region ON lower(r_name) = x[1] LEFT JOIN nation ON n_regionkey = r_regionkey AND lower(n_name) = x[2]
        LEFT JOIN customer ON c_nationkey = n_nationkey AND lower(c_name) = x[3]""",
    "page_note": """
        WITH c AS (SELECT count(*) AS total FROM part WHERE contains(lower(p_name), 'ring')), q(o, l) AS (VALUES (40, 20), (0, 200), (100000, 10))
        SELECT total, CASE WHEN total > o THEN o + 1 ELSE 0 END AS first, CASE WHEN total > o THEN least(total, o + l) ELSE 0 END AS last,
               CASE WHEN least(total, o + l) < total THEN least(total, o + l) END AS next_offset FROM c, q""",
    "object_card": """
        SELECT 'header' AS section, 0::BIGINT AS ord, p_name || ' | ' || p_brand || ' | ' || p_type AS text FROM part WHERE p_partkey = 7
        UNION ALL SELECT 'properties', 0, 'size=' || p_size FROM part WHERE p_partkey = 7
        UNION ALL SELECT 'properties', 1, 'brand=' || p_brand FROM part WHERE p_partkey = 7
        UNION ALL SELECT 'movements', ascii(l_returnflag), l_returnflag || '=' || count(*) FROM lineitem WHERE l_partkey = 7 GROUP BY l_returnflag
        UNION ALL SELECT 'references', s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey = 7 ORDER BY l_suppkey LIMIT 12)
        UNION ALL SELECT 'counts', 0, count(*)::VARCHAR FROM lineitem WHERE l_partkey = 7""",
    "preset_composition": "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type",
    "preset_objects_by_name": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%blue%' ORDER BY p_name, p_partkey LIMIT 50",
    "preset_modules": "SELECT turn, role, length(text) AS size FROM conversations WHERE conv_id = 3 ORDER BY turn",
    "preset_children": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') ORDER BY n_name",
    "preset_module_text": "SELECT role, text FROM conversations WHERE conv_id = 3 AND turn = 1",
    "preset_methods": "SELECT c_custkey, o_orderkey, l_linenumber, l_partkey, l_suppkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_custkey BETWEEN 10 AND 14 ORDER BY o_orderkey, l_linenumber",
    "preset_method_body": "SELECT doc_id, text, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id = 5",
    "preset_report_queries": "SELECT doc_id, left(text, 40) AS head FROM documents WHERE instr(text, 'Apache License') > 0 ORDER BY doc_id",
    "preset_attributes": "SELECT n_name, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY n_name, s_suppkey",
    "preset_attribute_links": "SELECT doc_id, source, coalesce(toxic::VARCHAR, '(none)') AS target FROM documents LEFT JOIN labels USING (doc_id)",
}
