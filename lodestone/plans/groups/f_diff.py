"""Group F: comparison of two bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import diff as D
from lodestone.operators import paging
from lodestone.plans.tables import t

SPLIT = "2000-01-01"


def _halves(spark, d):
    o = t(spark, d, "orders")
    return o.where(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp_ntz")), o.where(F.col("o_orderdate") >= F.lit(SPLIT).cast("timestamp_ntz"))


def _snapshot(o):
    """customer's priorities and statuses as sections with fingerprints."""
    one = o.groupBy(F.lit("attrs").alias("section"), "o_custkey", F.col("o_orderpriority").alias("key")).agg(F.sha1(F.count(F.lit(1)).cast("string")).alias("fp"))
    two = o.groupBy(F.lit("modules").alias("section"), "o_custkey", F.col("o_orderstatus").alias("key")).agg(F.sha1(F.max("o_orderkey").cast("string")).alias("fp"))
    return one.unionByName(two)


def snapshot_diff(spark, d):
    a, b = _halves(spark, d)
    out = D.snapshot_diff(_snapshot(a), _snapshot(b), ["section", "o_custkey", "key"], "fp")
    return paging.page(out, [D.section_order(F.col("section")), D.kind_order(F.col("kind")), "o_custkey", "key"], 150, 20)


def config_diff(spark, d):
    a, b = _halves(spark, d)
    return D.config_diff(a, b, "o_custkey", "o_orderkey")


def split_new(spark, d):
    a, b = _halves(spark, d)
    return D.split_new(b.select("o_custkey").distinct(), a, "o_custkey")


def split_borrowed(spark, d):
    a, b = _halves(spark, d)
    return D.split_borrowed(b.select("o_custkey").distinct(), a, "o_custkey")


def added_items(spark, d):
    a, b = _halves(spark, d)
    return D.added_items(b, a, "o_custkey", "o_orderpriority")


def ranked_match(spark, d):
    """A method of the same module first, else the first of the object."""
    calls = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("obj"), (F.col("o_orderkey") % 4).alias("module"))
    methods = t(spark, d, "customer").where("c_acctbal > 5000").select((F.col("c_custkey") % 50).alias("obj"), (F.col("c_nationkey") % 4).cast("long").alias("module"), "c_custkey")
    return D.ranked_match(calls, methods, ["obj"], "module", "c_custkey").select("o_orderkey", "obj", "module", "found_in", "found")


def fingerprint(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.length("text").cast("long").alias("size"))


def normalized_equal(spark, d):
    """Texts that differ in formatting only: groups of the same normal form."""
    n = t(spark, d, "documents").select("doc_id", "text", F.sha1(D.normalized(F.col("text"))).alias("form"))
    return n.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("n_texts"), F.min("doc_id").alias("first_doc")).where("n > 1")


def method_verdict(spark, d):
    a = t(spark, d, "conversations").where("turn = 0").select("conv_id", F.col("role").alias("ra"), F.col("text").alias("ta"))
    b = t(spark, d, "conversations").where("turn = 1").select("conv_id", F.col("role").alias("rb"), F.col("text").alias("tb"))
    both = a.join(b, "conv_id")
    return both.select("conv_id", D.verdict(kind=F.col("ra") != F.col("rb"), body=F.col("ta") != F.col("tb"), size=F.abs(F.length("ta") - F.length("tb")) > 300, first_word=F.substring_index("ta", " ", 1) != F.substring_index("tb", " ", 1)).alias("verdict"))


def source_fingerprint(spark, d):
    """Which sources must be read again: unknown, changed or unchanged by fingerprint."""
    new = t(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha"))
    known = new.where("page_id % 3 <> 0").select(F.col("page_id").alias("p"), F.when(F.col("page_id") % 7 == 0, F.reverse("sha")).otherwise(F.col("sha")).alias("old"))
    return new.join(known, F.col("page_id") == F.col("p"), "left").select("page_id", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("sha"), "skip").otherwise("changed").alias("state"))


QUERIES = {f.__name__: f for f in (snapshot_diff, config_diff, split_new, split_borrowed, added_items, ranked_match, fingerprint, normalized_equal, method_verdict, source_fingerprint)}

_H = f"a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT}'), b AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT}')"
_S = """(SELECT 'attrs' AS section, o_custkey, o_orderpriority AS key, sha1(count(*)::VARCHAR) AS fp FROM {x} GROUP BY 2, 3
  UNION ALL SELECT 'modules', o_custkey, o_orderstatus, sha1(max(o_orderkey)::VARCHAR) FROM {x} GROUP BY 2, 3)"""
SQL = {
    "snapshot_diff": f"""WITH {_H}, sa AS {_S.format(x='a')}, sb AS {_S.format(x='b')},
        j AS (SELECT coalesce(sa.section, sb.section) AS section, coalesce(sa.o_custkey, sb.o_custkey) AS o_custkey, coalesce(sa.key, sb.key) AS key,
              CASE WHEN sb.fp IS NULL THEN 'only_left' WHEN sa.fp IS NULL THEN 'only_right' WHEN sa.fp <> sb.fp THEN 'changed' END AS kind
              FROM sa FULL JOIN sb ON sa.section = sb.section AND sa.o_custkey = sb.o_custkey AND sa.key = sb.key)
        SELECT section, o_custkey, key, kind FROM j WHERE kind IS NOT NULL
        ORDER BY CASE section WHEN 'attrs' THEN 1 ELSE 3 END, CASE kind WHEN 'only_left' THEN 1 WHEN 'only_right' THEN 2 ELSE 3 END, o_custkey, key LIMIT 150 OFFSET 20""",
    "config_diff": f"""WITH {_H}, l AS (SELECT o_custkey, count(o_orderkey) AS n_left FROM a GROUP BY 1), r AS (SELECT o_custkey, count(o_orderkey) AS n_right FROM b GROUP BY 1)
        SELECT coalesce(l.o_custkey, r.o_custkey) AS o_custkey, n_left, n_right, CASE WHEN n_right IS NULL THEN 'only_left' WHEN n_left IS NULL THEN 'only_right' ELSE 'changed' END AS kind
        FROM l FULL JOIN r ON l.o_custkey = r.o_custkey WHERE n_left IS DISTINCT FROM n_right""",
    "split_new": f"WITH {_H} SELECT DISTINCT o_custkey FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)",
    "split_borrowed": f"WITH {_H} SELECT DISTINCT o_custkey FROM b WHERE o_custkey IN (SELECT o_custkey FROM a)",
    "added_items": f"WITH {_H}, n AS (SELECT DISTINCT o_custkey, o_orderpriority FROM b EXCEPT SELECT o_custkey, o_orderpriority FROM a) SELECT o_custkey, count(*) AS n_added, min(o_orderpriority) AS first_item FROM n GROUP BY 1",
    "ranked_match": """
        WITH c AS (SELECT o_orderkey, o_custkey % 50 AS obj, o_orderkey % 4 AS module FROM orders),
        m AS (SELECT c_custkey % 50 AS obj, (c_nationkey % 4)::BIGINT AS found_in, c_custkey AS found FROM customer WHERE c_acctbal > 5000)
        SELECT o_orderkey, obj, module, found_in, found FROM (SELECT c.*, found_in, found, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN found_in = module THEN 0 ELSE 1 END, found NULLS LAST) AS r
          FROM c LEFT JOIN m ON c.obj = m.obj) WHERE r = 1""",
    "fingerprint": "SELECT doc_id, sha1(text) AS sha1, length(text) AS size FROM documents",
    "normalized_equal": r"""SELECT sha1(lower(regexp_replace(regexp_replace(text, '//[^\n]*', '', 'g'), '\s+', '', 'g'))) AS form, count(*) AS n, count(DISTINCT text) AS n_texts, min(doc_id) AS first_doc
        FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "method_verdict": """SELECT conv_id, coalesce(nullif(concat_ws(', ', CASE WHEN a.role <> b.role THEN 'kind' END, CASE WHEN a.text <> b.text THEN 'body' END, CASE WHEN abs(length(a.text) - length(b.text)) > 300 THEN 'size' END,
        CASE WHEN string_split(a.text, ' ')[1] <> string_split(b.text, ' ')[1] THEN 'first_word' END), ''), 'unchanged') AS verdict
        FROM (SELECT * FROM conversations WHERE turn = 0) a JOIN (SELECT * FROM conversations WHERE turn = 1) b USING (conv_id)""",
    "source_fingerprint": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'new' WHEN page_id % 7 = 0 AND sha256(html) <> reverse(sha256(html)) THEN 'changed' ELSE 'skip' END AS state FROM pages""",
}
