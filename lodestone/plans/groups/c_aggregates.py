"""Group C: aggregates, statistics, samples and load-time derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import rights as R
from lodestone.operators import sampling
from lodestone.operators import tree as T
from lodestone.operators.search import ranked_first
from lodestone.plans.tables import RIGHTS_SQL, rights, t

KEY = ["target", "right_no", "sub_index", "flags"]


def composition(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def db_stats(spark, d):
    names = ["region", "nation", "customer", "part"]
    out = None
    for n in names:
        one = t(spark, d, n).agg(F.count(F.lit(1)).alias(f"n_{n}"))
        out = one if out is None else out.join(one)
    return out.join(t(spark, d, "customer").agg(F.count_distinct("c_mktsegment").alias("n_segments")))


def load_stats(spark, d):
    names = ["customer", "supplier", "orders", "lineitem", "events", "documents", "pages"]
    out = None
    for n in names:
        one = t(spark, d, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def flag_ambiguous(spark, d):
    return R.ambiguous(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


def role_rights(spark, d):
    """The flagship: targets of every role, by the full key (flags included)."""
    return R.targets(rights(spark, d), ["role", *KEY], "sub_index").select("role", *KEY, "n_rights", "resolved")


def role_rights_stats(spark, d):
    return R.target_stats(rights(spark, d), ["role", *KEY], "sub_index", "rls")


def exchange_content(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.max("l_shipdate").alias("last")).orderBy(F.col("n").desc())


def declared_vs_actual(spark, d):
    """Declared numbers against those found, over both sides."""
    declared = t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("declared"))
    actual = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("actual"))
    both = declared.join(actual, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    return both.select(F.coalesce("o_orderkey", "l_orderkey").alias("key"), F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("actual", F.lit(0)).alias("actual")).where("declared <> actual")


def systematic_sample(spark, d):
    return sampling.systematic_sample(t(spark, d, "part"), "p_partkey", "p_type", 100)


def dedup_first(spark, d):
    return ranked_first(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def first_position(spark, d):
    return T.first_position(t(spark, d, "benchmark"), "item_id", F.split(F.lower("text"), " ")).select("item_id", "item", F.col("ord").cast("long").alias("ord"))


def code_decode(spark, d):
    codes = F.create_map(*(F.lit(x) for pair in (("P", "pending"), ("O", "open"), ("F", "final")) for x in pair))
    period = F.when(F.month("o_orderdate") == 12, "year").when(F.month("o_orderdate") % 3 == 0, "quarter").otherwise("month")
    version = F.concat_ws(".", F.substring(F.year("o_orderdate").cast("string"), 1, 1), F.substring(F.year("o_orderdate").cast("string"), 2, 1), F.substring(F.year("o_orderdate").cast("string"), 3, 2).cast("int").cast("string"))
    return t(spark, d, "orders").select("o_orderkey", codes[F.col("o_orderstatus")].alias("status"), period.alias("period"), version.alias("version"))


def flag_list(spark, d):
    """Positions that are set, as one list; null where none is."""
    names = ["server", "external", "thick", "thin", "call"]
    text = F.concat_ws(",", *(F.when(F.col("p_size").bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)))
    return t(spark, d, "part").select("p_partkey", F.nullif(text, F.lit("")).alias("context"))


QUERIES = {f.__name__: f for f in (composition, db_stats, load_stats, flag_ambiguous, role_rights, role_rights_stats, exchange_content, declared_vs_actual, systematic_sample,
                                   dedup_first, first_position, code_decode, flag_list)}
_K = "target, right_no, sub_index, flags"
SQL = {
    "composition": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "db_stats": "SELECT (SELECT count(*) FROM region) AS n_region, (SELECT count(*) FROM nation) AS n_nation, (SELECT count(*) FROM customer) AS n_customer, (SELECT count(*) FROM part) AS n_part, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS n_segments",
    "load_stats": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ("customer", "supplier", "orders", "lineitem", "events", "documents", "pages")),
    "flag_ambiguous": "SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS n_flags FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1",
    "role_rights": f"WITH {RIGHTS_SQL} SELECT role, {_K}, count(*) AS n_rights, max((sub_index IS NOT NULL)::INTEGER) AS resolved FROM rights GROUP BY role, {_K}",
    "role_rights_stats": f"""WITH {RIGHTS_SQL}, p AS (SELECT max((sub_index IS NOT NULL)::INTEGER) AS ok, count(*) AS n, count(rls) AS r, count(*) FILTER (length(rls) > 600) AS l FROM rights GROUP BY role, {_K})
        SELECT count(*) AS targets, count(*) FILTER (ok = 1) AS resolved, count(*) FILTER (ok = 0) AS unresolved, sum(n)::BIGINT AS rights, sum(r)::BIGINT AS with_rls, sum(l)::BIGINT AS long_rls FROM p""",
    "exchange_content": "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2",
    "declared_vs_actual": """SELECT coalesce(o_orderkey, l_orderkey) AS key, coalesce(o_orderkey % 7, 0) AS declared, coalesce(actual, 0) AS actual
        FROM orders FULL JOIN (SELECT l_orderkey, count(*) AS actual FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE coalesce(o_orderkey % 7, 0) <> coalesce(actual, 0)""",
    "systematic_sample": """
        WITH p AS (SELECT p_partkey, p_type, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part),
        s AS (SELECT p_partkey, p_type FROM p WHERE floor(i * 100 / n) <> floor((i - 1) * 100 / n)),
        f AS (SELECT min(p_partkey) AS p_partkey, p_type FROM p WHERE p_type NOT IN (SELECT p_type FROM s) GROUP BY p_type)
        SELECT p_partkey, p_type FROM s UNION ALL SELECT p_partkey, p_type FROM f""",
    "dedup_first": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS r FROM lineitem) WHERE r = 1",
    "first_position": """WITH w AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS item, unnest(range(len(string_split(lower(text), ' ')))) AS pos FROM benchmark)
        SELECT item_id, item, min(pos) AS ord FROM w GROUP BY 1, 2""",
    "code_decode": """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' END AS status,
        CASE WHEN month(o_orderdate) = 12 THEN 'year' WHEN month(o_orderdate) % 3 = 0 THEN 'quarter' ELSE 'month' END AS period,
        substr(year(o_orderdate)::VARCHAR, 1, 1) || '.' || substr(year(o_orderdate)::VARCHAR, 2, 1) || '.' || substr(year(o_orderdate)::VARCHAR, 3, 2)::INTEGER::VARCHAR AS version FROM orders""",
    "flag_list": """SELECT p_partkey, nullif(concat_ws(',', CASE WHEN p_size & 1 <> 0 THEN 'server' END, CASE WHEN p_size & 2 <> 0 THEN 'external' END, CASE WHEN p_size & 4 <> 0 THEN 'thick' END,
        CASE WHEN p_size & 8 <> 0 THEN 'thin' END, CASE WHEN p_size & 16 <> 0 THEN 'call' END), '') AS context FROM part""",
}
