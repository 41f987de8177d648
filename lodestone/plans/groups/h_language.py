"""Group H: the query language, run on the driver tables, and SQL access."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lodestone.ql import checker
from lodestone.ql.batch import check_texts
from lodestone.ql.to_sql import Mapping, run
from lodestone.sql_access import rewrite_paths, run_sql
from lodestone.plans.tables import t, tree

TABLES = {"Справочник.Детали": "part", "Справочник.Клиенты": "customer", "Справочник.Страны": "nation", "Справочник.Регионы": "region",
          "Справочник.Поставщики": "supplier", "Документ.Заказ": "orders", "Документ.Заказ.Строки": "lineitem", "РегистрСведений.События": "events"}
REFS = {("orders", "o_custkey"): ("customer", "c_custkey"), ("customer", "c_nationkey"): ("nation", "n_nationkey"), ("nation", "n_regionkey"): ("region", "r_regionkey"),
        ("lineitem", "l_partkey"): ("part", "p_partkey"), ("lineitem", "l_suppkey"): ("supplier", "s_suppkey")}

#: key -> (query text, parameters, the same in SQL)
LANGUAGE = {
    "ql_distinct_top": ("ВЫБРАТЬ РАЗЛИЧНЫЕ РАЗРЕШЕННЫЕ ПЕРВЫЕ 4 Т.p_type КАК p_type ИЗ Справочник.Детали КАК Т УПОРЯДОЧИТЬ ПО p_type УБЫВ", {}, "SELECT DISTINCT p_type FROM part ORDER BY p_type DESC LIMIT 4"),
    "ql_temp_table": ("ВЫБРАТЬ Т.o_custkey КАК k, КОЛИЧЕСТВО(*) КАК n ПОМЕСТИТЬ ВТ ИЗ Документ.Заказ КАК Т СГРУППИРОВАТЬ ПО Т.o_custkey; ВЫБРАТЬ ВТ.n КАК n, КОЛИЧЕСТВО(*) КАК m ИЗ ВТ КАК ВТ СГРУППИРОВАТЬ ПО ВТ.n", {},
                      "SELECT n, count(*) AS m FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY n"),
    "ql_subquery": ("ВЫБРАТЬ В.s КАК s, МАКСИМУМ(В.k) КАК k ИЗ (ВЫБРАТЬ Т.o_orderstatus КАК s, Т.o_orderkey КАК k ИЗ Документ.Заказ Т ГДЕ Т.o_totalprice > 400000) КАК В СГРУППИРОВАТЬ ПО В.s", {},
                    "SELECT o_orderstatus AS s, max(o_orderkey) AS k FROM orders WHERE o_totalprice > 400000 GROUP BY 1"),
    "ql_join_inner": ("ВЫБРАТЬ К.c_name, С.n_name ИЗ Справочник.Клиенты КАК К ВНУТРЕННЕЕ СОЕДИНЕНИЕ Справочник.Страны КАК С ПО К.c_nationkey = С.n_nationkey ГДЕ С.n_nationkey < 3", {}, "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 3"),
    "ql_join_left": ("ВЫБРАТЬ Д.p_partkey КАК p_partkey, С.l_orderkey КАК l_orderkey ИЗ Справочник.Детали КАК Д ЛЕВОЕ ВНЕШНЕЕ СОЕДИНЕНИЕ Документ.Заказ.Строки КАК С ПО Д.p_partkey = С.l_partkey И С.l_quantity > 49 ГДЕ Д.p_size = 1", {},
                     "SELECT p_partkey, l_orderkey FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 49 WHERE p_size = 1"),
    "ql_join_right": ("ВЫБРАТЬ П.s_name, С.n_name ИЗ Справочник.Поставщики КАК П ПРАВОЕ СОЕДИНЕНИЕ Справочник.Страны КАК С ПО П.s_nationkey = С.n_nationkey И П.s_acctbal > 5000", {}, "SELECT s_name, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000"),
    "ql_join_full": ("ВЫБРАТЬ П.s_suppkey, К.c_custkey ИЗ Справочник.Поставщики КАК П ПОЛНОЕ СОЕДИНЕНИЕ Справочник.Клиенты КАК К ПО П.s_suppkey = К.c_custkey И К.c_acctbal > 3000", {}, "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 3000"),
    "ql_join_cross": ("ВЫБРАТЬ Р.r_name, С.n_name ИЗ Справочник.Регионы КАК Р, Справочник.Страны КАК С ГДЕ С.n_nationkey < 4", {}, "SELECT r_name, n_name FROM region, nation WHERE n_nationkey < 4"),
    "ql_join_nested": ("ВЫБРАТЬ Р.r_name, С.n_name, П.s_name ИЗ Справочник.Регионы КАК Р ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Страны КАК С ВНУТРЕННЕЕ СОЕДИНЕНИЕ Справочник.Поставщики КАК П ПО С.n_nationkey = П.s_nationkey ПО Р.r_regionkey = С.n_regionkey И П.s_acctbal < 0", {},
                       "SELECT r_name, n_name, s_name FROM region LEFT JOIN (nation JOIN supplier ON n_nationkey = s_nationkey) ON r_regionkey = n_regionkey AND s_acctbal < 0"),
    "ql_having": ("ВЫБРАТЬ Т.o_custkey, КОЛИЧЕСТВО(*) КАК n ИЗ Документ.Заказ КАК Т СГРУППИРОВАТЬ ПО Т.o_custkey ИМЕЮЩИЕ КОЛИЧЕСТВО(*) > 15", {}, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "ql_grouping_sets": ("ВЫБРАТЬ Т.p_type, Т.p_brand, КОЛИЧЕСТВО(*) КАК n ИЗ Справочник.Детали КАК Т СГРУППИРОВАТЬ ПО ГРУППИРУЮЩИМ НАБОРАМ ((Т.p_type), (Т.p_type, Т.p_brand), ())", {}, "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_type), (p_type, p_brand), ())"),
    "ql_order": ("ВЫБРАТЬ ПЕРВЫЕ 30 Т.c_mktsegment, Т.c_name ИЗ Справочник.Клиенты КАК Т УПОРЯДОЧИТЬ ПО Т.c_mktsegment УБЫВ, Т.c_name ВОЗР АВТОУПОРЯДОЧИВАНИЕ", {}, "SELECT c_mktsegment, c_name FROM customer ORDER BY c_mktsegment DESC, c_name LIMIT 30"),
    "ql_totals": ("ВЫБРАТЬ Т.p_type КАК p_type, Т.p_brand КАК p_brand, КОЛИЧЕСТВО(*) КАК n ИЗ Справочник.Детали КАК Т СГРУППИРОВАТЬ ПО Т.p_type, Т.p_brand ИТОГИ СУММА(n) ПО ОБЩИЕ, p_type", {},
                  "WITH g AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, p_brand, n, 0 AS totals_level FROM g UNION ALL SELECT NULL, NULL, sum(n)::BIGINT, 1 FROM g UNION ALL SELECT p_type, NULL, sum(n)::BIGINT, 2 FROM g GROUP BY p_type"),
    "ql_periods": ("ВЫБРАТЬ НАЧАЛОПЕРИОДА(Т.o_orderdate, ПОЛУГОДИЕ) КАК h, НАЧАЛОПЕРИОДА(Т.o_orderdate, ДЕКАДА) КАК d, КОНЕЦПЕРИОДА(Т.o_orderdate, КВАРТАЛ) КАК q, КОЛИЧЕСТВО(*) КАК n ИЗ Документ.Заказ КАК Т ГДЕ Т.o_orderdate МЕЖДУ &С И &По "
                   "СГРУППИРОВАТЬ ПО НАЧАЛОПЕРИОДА(Т.o_orderdate, ПОЛУГОДИЕ), НАЧАЛОПЕРИОДА(Т.o_orderdate, ДЕКАДА), КОНЕЦПЕРИОДА(Т.o_orderdate, КВАРТАЛ)", {"С": datetime(1996, 1, 1), "По": datetime(1997, 12, 31)},
                   "SELECT date_trunc('year', o_orderdate) + to_months((6 * ((month(o_orderdate) - 1) // 6))::INTEGER) AS h, (date_trunc('month', o_orderdate) + to_days((10 * least(2, (day(o_orderdate) - 1) // 10))::INTEGER))::TIMESTAMP AS d, "
                   "date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 SECOND AS q, count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1, 2, 3"),
    "ql_union": ("ВЫБРАТЬ Т.c_nationkey КАК k ИЗ Справочник.Клиенты КАК Т ОБЪЕДИНИТЬ ВЫБРАТЬ Т.s_nationkey ИЗ Справочник.Поставщики КАК Т", {}, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "ql_union_all": ("ВЫБРАТЬ Т.r_name КАК k ИЗ Справочник.Регионы КАК Т ОБЪЕДИНИТЬ ВСЕ ВЫБРАТЬ Т.n_name ИЗ Справочник.Страны КАК Т ОБЪЕДИНИТЬ ВСЕ ВЫБРАТЬ Т.r_name ИЗ Справочник.Регионы КАК Т", {}, "SELECT r_name AS k FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region"),
    "ql_predicates": ("ВЫБРАТЬ Т.p_partkey ИЗ Справочник.Детали КАК Т ГДЕ Т.p_size >= 10 И НЕ Т.p_size > 12 ИЛИ Т.p_type = \"PROMO\" И Т.p_size <> 3 И Т.p_size < 5", {}, "SELECT p_partkey FROM part WHERE p_size >= 10 AND NOT p_size > 12 OR p_type = 'PROMO' AND p_size <> 3 AND p_size < 5"),
    "ql_in": ("ВЫБРАТЬ Т.p_partkey ИЗ Справочник.Детали КАК Т ГДЕ Т.p_size В (1, 2, &Р) И Т.p_partkey В (ВЫБРАТЬ С.l_partkey ИЗ Документ.Заказ.Строки КАК С ГДЕ С.l_quantity > 45)", {"Р": 7}, "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 7) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"),
    "ql_not_in": ("ВЫБРАТЬ Т.c_custkey ИЗ Справочник.Клиенты КАК Т ГДЕ Т.c_custkey НЕ В (ВЫБРАТЬ З.o_custkey ИЗ Документ.Заказ КАК З ГДЕ З.o_orderstatus = 'P')", {}, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "ql_tuple_in": ("ВЫБРАТЬ РАЗЛИЧНЫЕ Т.l_orderkey ИЗ Документ.Заказ.Строки КАК Т ГДЕ (Т.l_partkey, Т.l_suppkey) В (ВЫБРАТЬ У.l_partkey, У.l_suppkey ИЗ Документ.Заказ.Строки КАК У ГДЕ У.l_orderkey < 5)", {}, "SELECT DISTINCT l_orderkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey < 5)"),
    "ql_in_hierarchy": ("ВЫБРАТЬ Т.id, Т.name ИЗ Справочник.Дерево КАК Т ГДЕ Т.id В ИЕРАРХИИ (&Г, 3)", {"Г": 1004}, "SELECT n_nationkey::BIGINT + 1000 AS id, n_name AS name FROM nation WHERE n_regionkey = 3 OR n_nationkey = 4 UNION SELECT c_custkey + 10000, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3 OR n_nationkey = 4 UNION SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 3"),
    "ql_between": ("ВЫБРАТЬ Т.p_partkey ИЗ Справочник.Детали КАК Т ГДЕ Т.p_size МЕЖДУ 3 И 5 И Т.p_partkey НЕ МЕЖДУ 100 И 1800", {}, "SELECT p_partkey FROM part WHERE p_size BETWEEN 3 AND 5 AND p_partkey NOT BETWEEN 100 AND 1800"),
    "ql_like_escape": ("ВЫБРАТЬ Т.n_name ИЗ Справочник.Страны КАК Т ГДЕ Т.n_name ПОДОБНО \"NATION|_1%\" СПЕЦСИМВОЛ \"|\" И Т.n_name НЕ ПОДОБНО \"%2\"", {}, "SELECT n_name FROM nation WHERE n_name LIKE 'NATION|_1%' ESCAPE '|' AND n_name NOT LIKE '%2'"),
    "ql_is_null": ("ВЫБРАТЬ С.n_name ИЗ Справочник.Страны КАК С ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Поставщики КАК П ПО С.n_nationkey = П.s_nationkey И П.s_acctbal > 8000 ГДЕ П.s_suppkey ЕСТЬ NULL И С.n_name ЕСТЬ НЕ NULL", {}, "SELECT n_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 8000 WHERE s_suppkey IS NULL AND n_name IS NOT NULL"),
    "ql_arith": ("ВЫБРАТЬ Т.p_partkey КАК k, (Т.p_size + 2) * 3 - -1 КАК a, ВЫРАЗИТЬ(Т.p_size / (Т.p_size - 1) КАК Число(10, 3)) КАК b ИЗ Справочник.Детали КАК Т", {}, "SELECT p_partkey AS k, (p_size + 2) * 3 + 1 AS a, round(p_size / nullif(p_size - 1, 0), 3)::DECIMAL(10, 3) AS b FROM part"),
    "ql_case": ("ВЫБРАТЬ Т.p_partkey КАК k, ВЫБОР КОГДА Т.p_size < 10 ТОГДА 'small' КОГДА Т.p_size < 30 ТОГДА 'middle' ИНАЧЕ 'large' КОНЕЦ КАК a, ВЫБОР Т.p_type КОГДА 'PROMO' ТОГДА 1 КОНЕЦ КАК b ИЗ Справочник.Детали КАК Т", {}, "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS a, CASE p_type WHEN 'PROMO' THEN 1 END AS b FROM part"),
    "ql_cast": ("ВЫБРАТЬ ВЫРАЗИТЬ(Т.p_size КАК Строка(10)) КАК s, ВЫРАЗИТЬ(Т.p_partkey КАК Число(10, 2)) КАК n ИЗ Справочник.Детали КАК Т", {}, "SELECT p_size::VARCHAR AS s, p_partkey::DECIMAL(10, 2) AS n FROM part"),
    "ql_aggregates": ("ВЫБРАТЬ Т.p_type КАК t, СУММА(Т.p_size) КАК a, КОЛИЧЕСТВО(РАЗЛИЧНЫЕ Т.p_brand) КАК b, МИНИМУМ(Т.p_name) КАК c, МАКСИМУМ(Т.p_name) КАК d, ВЫРАЗИТЬ(СРЕДНЕЕ(Т.p_size) КАК Число(12, 4)) КАК e ИЗ Справочник.Детали КАК Т СГРУППИРОВАТЬ ПО Т.p_type", {},
                      "SELECT p_type AS t, sum(p_size)::BIGINT AS a, count(DISTINCT p_brand) AS b, min(p_name) AS c, max(p_name) AS d, round(avg(p_size), 4)::DECIMAL(12, 4) AS e FROM part GROUP BY 1"),
    "ql_deref": ("ВЫБРАТЬ З.o_custkey.c_nationkey.n_regionkey.r_name КАК r, З.o_custkey.c_mktsegment КАК m, КОЛИЧЕСТВО(*) КАК n ИЗ Документ.Заказ КАК З СГРУППИРОВАТЬ ПО З.o_custkey.c_nationkey.n_regionkey.r_name, З.o_custkey.c_mktsegment", {},
                 "SELECT r_name AS r, c_mktsegment AS m, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "ql_scalar_subquery": ("ВЫБРАТЬ Т.p_partkey КАК k ИЗ Справочник.Детали КАК Т ГДЕ Т.p_retailprice > (ВЫБРАТЬ СРЕДНЕЕ(У.p_retailprice) ИЗ Справочник.Детали КАК У)", {}, "SELECT p_partkey AS k FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)"),
    "ql_braces": ("ВЫБРАТЬ Т.r_name КАК r {ВЫБРАТЬ Т.r_regionkey} ИЗ Справочник.Регионы КАК Т {ГДЕ Т.r_name = &П} ГДЕ Т.r_regionkey > 1 ИНДЕКСИРОВАТЬ ПО Т.r_name", {}, "SELECT r_name AS r FROM region WHERE r_regionkey > 1"),
}


def _mapping(spark, d):
    for name in set(TABLES.values()):
        t(spark, d, name).createOrReplaceTempView(name)
    nodes = tree(spark, d)
    nodes.createOrReplaceTempView("tree")
    up = nodes.select(F.col("id").alias("node"), F.col("parent_id").alias("up"))
    level = up.select("node", F.col("node").alias("ancestor"))
    closure = level
    for _ in range(2):
        level = level.join(up.select(F.col("node").alias("ancestor"), "up"), "ancestor").where("up is not null").select("node", F.col("up").alias("ancestor"))
        closure = closure.unionByName(level)
    closure.createOrReplaceTempView("tree_closure")
    return Mapping({**TABLES, "Справочник.Дерево": "tree"}, REFS, {"tree": "tree_closure"})


def _language(key):
    def query(spark, d):
        text, params, _ = LANGUAGE[key]
        return run(spark, text, _mapping(spark, d), params)

    query.__name__ = key
    return query


def context() -> checker.Context:
    """What the check knows about the driver tables."""
    columns = {"Детали": "p_partkey p_name p_brand p_type p_size p_retailprice", "Клиенты": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "Страны": "n_nationkey n_name n_regionkey"}
    return checker.Context.from_rows([(f"Catalog/{n}", "Catalog", n) for n in columns], [(f"Catalog/{n}", c, None) for n, cs in columns.items() for c in cs.split()], refs=[("Catalog/Клиенты", "c_nationkey", "Catalog/Страны")])


def _texts(spark, d):
    """Stored query texts, some of them wrong, made from the parts' names."""
    field = F.when(F.col("p_size") % 3 == 0, "p_wrong").otherwise("p_name")
    table = F.when(F.col("p_size") % 5 == 0, "Нет").otherwise("Детали")
    tail = F.when(F.col("p_size") % 7 == 0, " ГДЕ").otherwise("")
    return t(spark, d, "part").select("p_partkey", F.concat(F.lit("ВЫБРАТЬ Т."), field, F.lit(" ИЗ Справочник."), table, F.lit(" КАК Т"), tail).alias("query"))


def check_query(spark, d):
    rows = [(n, e) for n, q in enumerate(["ВЫБРАТЬ Т.c_nationkey.n_name ИЗ Справочник.Клиенты КАК Т", "ВЫБРАТЬ Т.bad ИЗ Справочник.Клиенты КАК Т", "ВЫБРАТЬ 1 ИЗ Справочник.Нет", "ВЫБРАТЬ Т.Х ИЗ"])
            for e in checker.check(q, context()).errors or [None]]
    return spark.createDataFrame(rows, "n int, error string").select("n", F.when(F.col("error").isNull(), "ok").otherwise(F.substring_index("error", " ", 1)).alias("verdict"))


def check_stored_queries(spark, d):
    found = check_texts(_texts(spark, d), "p_partkey", "query", context())
    return found.groupBy("p_partkey").agg(F.count("error").alias("n_errors"))


def sql_passthrough(spark, d):
    _mapping(spark, d)
    return run_sql(spark, "WITH s AS (SELECT c_mktsegment AS m, c_nationkey AS k FROM customer) SELECT m, k, count(*) AS n FROM s GROUP BY m, k ORDER BY m, k", limit=100)


def sql_rewrite(spark, d):
    t(spark, d, "customer").select("c_custkey", F.concat(F.lit("Catalog/"), "c_mktsegment").alias("path")).createOrReplaceTempView("paths")
    return run_sql(spark, rewrite_paths("SELECT c_custkey, path FROM paths WHERE path = 'Справочник.BUILDING' ORDER BY c_custkey"))


QUERIES = {key: _language(key) for key in LANGUAGE} | {f.__name__: f for f in (check_query, check_stored_queries, sql_passthrough, sql_rewrite)}
SQL = {key: sql for key, (_, _, sql) in LANGUAGE.items()} | {
    "check_query": "SELECT * FROM (VALUES (0, 'ok'), (1, 'неизвестное'), (2, 'неизвестная'), (3, 'синтаксис:')) t(n, verdict)",
    "check_stored_queries": "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 1 WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS n_errors FROM part",
    "sql_passthrough": "SELECT c_mktsegment AS m, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 100",
    "sql_rewrite": "SELECT c_custkey, 'Catalog/' || c_mktsegment AS path FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 200",
}
