"""Group G, second part: code analysis over module texts made from the driver tables.

The parsers are no SQL; queries that SQL can follow have an oracle, the others are tested
on fixtures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import code as K
from lodestone.plans.groups.h_language import context
from lodestone.plans.tables import t


def modules(spark, d):
    """One module text per part: a function that calls another part's, with a query."""
    p = t(spark, d, "part")
    export = F.when(F.col("p_partkey") % 2 == 0, " Экспорт").otherwise("")
    table = F.when(F.col("p_size") % 5 == 0, "Нет").otherwise("Детали")
    q = '"'
    text = F.concat(
        F.lit("// Модуль\n\n&НаСервере\nФункция Имя"), F.col("p_partkey").cast("string"), F.lit("(А, Знач Б = 1)"), export, F.lit("\n\tЕсли А Тогда\n\t\tВ = М"), (F.col("p_partkey") + 1).cast("string"), F.lit(".Имя"),
        (F.col("p_partkey") + F.when(F.col("p_size") % 3 == 0, 2).otherwise(1)).cast("string"), F.lit(f"(Б); // М1.Имя1()\n\tКонецЕсли;\n\tТ = {q}ВЫБРАТЬ Т.p_name ИЗ Справочник."), table, F.lit(f" КАК Т{q};\n\tВозврат Т;\nКонецФункции\n"))
    return p.select("p_partkey", F.concat(F.lit("М"), F.col("p_partkey").cast("string")).alias("module"), text.alias("text"))


def module_methods(spark, d):
    return K.methods(modules(spark, d), ["p_partkey"], "text").select("p_partkey", "kind", "name", "signature", "is_export", "directives", "line_start", "line_end")


def call_sites(spark, d):
    return K.call_facts(modules(spark, d), ["p_partkey"], "text").select("p_partkey", "line", "form", "left", "name", F.size("conditions").alias("n_conditions"))


def extract_literals(spark, d):
    return K.literal_rows(modules(spark, d), ["p_partkey"], "text").select("p_partkey", "line", "value")


def extract_queries(spark, d):
    return K.query_rows(modules(spark, d), ["p_partkey"], "text")


def dependency_state(spark, d):
    m = modules(spark, d)
    calls = K.call_facts(m, ["p_partkey"], "text")
    found = K.methods(m, ["module"], "text").select("module", "name", "is_export")
    return K.dependency_state(calls, m.select("module"), found).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_part"))


def query_violations(spark, d):
    return K.query_violations(modules(spark, d), ["p_partkey"], "text", context()).select("p_partkey", "line")


def method_result_schema(spark, d):
    return K.schema_rows(modules(spark, d), ["p_partkey"], "text")


QUERIES = {f.__name__: f for f in (module_methods, call_sites, extract_literals, extract_queries, dependency_state, query_violations, method_result_schema)}
_Q = "'ВЫБРАТЬ Т.p_name ИЗ Справочник.' || CASE WHEN p_size % 5 = 0 THEN 'Нет' ELSE 'Детали' END || ' КАК Т'"
SQL = {
    "module_methods": "SELECT p_partkey, 'функция' AS kind, 'Имя' || p_partkey AS name, 'А, Знач Б = 1' AS signature, p_partkey % 2 = 0 AS is_export, '&НаСервере' AS directives, 4 AS line_start, 10 AS line_end FROM part",
    "call_sites": "SELECT p_partkey, 6 AS line, 'dotted' AS form, 'М' || (p_partkey + 1) AS left, 'Имя' || (p_partkey + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END) AS name, 1 AS n_conditions FROM part",
    "extract_literals": f"SELECT p_partkey, 8 AS line, {_Q} AS value FROM part",
    "extract_queries": f"SELECT p_partkey, 8 AS line, {_Q} AS query, true AS complete FROM part",
    "dependency_state": """SELECT CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN 'unknown_module' WHEN p_size % 3 = 0 THEN 'missing_method' WHEN p_partkey % 2 = 0 THEN 'not_export' ELSE 'ok' END AS state, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1""",
    "query_violations": "SELECT p_partkey, 7 AS line FROM part WHERE p_size % 5 = 0",
    "method_result_schema": "SELECT p_partkey, 'query column' AS kind, 'p_name' AS name, 8 AS line FROM part",
}
