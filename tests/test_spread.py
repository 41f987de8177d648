"""Steps that must not stay in one task, or gather their rows on the driver."""

from pyspark.sql import functions as F

from lodestone.functions import code as C
from lodestone.operators import code as K
from lodestone.operators import needles, scopes
from lodestone.ql.batch import check_texts
from lodestone.plans.groups.g_code import context

TEXT = 'Процедура А()\n\tМ1.Б("а\n\t|б");\n\tВ = "ВЫБРАТЬ 1 ИЗ Т";\nКонецПроцедуры\n'


def test_parsing_is_dealt_to_tasks(spark):
    one = spark.range(400).coalesce(1).select("id", F.lit(TEXT).alias("text"))  # a small file is one split
    for found in (K.call_facts(one, ["id"], "text"), K.literal_rows(one, ["id"], "text"), K.methods(one, ["id"], "text"), check_texts(one, "id", "text", context())):
        rows = found.select("id", F.spark_partition_id().alias("task")).collect()
        assert {r.id for r in rows} == set(range(400)) and len({r.task for r in rows}) > 1


def test_literals_are_those_of_the_lexer():
    for text in (TEXT, '"a""b\n  |c" x="un\n', '"', '// "c\n"d"\r\n"e\r"', '"a\r\n|b";\n\n"c"', ""):
        assert C.literals(text) == [(x.start, x.line, x.value.replace("\r", "")) for x in C.lexemes(text) if x.kind == "literal" and x.closed]


def test_pins_are_not_gathered_on_the_driver(spark):
    bases = spark.range(50).select(F.col("id").cast("string").alias("alias"), F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"))
    pins = bases.select(F.col("alias").alias("pin"), F.expr("left(fingerprint, 1 + cast(alias AS int) % 9)").alias("prefix"))
    found = scopes.resolve_pins(pins, bases)
    rows = found.collect()
    assert len(rows) == 50 and {r.state for r in rows} == {"resolved", "ambiguous"}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_needles_are_searched_in_many_tasks(spark):
    texts = spark.range(400).coalesce(1).select("id", F.concat(F.lit("old ring "), F.col("id").cast("string")).alias("name"))
    wanted = spark.createDataFrame([("d ring",), ("Old",)], "needle string")
    found = needles.hits(wanted, "needle", texts, ["id"], "name")
    rows = found.select("needle", "id", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.needle, r.id) for r in rows) == sorted((n, i) for n in ("d ring", "Old") for i in range(400)) and len({r.task for r in rows}) > 1
