"""Scopes, pins and dependencies over several bases; ids; numbering; alignment."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.catalog import Catalog
from lodestone.errors import BadArguments
from lodestone.operators import align, numbering, scopes
from lodestone.schema import TABLES, empty
from lodestone.tools import Tools


def open_base(c, alias, objects, modules=(), methods=(), sha=None):
    spark = c.spark
    meta = [(i, 1, None, i, p, p.split("/")[0], p.split("/")[-1], f"{alias}{i}", None, None, None, "[]") for i, p in enumerate(objects, 1)]
    rows = {"meta_object": meta, "module": modules, "method": methods, "source": [(1, f"{alias}.cf", "2024", "Configuration", "К", "u", 1, sha, "1")]}
    c.open(f"/{alias}", alias, {n: spark.createDataFrame(rows[n], TABLES[n]) if rows.get(n) else empty(spark, n) for n in TABLES})


CODE = """Процедура Тест(Пар)
\tОбщий.Есть();
\tЧужой.Метод();
\tДва.Метод();
\tПар.Метод();
\tВыполнить("Общий.Закрытый");
\tСвоя(); Платформа();
\tХ = Справочники.Чужой.Найти();
\tВычислить("Справочники.Свой");
\tЗ = "ВЫБРАТЬ " + Поля;
КонецПроцедуры
Процедура Своя()
КонецПроцедуры"""


@pytest.fixture(scope="module")
def tools(spark):
    c = Catalog(spark)
    method = lambda i, m, name, body="", export=True: (i, m, i, "процедура", name, "Пар" if name == "Тест" else "", export, "", "", 10, 20, body)
    open_base(c, "a", ["Catalog/Свой", "CommonModule/Общий"], [(1, 1, "obj", None, ""), (2, 2, "obj", None, "")],
              [method(1, 1, "Тест", CODE), method(2, 1, "Своя"), method(3, 2, "Есть"), method(4, 2, "Закрытый", export=False)], "ABC123")
    open_base(c, "b", ["CommonModule/Чужой", "CommonModule/Два", "Catalog/Чужой"], [(1, 1, "obj", None, ""), (2, 2, "obj", None, "")], [method(1, 1, "Метод"), method(2, 2, "Метод")], "abd999")
    open_base(c, "c", ["CommonModule/Два", "CommonModule/Общий"], [(1, 1, "obj", None, "")], [method(1, 1, "Метод", export=False)], "abd111")
    open_base(c, "d", ["Catalog/Свой"], [(1, 1, "obj", None, "")], [method(1, 1, "Тест", CODE)], None)
    return Tools(c)


def states(df):
    return {(r.kind, r.target): (r.state, r.place) for r in df.collect() if r.kind in ("call", "metadata", "plain", "dynamic")}


def test_dependencies_by_scope(tools):
    got = states(tools.method_dependencies("Справочник.Свой", "Тест", db="a"))
    assert got == {("call", "Общий.Есть"): ("ok", "a"), ("call", "Чужой.Метод"): ("ok", "b"), ("call", "Два.Метод"): ("ambiguous", "b, c"), ("metadata", "Catalog/Чужой"): ("ok", "b"), ("plain", "Своя"): ("own", None),
                   ("plain", "Платформа"): ("global", None), ("dynamic", "Общий.Закрытый"): ("not_export", "a"), ("dynamic", "Справочники.Свой"): ("ok", "a")}
    got = states(tools.method_dependencies("Catalog/Свой", "Тест", db="a", scope=["c"]))
    assert got["call", "Чужой.Метод"] == ("outside", "b") and got["call", "Два.Метод"] == ("not_export", "c") and got["metadata", "Catalog/Чужой"] == ("outside", "b")
    got = states(tools.method_dependencies("Catalog/Свой", "Тест", db="a", scope=["b", "c"], expect={"A": "abc", "c": "000"}))  # c is another snapshot
    assert got["call", "Два.Метод"] == ("ok", "b")
    lines = {r.target: r.line for r in tools.method_dependencies("Catalog/Свой", "Тест", db="a").where("kind = 'call'").collect()}
    assert lines == {"Общий.Есть": 11, "Чужой.Метод": 12, "Два.Метод": 13}
    assert {(r.line, r.state) for r in tools.method_dependencies("Catalog/Свой", "Тест", db="a").where("kind = 'query'").collect()} == {(19, "partial")}


def test_bases_answer_for_themselves(tools):
    """A module that one base has does not make the other's call a good one."""
    both = tools.method_dependencies("Catalog/Свой", "Тест", scope=[], db=["a", "d"]).where("kind = 'call' and target = 'Общий.Есть'").collect()
    assert {r.base: r.state for r in both} == {"a": "ok", "d": "outside"}
    verdicts = tools.method_dependencies("Catalog/Свой", "Своя", callers=True, depth=2, diff_db="d", db="a").where("kind = 'caller'").collect()
    assert [(r.target, r.state, "unchanged" in r.detail) for r in verdicts] == [("Catalog/Свой/Тест", "code", True)]


def test_pins(spark, tools):
    found = {r.alias: r.state for r in tools.catalog.pinned("a", ["b", "d"], {"b": "ABD9", "d": "1"}).collect()}
    assert found == {"a": "asked", "b": "in_scope", "c": "outside", "d": "rejected"}
    assert "no fingerprint" in tools.catalog.pinned("a", None, {"d": "1"}).where("alias = 'd'").first().reason
    for wrong in ({"expect": {"a": "fff"}}, {"expect": {"zzz": "1"}}, {"scope": ["zzz"]}):
        with pytest.raises(BadArguments):
            tools.catalog.pinned("a", **wrong)
    pins = spark.createDataFrame([(1, "ab"), (2, "ABC"), (3, "abd9"), (4, "q"), (5, ""), (6, None), (3, "abd9"), (7, "abc123" * 30)], "pin long, prefix string")
    got = sorted((r.pin, r.state, r.n_bases, r.base) for r in tools.catalog.by_fingerprint(pins).collect())
    assert got == [(1, "ambiguous", 3, None), (2, "resolved", 1, "a"), (3, "resolved", 1, "b"), (3, "resolved", 1, "b"), (4, "missing", 0, None), (5, "empty", 0, None), (6, "empty", 0, None), (7, "missing", 0, None)]
    assert scopes.resolve_pins(pins, spark.createDataFrame([], "alias string, fingerprint string")).where("state = 'resolved'").count() == 0


def test_numbers_are_those_of_a_window(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.randint(0, 5), rng.choice(["a", "b", None])) for i in range(500)], "id int, depth int, path string").repartition(7)
    order = ["depth", F.col("path").asc_nulls_last(), "id"]
    got = numbering.number(df, order, "n")
    want = df.withColumn("n", F.row_number().over(Window.orderBy(*order)))
    assert {r.id: r.n for r in got.collect()} == {r.id: r.n for r in want.collect()}
    assert numbering.number(df.limit(0), order, "n").collect() == []


def test_links_of_one_field_have_their_own_ids(spark):
    """A field of 300 links and its neighbour: no two links share an id."""
    from lodestone.sources.load import _under

    df = spark.createDataFrame([(a, o) for a in (1, 2) for o in range(300)], "attribute_id long, ord int")
    assert df.select(_under("attribute_id", "ord").alias("id")).distinct().count() == 600


def lines(spark, texts):
    return align.lines_of(spark.createDataFrame(texts, "k int, text string"), ["k"], "text")


def test_alignment(spark):
    rng = random.Random(11)
    left, right = [], []
    for k in range(60):
        a = [rng.choice("abcdefgh") if rng.random() < 0.4 else f"u{rng.randint(0, 60)}" for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() > 0.2]
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice(["a", "new", "u3"]))
        left.append((k, "\n".join(a)))
        right.append((k, "\n".join(b)))
    pairs = {}
    for r in align.align(lines(spark, left), lines(spark, right), ["k"]).collect():
        pairs.setdefault(r.k, []).append((r.la, r.lb))
    for (k, a), (_, b) in zip(left, right, strict=True):
        a, b, got = a.split("\n") if a else [], b.split("\n") if b else [], sorted(pairs.get(k, []))
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))  # equal lines, rising on both sides
        if a == b:
            assert len(got) == len(a)
    assert align.rising([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)] and align.rising([]) == []


def test_three_way(spark):
    old = "шапка\nа\nб\nв\nг\nд\nе\nж\nконец"
    cases = {1: (old, old), 2: (old.replace("б", "Б1"), old), 3: (old, old.replace("б", "Б2")), 4: (old.replace("б", "Б1"), old.replace("б", "Б2")), 5: (old.replace("в\n", ""), old), 6: (old.replace("\nе\n", "\nЕ\n"), old.replace("\nе\n", "\nЕ\n")),
             7: (old.replace("б", "Б1").replace("ж", "ж\nеще"), old.replace("д", "Д\nД")), 8: ("", old)}
    three = [lines(spark, [(k, old if i < 0 else c[i]) for k, c in cases.items()]) for i in (-1, 0, 1)]
    got = {}
    for r in align.three_way(*three, ["k"]).orderBy("k", "region").collect():
        got.setdefault(r.k, []).append((r.state, r.n_old, r.n_new, r.n_own))
    assert got == {2: [("changed", 1, 1, 1)], 3: [("own", 1, 1, 1)], 4: [("conflicting", 1, 1, 1)], 5: [("missing", 1, 0, 1)], 6: [("same", 1, 1, 1)],
                   7: [("changed", 1, 1, 1), ("own", 1, 1, 2), ("changed", 0, 1, 0)], 8: [("missing", 9, 0, 9)]}


def test_control_diff(spark):
    c = Catalog(spark)
    old = "Процедура Цель()\n\tА = 1;\n\tБ = 2;\n\tВ = 3;\n\tГ = 4;\nКонецПроцедуры"
    ext = "Процедура Р_Цель()\n\tА = 1;\n#Удаление\n\tБ = 2;\n#КонецУдаления\n#Вставка\n\tБ = 20;\n#КонецВставки\n\tВ = 3;\n\tГ = 4;\nКонецПроцедуры"
    method = lambda i, name, body, dirs="": (i, 1, i, "процедура", name, "", False, dirs, "", 1, 9, body)
    hook = lambda n: f'&ИзменениеИКонтроль("{n}")'
    open_base(c, "old", ["Catalog/С"], [(1, 1, "obj", None, "")], [method(1, "Цель", old), method(2, "Ровно", old), method(3, "Нет", old)])
    open_base(c, "new", ["Catalog/С"], [(1, 1, "obj", None, "")], [method(1, "Цель", old.replace("Б = 2", "Б = 3")), method(2, "Ровно", old.replace("Г = 4;", "Г = 5;"))])
    open_base(c, "ext", ["Catalog/С", "Catalog/Р_Новый"], [(1, 1, "obj", None, "")], [method(1, "Р_Цель", ext, hook("Цель")), method(2, "Р_Ровно", ext, hook("Ровно")), method(3, "Р_Нет", ext.replace("А = 1", "А = 7"), hook("Нет")), method(4, "Свой", "")])
    t = Tools(c)
    got = {(r.target, r.state, r.n_old, r.n_new, r.n_own) for r in t.control_diff("ext", "old", "new").collect()}
    assert got >= {("Цель", "conflicting", 1, 1, 1), ("Ровно", "own", 1, 1, 1), ("Ровно", "changed", 1, 1, 1)}
    state = {r.target: (r.control, r.inserted, r.deleted, r.state) for r in t.control_state("ext", "old", "new").collect()}
    assert state == {"Цель": (True, 1, 1, "conflicting"), "Ровно": (True, 1, 1, "changed"), "Нет": (False, 1, 1, "missing")}
    rows = {(r.kind, r.path, r.key): r.state for r in t.extension_diff("ext", "old", "new", prefix="Р_").collect()}
    assert rows["new", "Catalog/Р_Новый", "Catalog"] == "prefixed" and rows["intercept", "Catalog/С", "ИзменениеИКонтроль Цель"] == "changed" and rows["own_method", "Catalog/С", "obj.Свой"] is None
    assert t.extension_diff("ext", "old", "new", most=1).where("kind = 'intercept'").first().n == 3
