"""Table functions of SQL, remembered totals, verdicts, totals and notes of the tools."""

import pytest

from lodestone.catalog import Catalog
from lodestone.errors import EngineError
from lodestone.operators import paging
from lodestone.schema import TABLES, empty
from lodestone.sources import sinks
from lodestone.tools import Tools
from tests.test_tools import tables


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bases") / "base")
    c = Catalog(spark)
    for changed in (False, True):
        sinks.commit_base(spark, {n: spark.createDataFrame(r, TABLES[n]) for n, r in tables(changed).items()}, path)
        c.open(path, "b" if changed else "a")
    return Tools(c)


def test_table_functions(spark, stored):
    sub = stored.sql("SELECT level, path FROM subtree('Справочник.Справочник1', 1) ORDER BY path", "a").collect()
    assert [tuple(r) for r in sub] == [(0, "Catalog/Справочник1"), (1, "Catalog/Справочник1/Form/ФормаЭлемента")]
    refs = stored.sql("SELECT * FROM refs_of('Справочник.Справочник1')", "a").collect()
    want = stored.refs_of("Справочник.Справочник1", db="a").collect()
    assert {tuple(r) for r in refs} == {(r.direction, r.path, r.field) for r in want} and len(refs) == 3
    got = stored.sql("SELECT right_uuid, value, granted_by FROM effective(array('роль1', 'Роль2'))", "a").collect()
    assert len(got) == stored.effective_rights(["Роль1", "Роль2"], db="a").count() and {tuple(r.granted_by) for r in got} == {("Роль1",), ("Роль2",)}
    assert not any(spark.catalog.functionExists(n) for n in ("subtree", "refs_of", "effective"))
    with pytest.raises(EngineError):
        stored.sql("DROP TEMPORARY FUNCTION subtree", "a")


def test_totals_are_remembered(spark, stored):
    note = stored.find_objects_total("Справ", limit=1, db="a").first()
    assert tuple(note) == (2, 1, 1, 1) and stored.totals.counted == 1
    assert tuple(stored.find_objects_total("с прав", limit=5, offset=1, db="a").first()) == (2, 2, 2, None) and stored.totals.counted == 1
    stored.find_objects_total("Справ", db="b")  # another content
    stored.find_objects_total("Справ", "Catalog", db="a")
    assert stored.totals.counted == 3
    memory = Catalog(spark)
    memory.open("/m", "m", {n: spark.createDataFrame(tables()[n], TABLES[n]) if n in tables() else empty(spark, n) for n in TABLES})
    t = Tools(memory)
    assert t.find_objects_total("", limit=5).first().total == 14 and t.totals.counted == 0
    memo = paging.Memo(2)
    assert [memo.get(k, lambda: 7) for k in "abab"] == [7] * 4 and memo.counted == 2 and memo.get("c", lambda: 1) == 1 and list(memo.known) == ["b", "c"]


def test_verdicts_and_totals(stored):
    assert {(r.path, r.name): r.verdict for r in stored.method_verdicts("a", "b").collect()} == {
        ("Catalog/Справочник1", "Тест"): "code, directives", ("CommonModule/ОбщийМодуль1", "Экспортная"): "unchanged", ("CommonModule/ОбщийМодуль1", "Закрытая"): "unchanged"}
    assert stored.method_verdicts("a", "b", "Справочник.Справочник1").count() == 1
    assert tuple(stored.config_diff_totals("a", "b").first()) == (15, 15, 0, 0, 1, 14)
    note = stored.object_rights_note("Справочник.Справочник1", db="*").collect()
    assert {r.base: (r.n_roles, r.n_targets, r.n_all_roles, r.n_unreadable) for r in note} == {"a": (1, 2, 2, 1), "b": (1, 2, 2, 1)}


def test_role_impact_modes(stored):
    one = {(r.path, r.kind): r.n for r in stored.role_impact("Роль1", db="a").collect()}
    assert one[("Catalog/Справочник1", "method")] == 1 and one[("Catalog/Справочник1", "query")] == 1 and not any(k == "check" for _, k in one)
    assert stored.role_impact("Роль1", path="Документ.ЗаказПокупателя", db="a").count() == 0
    places = [(r.kind, r.place, r.method, r.line, r.n) for r in stored.role_impact_places("Роль1", db="a").orderBy("kind").collect()]
    assert places == [("method", "Catalog/Справочник1", "Тест", 7, 1), ("query", "Catalog/Справочник1", None, 1, 1)]


def test_card_sections_and_passport(spark):
    import json

    u = [f"{i}1000000-0000-0000-0000-000000000000" for i in range(9)]
    register = {"header": [["1", [*["0"] * 18, "4", "1"]]]}
    package = {"header": [["1", ["a", "b", '"urn:x"']]]}
    subscription = {"header": [["1", ["a", "b", ['"Pattern"', ["#", u[5]]], '"x_ПриЗаписи"', u[3], '"Обработать"']]]}
    source = {"header": [["1", ["a", u[5]]]]}
    plan = {"info": ["1", "2", u[1], "0", u[4], "0", u[8], "1"]}
    node = ['""'] * 46
    node[15], node[42] = '"3.0.1"', '"Р_"'
    root = {"compatibility_version": "80321", "header": [["0", "0", "0", ["x", ["y", node]]]]}
    objects = [("", "Configuration", root), ("InformationRegister/Р", "InformationRegister", register), ("XDTOPackage/П", "XDTOPackage", package), ("CommonModule/М", "CommonModule", {}), ("Catalog/С", "Catalog", source), ("EventSubscription/О", "EventSubscription", subscription), ("ExchangePlan/Э", "ExchangePlan", plan)]
    rows = [(i, 1, None, i, p, k, p.split("/")[-1], u[i], None, None, None, json.dumps(h)) for i, (p, k, h) in enumerate(objects)]
    c = Catalog(spark)
    given = {"meta_object": rows, "source": [(1, "x/y.CFE", "2024", "Configuration", "К", "u", 1, "abc", "1")]}
    c.open("/m", "m", {n: spark.createDataFrame(given[n], TABLES[n]) if n in given else empty(spark, n) for n in TABLES})
    c.group_create("г")
    c.group_add("г", "m")
    t = Tools(c)
    card = lambda path: {(r.section, r.text) for r in t.object_card(path).collect() if r.section not in ("header", "children")}
    assert card("РегистрСведений.Р") == {("properties", "periodicity: день"), ("properties", "write_mode: recorder")}
    assert card("XDTOPackage/П") == {("properties", "namespace: urn:x")}
    assert card("Catalog/С") == {("subscriptions", "EventSubscription/О ПриЗаписи CommonModule/М.Обработать")}
    assert card("EventSubscription/О") == {("properties", "event: ПриЗаписи"), ("properties", "method: Обработать"), ("properties", "sources: 1"), ("sources", "Catalog/С")}
    assert card("CommonModule/М") == {("handles", "EventSubscription/О ПриЗаписи Обработать")}
    assert card("ExchangePlan/Э") == {("content", "Catalog 1"), ("content", "InformationRegister 1"), ("content", "? 1")}
    info = t.configuration_info().first()
    assert (info.kind, info.version, info.name_prefix, info.compatibility, info.n_meta_object) == ("Расширение конфигурации", "3.0.1", "Р_", "8.3.21", 7)
    line = t.db_summary().first()
    assert (line.alias, line.active, line.groups, line.kind, line.fingerprint, line.n_meta_object) == ("m", True, ["г"], "Расширение конфигурации", "abc", 7)


def test_references_are_paged_by_direction(stored):
    both = stored.refs_of("Catalog/Справочник1", limit=1, db="a").collect()
    assert [r.direction for r in both] == ["out", "in"] and stored.refs_of("Catalog/Справочник1", "in", limit=1, offset=1, db="a").count() == 1
