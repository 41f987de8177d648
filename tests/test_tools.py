"""The public operations on a small catalog, kept in memory."""

import pytest

from lodestone.catalog import Catalog
from lodestone.errors import EngineError
from lodestone.schema import TABLES, empty
from lodestone.tools import Tools

OBJECTS = ["", "Catalog/Справочник1", "Catalog/Справочник1/Form/ФормаЭлемента", "DefinedType/ТипТест", "Enum/ТестПеречисление", "CommonAttribute/ОбщийТест", "Document/ЗаказПокупателя", "InformationRegister/РегистрСведений1",
           "AccumulationRegister/РегистрНакопления1", "CommonModule/ОбщийМодуль1", "XDTOPackage/ПакетТест", "EventSubscription/ПодпискаТест", "ExchangePlan/ПланОбмена1", "Role/Роль1", "Role/Роль2"]
ID = {p: i + 1 for i, p in enumerate(OBJECTS)}
BODY = 'Процедура Тест()\n\tОбщийМодуль1.Экспортная(1);\n\tОбщийМодуль1.Закрытая();\n\tОбщийМодуль1.Нету();\n\tХ = Справочники.Справочник1.Найти();\n\tУ = Документы.Нету;\n\tЗ = "ВЫБРАТЬ Т.Нет ИЗ Справочник.Справочник1 КАК Т";\nКонецПроцедуры'


def tables(changed=False):
    cat, doc, mod = ID["Catalog/Справочник1"], ID["Document/ЗаказПокупателя"], ID["CommonModule/ОбщийМодуль1"]
    meta = [(i, 1, None if p == "" else ID["Catalog/Справочник1"] if "/Form/" in p else 1, i, p, "Configuration" if p == "" else "CatalogForm" if "/Form/" in p else p.split("/")[0], p.split("/")[-1] or "Конф", f"u{i}", None, None, None, "[]") for p, i in ID.items()]
    attrs = [(1, cat, 0, "СсылкаАтрибут", "Ссылка: Catalog/Справочник1", None, "a1"), (2, cat, 1, "Код2", "Число" if changed else "Строка(5)", None, "a2"), (3, doc, 0, "НомерЗаказа", "Строка(11)", None, "a3"),
             (4, doc, 1, "Номенклатура", "Ссылка: Catalog/Справочник1", "Товары", "a4"), (5, doc, 2, "Количество", "Число", "Товары", "a5")] + ([(6, cat, 2, "Новый", "Дата", None, "a6")] if changed else [])
    body2 = BODY.replace("Экспортная(1)", "Экспортная(2)") if changed else BODY
    methods = [(1, 1, 0, "процедура", "Тест", "", False, "&НаКлиенте, &Вместо(\"Закрытая\")" if changed else "", "", 3, 10, body2), (2, 2, 0, "функция", "Экспортная", "А", True, "", "", 1, 3, "Функция Экспортная(А) Экспорт\n\tВозврат 1;\nКонецФункции"),
               (3, 2, 1, "процедура", "Закрытая", "", False, "", "", 5, 7, "Процедура Закрытая()\n\tЭкспортная(2);\nКонецПроцедуры")]
    rights = [(1, ID["Role/Роль1"], "u2", cat, None, None, None, None, None, "0/0", "R", "1", None), (2, ID["Role/Роль1"], "u2", cat, None, None, None, None, None, "0/0", "W", "-1", None), (3, ID["Role/Роль1"], "t", None, None, None, None, -2, "c", "1/1", "R", "1", "ГДЕ"),
              (4, ID["Role/Роль1"], "u2", cat, None, None, None, None, None, "1/1", "W", "-1", None), (5, ID["Role/Роль2"], "u7", doc, None, None, None, None, None, "0/0", "R", "1", None)]
    return {
        "source": [(1, "x.cf", "2024", "Configuration", "Конф", "u1", 10, "sha", "1")], "meta_object": meta, "meta_attribute": attrs, "meta_tabular": [(1, doc, 0, "Товары", "t1"), (2, doc, 1, "Оплата", "t2")],
        "attribute_ref": [(1, 1, 0, "u2", cat), (2, 4, 0, "u2", cat), (3, 5, 0, "zz", None)], "enum_value": [(1, ID["Enum/ТестПеречисление"], 0, "Значение1"), (2, ID["Enum/ТестПеречисление"], 1, "Значение2")],
        "predefined": [(1, cat, 0, None, None, "Элементы", None, None), (2, cat, 1, 0, "p", "ПредЗначение", "001", None)], "common_target": [(1, ID["CommonAttribute/ОбщийТест"], cat)],
        "module": [(1, cat, "obj", "Сервер", "Перем А;"), (2, mod, "obj", "Сервер", "")] + ([(3, doc, "mgr", None, "")] if changed else []), "method": methods,
        "skd_query": [(1, cat, 1, "ВЫБРАТЬ 2 ИЗ Справочник.Справочник1"), (2, cat, 0, "ВЫБРАТЬ 1")],
        "xdto_type": [(1, ID["XDTOPackage/ПакетТест"], 0, "Товар", "objectType", "b", None, None, None), (2, ID["XDTOPackage/ПакетТест"], 0, None, "typeDef", None, None, None, None)],
        "xdto_property": [(1, 1, ID["XDTOPackage/ПакетТест"], 0, "Имя", "xs:string", None, 1, None, 0, None, None, None), (2, 1, ID["XDTOPackage/ПакетТест"], 1, "Позиции", None, None, 0, -1, 0, None, None, 2), (3, 2, ID["XDTOPackage/ПакетТест"], 0, "Номер", "x", None, 0, None, 0, None, None, None)],
        "role_right": rights, "role_rights_state": [(ID["Role/Роль1"], "10", True, 3, 4, 0, None), (ID["Role/Роль2"], None, False, 0, 0, 0, "broken")],
    }


@pytest.fixture(scope="module")
def tools(spark):
    c = Catalog(spark)
    for alias, rows in (("a", tables()), ("b", tables(True))):
        c.open(f"/{alias}", alias, {n: spark.createDataFrame(rows[n], TABLES[n]) if n in rows else empty(spark, n) for n in TABLES})
    return Tools(c)


def test_catalog_tools(tools):
    assert tools.find_objects("справ").count() == 2 and tools.find_objects("", "Role", db="*").count() == 4 and tools.find_objects("Регистр", limit=1).count() == 1
    note = tools.find_objects_total("", limit=5).first()
    assert (note.total, note.next_offset) == (14, 5)
    assert [r.path for r in tools.find_objects("Справочник1").collect()] == ["Catalog/Справочник1", "Catalog/Справочник1/Form/ФормаЭлемента"]
    card = tools.object_card("Справочник.Справочник1").collect()
    assert {r.section for r in card} >= {"header", "attributes", "modules", "children", "queries", "references", "predefined"} and {r.base for r in card} == {"a"}
    assert [r.name for r in tools.object_tree("", 1, limit=3).collect()] == ["Конф", "Справочник1", "ТипТест"]
    assert [(r.path, r.name) for r in tools.find_field("Номенклатура").collect()] == [("Document/ЗаказПокупателя", "Номенклатура")]
    refs = tools.refs_of("Catalog/Справочник1").collect()
    assert sorted((r.direction, r.path, r.field) for r in refs) == [("in", "Catalog/Справочник1", "СсылкаАтрибут"), ("in", "Document/ЗаказПокупателя", "Номенклатура"), ("out", "Catalog/Справочник1", "СсылкаАтрибут")]
    assert {r.path: r.depth for r in tools.refs_within("Document/ЗаказПокупателя").collect()} == {"Document/ЗаказПокупателя": 0, "Catalog/Справочник1": 1}
    info = tools.configuration_info(db="*").collect()
    assert {r.base: r.n_meta_attribute for r in info} == {"a": 5, "b": 6}
    assert tools.skd_of("Catalog/Справочник1").first().text == "ВЫБРАТЬ 1\n;\nВЫБРАТЬ 2 ИЗ Справочник.Справочник1" and tools.find_skd("ИЗ").count() == 1
    assert [r.name for r in tools.find_xdto("").collect()] == ["Товар", "Имя", "Позиции", "Номер"]
    assert [(r.level, r.text.split()[0]) for r in tools.xdto_of("XDTOPackage/ПакетТест").orderBy("sort_key").collect()][-1] == (2, "Номер")
    assert tools.sql("SELECT count(*) AS n FROM meta_object WHERE path = 'Справочник.Справочник1'").first().n == 1


def test_rights_tools(tools):
    assert tools.role_rights("Роль1").count() == 3 and tools.effective_rights(["Роль1"]).count() == 3
    s = tools.role_rights_stats("Роль1").first()
    assert (s.targets, s.resolved, s.rights, s.with_rls) == (3, 2, 4, 1)
    assert {r.role: r.state for r in tools.rights_state().collect()} == {"Роль1": "partial", "Роль2": "unavailable"}
    assert tools.object_rights("Catalog/Справочник1").count() == 2
    assert sorted(r.side for r in tools.role_diff(["Роль1"], ["Роль2"]).collect()) == ["only_a"] * 3 + ["only_b"]
    hit = {(r.path, r.kind): r.n for r in tools.role_impact(["Роль1"], ["Роль2"]).collect()}
    assert hit[("Catalog/Справочник1", "method")] == 1 and hit[("Catalog/Справочник1", "query")] == 1
    assert tools.role_impact(["Роль1"], ["Роль2"], mode="literal").count() == 0


def test_code_tools(tools):
    assert tools.module_outline("Catalog/Справочник1").first().body == "Перем А;" and tools.get_method("Справочник.Справочник1", "ТЕСТ").count() == 1
    assert [r.name for r in tools.find_methods("", text="возврат").collect()] == ["Экспортная"] and tools.find_methods("закрыт").count() == 1
    c = tools.find_method_context("Catalog/Справочник1", "Тест", "Найти", 0, 1).orderBy("line_no").collect()
    assert [r.line_no for r in c] == [7, 8] and c[0].hit_line == 7 and "Нету" in c[0].following
    states = {(r.kind, r.target): r.state for r in tools.method_dependencies("Catalog/Справочник1", "Тест").collect()}
    assert states[("call", "ОбщийМодуль1.Экспортная")] == "ok" and states[("call", "ОбщийМодуль1.Закрытая")] == "not_export" and states[("call", "ОбщийМодуль1.Нету")] == "missing_method"
    assert states[("metadata", "Catalog/Справочник1")] == "ok" and states[("metadata", "Document/Нету")] == "missing" and any(k == "query" for k, _ in states)
    assert {r.node: r.depth for r in tools.call_graph("CommonModule/ОбщийМодуль1", "Экспортная", callers=True).collect()} == {"общиймодуль1.экспортная": 0, "справочник1.тест": 1, "общиймодуль1.закрытая": 1}
    v = tools.query_check().collect()
    assert [(r.line, r.method) for r in v] == [(8, "Тест")]
    assert tools.method_result_schema("Catalog/Справочник1", "Тест").first().name == "Нет"
    assert tools.check_query("ВЫБРАТЬ Т.СсылкаАтрибут.ПредЗначение ИЗ Справочник.Справочник1 КАК Т").errors == []


def test_context_and_names(tools):
    assert tools.context_warnings("Catalog/Справочник1", "Тест").count() == 0
    assert {r.target for r in tools.context_warnings("Catalog/Справочник1", "Тест", db="b").collect()} == {"ОбщийМодуль1.Экспортная", "ОбщийМодуль1.Закрытая", "ОбщийМодуль1.Нету"}
    assert {r.right_label for r in tools.effective_rights(["Роль1"]).collect()} == {"R", "W"}


def test_comparison_tools(tools):
    found = [(r.id, r.kind) for r in tools.compare_object("Catalog/Справочник1", "a", "b").collect()]
    assert found == [("attrs:Новый", "only_right"), ("attrs:Код2", "changed"), ("methods:obj.тест", "changed")]
    pages = [r.id for o in range(3) for r in tools.compare_object("Catalog/Справочник1", "a", "b", limit=1, offset=o).collect()]
    assert pages == [x for x, _ in found]
    assert [(r.path, r.kind, r.n_left, r.n_right) for r in tools.config_diff("a", "b").collect()] == [("Document/ЗаказПокупателя", "changed", 0, 1)]
    d = tools.method_diff("Catalog/Справочник1", "Тест", "a", "b")
    assert d["body_changed"] and d["directives_changed"] and not d["params_added"]
    ext = tools.extension_diff("b", "a").collect()
    assert {(r.kind, r.path, r.key) for r in ext if r.kind in ("attributes", "intercept")} == {("attributes", "Catalog/Справочник1", "1"), ("intercept", "Catalog/Справочник1", "Вместо Закрытая")}
    assert sum(r.kind == "borrowed" for r in ext) == 14


def test_base_tools(tools):
    tools.group_create("Г")
    tools.group_add_db("г", "a")
    tools.group_add_db("г", "b")
    assert tools.find_objects("Роль", group="Г").count() == 4 and tools.group_list().count() == 2
    tools.group_remove_db("г", "b")
    tools.group_use("г")
    assert tools.find_objects("Роль").count() == 2
    tools.group_close("Г")
    tools.db_use("b")
    assert tools.find_field("Новый").count() == 1 and tools.db_list().count() == 2
    tools.db_use("a")


def small(spark, **rows):
    return {n: spark.createDataFrame(rows[n], TABLES[n]) if n in rows else empty(spark, n) for n in TABLES}


def test_sql_asks_the_base_it_names(spark):
    """A table that a base lacks is an error, not another base's table; the user's views stay."""
    c = Catalog(spark)
    module = spark.createDataFrame([(1, 1, "obj", None, "")], TABLES["module"])
    c.open("/nowhere/a", "a", {"module": module})
    c.open("/nowhere/b", "b", {"method": empty(spark, "method")})
    spark.range(3).createOrReplaceTempView("module")
    t = Tools(c)
    assert t.sql("SELECT count(*) AS n FROM module", "a").first().n == 1
    with pytest.raises(Exception, match="module|method"):
        t.sql("SELECT count(*) AS n FROM method", "a").collect()
    assert spark.table("module").count() == 3 and t.sql("SELECT count(*) AS n FROM method", "b").first().n == 0
    spark.catalog.dropTempView("module")
    spark.createDataFrame([(1, "x")], "UpdateDate int, `Drop` string").createOrReplaceTempView("odd_names")
    assert t.sql("SELECT UpdateDate, `Drop` FROM odd_names", "a").count() == 1
    for statement in ("DROP VIEW odd_names", "INSERT INTO odd_names VALUES (1, 'x')", "WITH x AS (SELECT 1 AS a, 'b' AS b) INSERT INTO odd_names SELECT * FROM x", "CREATE TABLE z AS SELECT 1", "SET a=b", "CACHE TABLE odd_names", "USE default"):
        with pytest.raises(EngineError):
            t.sql(statement, "a")


def test_sql_functions(spark):
    c = Catalog(spark)
    c.open("/nowhere/a", "a", {"module": spark.createDataFrame([(1, 1, "obj", None, "Перем А;"), (2, 1, "mgr", None, None)], TABLES["module"])})
    got = Tools(c).sql("SELECT id, lower_ru(body) AS low, body_has(body, 'ПЕРЕМ') AS has FROM module ORDER BY id", "a").collect()
    assert [(r.id, r.low, r.has) for r in got] == [(1, "перем а;", True), (2, None, False)]


def test_a_base_that_cannot_be_read_is_named(spark, tmp_path):
    c = Catalog(spark)
    c.open("/nowhere/a", "a", {"module": empty(spark, "module")})
    c.open(str(tmp_path / "gone"), "b")
    with pytest.warns(UserWarning, match="module is incomplete"):
        assert c.table("module", "*").count() == 0
    got = {r.base: (r.status, r.message) for r in c.status("*").collect()}
    assert got["a"][0] == "ok" and got["b"][0] == "error" and got["b"][1].startswith("module")
    c.bases["b"].tables["module"] = empty(spark, "module")
    c.table("module", "*")
    assert {r.status for r in c.status("*").collect()} == {"ok"}


def test_targets_differ_by_collection(spark):
    objects = [(1, 1, None, 0, "", "Configuration", "C", "u0", None, None, None, "[]"), (2, 1, 1, 1, "Role/R", "Role", "R", "u1", None, None, None, "[]"),
               (3, 1, 1, 2, "Role/S", "Role", "S", "u2", None, None, None, "[]"), (4, 1, 1, 3, "Catalog/X", "Catalog", "X", "u3", None, None, None, "[]")]
    rights = [(1, 2, "t", 4, None, None, None, 1, "c1", "0/0", "right", "1", None), (2, 2, "t", 4, None, None, None, 1, "c2", "0/0", "right", "1", None),
              (3, 3, "t", 4, None, None, None, 1, "c1", "0/0", "right", "1", None), (4, 2, "open", None, None, None, None, None, None, "0/0", "right", "1", None)]
    c = Catalog(spark)
    c.open("/a", "a", small(spark, meta_object=objects, role_right=rights, method=[(1, 1, 0, "процедура", "M", "", False, "", "", 1, 2, "Справочники.X.Найти()")]))
    t = Tools(c)
    assert t.role_rights("R").count() == 3 and t.effective_rights(["R"], "Catalog/X").count() == 2 and t.effective_rights(["R", "S"]).count() == 3
    assert {(r.collection_uuid, r.side) for r in t.role_diff(["R"], ["S"]).collect()} == {("c1", "common"), ("c2", "only_a"), (None, "only_a")}
    lost = t.lost_rights(["R"], ["S"]).collect()
    assert {(r.path, r.collection_uuid) for r in lost} == {("Catalog/X", "c2"), (None, None)}
    assert [(r.path, r.kind, r.n) for r in t.role_impact(["R"], ["S"]).collect()] == [("Catalog/X", "method", 1)]


def test_fingerprints_keep_parts_apart(spark):
    objects = [(1, 1, None, 0, "M", "CommonModule", "M", "u", None, None, None, "[]")]
    c = Catalog(spark)
    for alias, context, body in (("a", "x|y", "z"), ("b", "x", "y|z"), ("c", None, "x|y|z")):
        c.open(f"/{alias}", alias, small(spark, meta_object=objects, module=[(1, 1, "obj", context, body)]))
    t = Tools(c)
    assert len({t.snapshot("M", a).where("section = 'modules'").first().fp for a in "abc"}) == 3
