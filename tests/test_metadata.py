"""Derivations from object headers."""

import json

from lodestone.sources import metadata as M

CAT, ORPHAN, DEFINED, GENERIC = (f"{i}0000000-0000-0000-0000-000000000000" for i in range(1, 5))
REF = "50000000-0000-0000-0000-000000000000"


def core(name, uuid="в отдельном файле", mark="3"):
    return [mark, ["1", "0", uuid], f'"{name}"', ["1", '"ru"', f'"{name}"'], '""']


def field(name, kind, uuid="в отдельном файле", mark="3"):
    return ["7", ["27", ["2", core(name, uuid, mark), kind]]]


def section(name, fields, count=None):
    return [["1", ["11", "x", ["0", core(name, "60000000-0000-0000-0000-000000000000")]]], "1", [M.SECTION_KEY, str(len(fields) if count is None else count), *fields]]


NAMES = M.Names(by_uuid={CAT: "Catalog/С1"}, references={REF: "С1", ORPHAN: "Нету"}, defined={DEFINED: ("DefinedType/Т", [["#", REF]])})
NAMES.by_name["С1"] = ["Catalog/С1", "Catalog/С1/Form/С1"]


def text(kind):
    return M.type_text(kind, NAMES)


def test_types():
    assert text(["Pattern", ["S", "11"]]) == ("Строка(11)", []) and text(["Pattern", ['"N"']])[0] == "Число"
    assert text(["Pattern", ["#", REF]]) == ("Ссылка: Catalog/С1", [(REF, "Catalog/С1")])
    assert text(["Pattern", ["#", ORPHAN]]) == ("Ссылка: Нету (объект не найден в базе)", [(ORPHAN, None)])
    assert text(["Pattern", ["#", DEFINED]]) == ("ОпределяемыйТип: DefinedType/Т (Ссылка: Catalog/С1)", [(DEFINED, "DefinedType/Т"), (REF, "Catalog/С1")])
    assert text(["0", "3", ["#", GENERIC, ["x", CAT]], ["#", GENERIC], ["#", GENERIC, [CAT]]]) == ("Ссылка: Catalog/С1 | Ссылка", [(CAT, "Catalog/С1"), (GENERIC, None)])
    assert text(["?", "1"]) == (None, []) and text(None) == (None, [])
    loop = M.Names(defined={DEFINED: ("DefinedType/Т", [["#", DEFINED]])})
    assert M.type_text(["Pattern", ["#", DEFINED]], loop)[0] == "ОпределяемыйТип: DefinedType/Т (ОпределяемыйТип: DefinedType/Т)"


HEADER = {"header": [["1", ["x", field("Номер", ["Pattern", ["S", "11"]]), field("Номер", ["Pattern", ["N"]]), field("Чужой", ["Pattern", ["N"]], mark="0"), field("Измерение", ["Pattern", ["N"]], CAT, "0")],
                      *section("Товары", [field("Номер", ["Pattern", ["N"]]), field("Кол", ["0", "1", ["N"]])]), *section("Пусто", []),
                      [["0", core("Значение1")], "0"], [["0", core("Значение2")], "0"], [["0", core("Значение1")], "0"]]]}


def test_header():
    assert [(a.name, a.tabular, a.uuid) for a in M.attributes(HEADER["header"])] == [("Номер", None, None), ("Измерение", None, CAT), ("Номер", "Товары", None), ("Кол", "Товары", None)]
    assert [(n, c) for n, _, c in M.sections(HEADER["header"])] == [("Товары", 2), ("Пусто", 0)]
    assert M.enum_values(HEADER["header"]) == ["Значение1", "Значение2"]


def test_properties():
    flags = {"header": [[["1"], ["a", ["core"], "0", "1", "0", "0", "0", "1", "0", "0"]]]}
    assert M.module_context(flags) == "Сервер,Клиент (управляемое приложение)" and M.module_context({"header": []}) is None
    register = {"header": [["1", [*["0"] * 18, "4", "1"]]]}
    assert M.register_properties("InformationRegister", register) == {"periodicity": "4", "write_mode": "recorder"}
    assert M.register_properties("AccumulationRegister", {}) == {"write_mode": "recorder"} and M.register_properties("Catalog", register) == {}
    node = ['""'] * 46
    node[15], node[42] = '"1.2.3.4"', '"лст_"'
    assert M.configuration_properties({"header": [["0", "1", "2", ["x", ["y", node]]]]}) == {"version": "1.2.3.4", "name_prefix": "лст_"}
    assert M.configuration_properties({}) == {}


def test_derive(spark):
    df = spark.createDataFrame([(1, json.dumps(HEADER)), (2, "no json"), (3, None)], "id long, header_json string")
    rows = M.derive(df, NAMES).collect()
    assert {(r.part, r.name, r.tabular) for r in rows} == {("attribute", "Номер", None), ("attribute", "Измерение", None), ("attribute", "Номер", "Товары"), ("attribute", "Кол", "Товары"), ("section", "Товары", None),
                                                           ("section", "Пусто", None), ("value", "Значение1", None), ("value", "Значение2", None)}
    assert {r.object_id for r in rows} == {1} and [r.type_str for r in rows if r.name == "Номер"] == ["Строка(11)", "Число"]


def test_links(spark):
    from lodestone.sources import links

    u = lambda n: f"{n:08x}-0000-0000-0000-00000000000a"
    rows = [(1, None, "Configuration", u(1), f'[["{u(3)}", "{u(2).upper()}"]]'), (2, 1, "Catalog", u(2), "[]"), (3, 1, "CommonAttribute", u(3), f'["{u(3)}", "{u(2)}", "{u(2)}", "{u(99)}"]'),
            (4, 1, "Subsystem", u(4), f'["{u(3)}", "{u(1)}", "{u(2)}", "{u(3)}", "{u(4)}"]'), (5, 2, "Document", None, None)]
    o = spark.createDataFrame(rows, "id long, parent_id long, type string, uuid string, header_json string")
    assert [tuple(r) for r in links.common_targets(o).collect()] == [(3, 2)]
    assert [tuple(r) for r in links.subsystem_content(o).orderBy("ord").collect()] == [(4, 3, 0), (4, 2, 1)]
    assert {r.id: r.ord for r in links.sibling_order(o).collect()} == {1: None, 2: 1, 3: 0, 4: None, 5: None}
    s = spark.createDataFrame([(1, u(7).upper()), (2, u(8)), (3, None)], "id long, uuid string")
    p = spark.createDataFrame([(70, u(7)), (71, u(7)), (72, None)], "id long, uuid string")
    assert {r.id: r.kind_id for r in links.resolve_kinds(s, p).collect()} == {1: 70, 2: None, 3: None}


def test_subscriptions_and_plans(spark):
    header = lambda *record: {"header": [["1", [*record], "0"]]}
    sub = header("1", core("П"), ['"Pattern"', ['"#"', REF], ['"#"', GENERIC]], '"BeforeWrite_ПередЗаписью"', CAT, '"Экспортная"')
    assert M.event_subscription(sub) == {"event": "ПередЗаписью", "handler": CAT, "method": "Экспортная", "sources": [REF, GENERIC]}
    assert M.event_subscription(header("1", "2")) is None and M.event_subscription({}) is None
    assert M.exchange_content({"info": [["2", "2", CAT, "0", REF, "1"]]}) == [CAT, REF] and M.exchange_content({}) == []
    rows = [("EventSubscription/П", "EventSubscription", None, json.dumps(sub)), ("CommonModule/М", "CommonModule", CAT, "{}"), ("DefinedType/Т", "DefinedType", DEFINED, json.dumps(header("0", REF))), ("Catalog/Х", "Catalog", None, None)]
    got = M.event_index(spark.createDataFrame(rows, "path string, type string, uuid string, header_json string")).collect()
    assert {(r.event, r.method, r.handler, r.source) for r in got} == {("ПередЗаписью", "Экспортная", "CommonModule/М", "DefinedType/Т"), ("ПередЗаписью", "Экспортная", "CommonModule/М", None)}


def test_names_joined_to_headers(spark):
    """The rows with names joined by object are those with all names at hand; defined types inside each other, and in a circle."""
    inner, outer, circle = (f"7{i}000000-0000-0000-0000-000000000000" for i in range(3))
    kinds = [["#", REF], ["#", ORPHAN], ["#", GENERIC, [CAT]], ["#", GENERIC], ["#", outer], ["#", circle], ["S", "5"]]
    fields = [field(f"П{i}", ["Pattern", k]) for i, k in enumerate(kinds)] + [field("Все", ["0", str(len(kinds)), *kinds])]
    defined = lambda u, members: json.dumps({"header": [["1", ["x", u, "a", "b", members]]]})
    rows = [(1, "Catalog/С1", "С1", "Catalog", CAT, json.dumps({"header": [["1", ["x", *fields]]]})), (2, "Catalog/С1/Form/С1", "С1", "CatalogForm", None, "no json"), (3, "Document/С1", "С1", "Document", None, json.dumps({"header": fields[:1]})),
            (4, "DefinedType/Внутри", "Внутри", "DefinedType", "d1", defined(inner, [["#", REF], ["N"]])), (5, "DefinedType/Снаружи", "Снаружи", "DefinedType", "d2", defined(outer, [["#", inner], ["S"]])),
            (6, "DefinedType/Круг", "Круг", "DefinedType", "d3", defined(circle, [["#", circle], ["#", ORPHAN]]))]
    objects = spark.createDataFrame(rows, "id long, path string, name string, type string, uuid string, header_json string")
    names = M.Names(by_uuid={r[4]: r[1] for r in rows if r[4]}, references={REF: "С1", ORPHAN: "Нету"},
                    defined={inner: (rows[3][1], [["#", REF], ["N"]]), outer: (rows[4][1], [["#", inner], ["S"]]), circle: (rows[5][1], [["#", circle], ["#", ORPHAN]])})
    names.by_name["С1"] = ["Catalog/С1", "Catalog/С1/Form/С1", "Document/С1"]
    references = spark.createDataFrame([(REF, "С1"), (ORPHAN, "Нету"), ("other", "Никому")], "uuid string, name string")
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert key(M.derive_joined(objects, references)) == key(M.derive(objects, names)) != []
    assert M.derive_joined(objects.limit(0), references).collect() == []
