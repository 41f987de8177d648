"""A dump of files to all tables of a base, and the operations on it."""

import json

from lodestone.catalog import Catalog
from lodestone.schema import TABLES
from lodestone.sources import load
from lodestone.tools import Tools

U = [f"{i:08x}-0000-0000-0000-000000000000" for i in range(20)]
REF = U[15]


def core(name, uuid):
    return ["3", ["1", "0", uuid], f'"{name}"', ["1", '"ru"', f'"{name}"'], '""']


def field(name, kind, uuid):
    return ["7", ["27", ["2", core(name, uuid), kind]]]


def put(root, folder, kind, header, uuid, **files):
    where = root / folder
    where.mkdir(parents=True, exist_ok=True)
    (where / f"{kind}.json").write_text(json.dumps(header, ensure_ascii=False), encoding="utf-8")
    (where / f"{kind}.id.json").write_text(json.dumps({"uuid": uuid}))
    for name, content in files.items():
        (where / name).write_bytes(content)


def dump_folder(root):
    put(root, "", "Configuration", {"name": "Конф", "comment": "все", "header": [[U[2], U[1]]]}, U[0], **{"Configuration.10.json": json.dumps([["x", "y", "z", [["1", [REF, '"Товар"']]]]]).encode()})
    put(root, "Catalog/Товар", "Catalog", {"name": "Товар", "obj_version": "7", "header": [field("Код2", ["Pattern", ['"N"']], U[10]), field("Аналог", ["Pattern", ["#", REF]], U[11])]}, U[1],
        **{"Catalog.obj.bsl": "Перем А;\nПроцедура П(Б)\n\tА = 1;\nКонецПроцедуры\nФункция Ф() Экспорт\n\tВозврат 1;\nКонецФункции".encode("utf-8-sig"), "Template.0.bin": "<?xml?><query>ВЫБРАТЬ 1</query><query>ВЫБРАТЬ 2</query>".encode(), "note.txt": "х".encode("cp1251")})
    put(root, "CommonModule/М", "CommonModule", {"name": "М", "header": [["0", ["0", core("М", U[2]), "0", "1", "0", "0", "0", "0", "0", "0"]]]}, U[2], **{"CommonModule.obj.bsl": b""})
    put(root, "Role/Р", "Role", {"name": "Р", "header": []}, U[3], **{"Role.0.c1brace": f'{{10,{{1,{{{{1,{U[1]},0,0}},{{0,{U[5]},1}}}}}},{{1,{{"Для","ГДЕ"}}}},4294967295,1}}'.encode()})
    put(root, "Role/Нет", "Role", {"name": "Нет", "header": []}, U[4])
    put(root, "Subsystem/С", "Subsystem", {"name": "С", "header": [[U[1], U[3], U[1], "x " + U[2]]]}, U[6])
    put(root, "XDTOPackage/Пакет", "XDTOPackage", {"name": "Пакет", "header": []}, U[7], **{"XDTOPackage.0.bin": b'<package xmlns="u" targetNamespace="t"><import namespace="i"/><objectType name="T"><property name="P"><typeDef><property name="Q"/></typeDef></property></objectType></package>'})
    (root / "broken").mkdir()
    (root / "broken/Catalog.json").write_text("{no json")
    (root / "broken/Catalog.id.json").write_text("{}")


def test_dump_to_base(spark, tmp_path):
    root, base = tmp_path / "dump", str(tmp_path / "base")
    root.mkdir()
    dump_folder(root)
    load.import_dump(spark, str(root), base)
    t = {n: spark.read.schema(TABLES[n]).parquet(f"{base}/{n}").collect() for n in TABLES}
    objects = {r.path: r for r in t["meta_object"]}
    ids = {p: r.id for p, r in objects.items()}
    assert set(ids) == {"", "Catalog/Товар", "CommonModule/М", "Role/Р", "Role/Нет", "Subsystem/С", "XDTOPackage/Пакет", "broken"} and len(set(ids.values())) == 8
    tovar = objects["Catalog/Товар"]
    assert (tovar.type_ru, tovar.uuid, tovar.obj_version, tovar.parent_id, tovar.ord, objects["CommonModule/М"].ord, objects["Role/Р"].ord) == ("Справочник", U[1], "7", ids[""], 1, 0, None)
    assert [(r.root_type, r.root_name, r.root_uuid) for r in t["source"]] == [("Configuration", "Конф", U[0])] and objects["broken"].name == "broken"
    attributes = {r.name: r for r in t["meta_attribute"]}
    assert {(r.object_id, r.name, r.type_str, r.uuid) for r in t["meta_attribute"]} == {(ids["Catalog/Товар"], "Код2", "Число", U[10]), (ids["Catalog/Товар"], "Аналог", "Ссылка: Catalog/Товар", U[11])}
    assert [(r.attribute_id, r.uuid, r.object_id) for r in t["attribute_ref"]] == [(attributes["Аналог"].id, REF, ids["Catalog/Товар"])]
    modules = {r.object_id: r for r in t["module"]}
    assert set(modules) == {ids["Catalog/Товар"], ids["CommonModule/М"]} and modules[ids["CommonModule/М"]].context and "Перем А" in modules[ids["Catalog/Товар"]].body
    assert sorted((r.module_id, r.ord, r.name, r.is_export) for r in t["method"]) == [(modules[ids["Catalog/Товар"]].id, 0, "П", False), (modules[ids["Catalog/Товар"]].id, 1, "Ф", True)]
    assert sorted((r.ord, r.query) for r in t["skd_query"]) == [(0, "ВЫБРАТЬ 1"), (1, "ВЫБРАТЬ 2")]
    types = {r.name: r for r in t["xdto_type"]}
    assert {(r.type_id, r.name, r.nested_type_id) for r in t["xdto_property"]} == {(types["T"].id, "P", types[None].id), (types[None].id, "Q", None)} and t["xdto_import"][0].namespace == "i"
    assert [(r.role_id, r.target_object_id, r.right_uuid, r.value) for r in t["role_right"]] == [(ids["Role/Р"], ids["Catalog/Товар"], U[5], "1")]
    assert {r.role_id: (r.parsed, r.rights) for r in t["role_rights_state"]} == {ids["Role/Р"]: (True, 1), ids["Role/Нет"]: (False, 0)} and [(r.name, r.text) for r in t["role_rls_template"]] == [("Для", "ГДЕ")]
    assert [(r.target_id, r.ord) for r in t["subsystem_content"]] == [(ids["Catalog/Товар"], 0), (ids["Role/Р"], 1)]
    files = {r.path: r for r in t["file"]}
    assert files["Catalog/Товар/Catalog.obj.bsl"].data is None and files["Catalog/Товар/note.txt"].data is not None and files["Role/Р/Role.0.c1brace"].object_id == ids["Role/Р"]
    assert "Catalog/Товар/Catalog.json" not in files and "Catalog/Товар/Catalog.id.json" not in files
    assert all(len({r.id for r in t[n]}) == len(t[n]) for n in t if n != "query_violation" and n != "role_rights_state")
    c = Catalog(spark)
    c.open(base, "erp")
    tools = Tools(c)
    assert [r.path for r in tools.refs_of("Справочник.Товар").collect()] == ["Catalog/Товар", "Catalog/Товар"] and tools.get_method("Catalog/Товар", "ф").count() == 1
    assert tools.object_rights("Catalog/Товар").count() == 1 and {r.state for r in tools.rights_state().collect()} == {"interpreted", "unavailable"}


def test_empty_dump(spark, tmp_path):
    (tmp_path / "dump").mkdir()
    load.import_dump(spark, str(tmp_path / "dump"), str(tmp_path / "base"))
    assert all(spark.read.schema(TABLES[n]).parquet(f"{tmp_path}/base/{n}").count() == 0 for n in TABLES)
