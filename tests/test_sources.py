"""Sources and sinks on hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.errors import DataError
from lodestone.schema import TABLES
from lodestone.sources import brace, container, dump, rights_file, sinks, xdto

U = [f"{i:08x}-0000-0000-0000-000000000000" for i in range(10)]


@pytest.mark.parametrize(("text", "value"), [
    ('{1,"строка",2}\n', [["1", '"строка"', "2"]]), ('{"a,b","c}d","e{f",""}', [['"a,b"', '"c}d"', '"e{f"', '""']]), ('{"раз\nдва"}', [['"раз\nдва"']]), ("{1,\n{2,3},4}\n", [["1", ["2", "3"], "4"]]),
    ("{a,\n{b,\n{c,\n{d}\n}\n}\n}\n", [["a", ["b", ["c", ["d"]]]]]), ("{#base64:AAAA\n}\n", [["#base64:AAAA"]]), ("{#base64:AAAA\nBBBB}", [["#base64:AAAABBBB"]]), ("", []), ("{1,\n{2,3},,60}\n", [["1", ["2", "3"], None, "60"]]),
    ("{49,0,0,1,\n}\n", [["49", "0", "0", "1", ""]]), ("{1,\n{2,\n},6,7,\n}\n", [["1", ["2", ""], "6", "7", ""]]), ("{a,\n{b,\n{c,\n}}}\n", [["a", ["b", ["c", ""]]]]), ("{}", [[]]), ('{"он ""да"", и"}', [['"он ""да"", и"']])])
def test_brace(text, value):
    assert brace.parse(text) == value


@pytest.mark.parametrize("text", ["просто текст\nещё", "{1", "{1}}", '{"не закрыта}'])
def test_brace_refuses(text):
    with pytest.raises(DataError):
        brace.parse(text)


def test_brace_in_spark(spark):
    df = spark.createDataFrame([(b'{1,{2,"x"}}',), (b"no brace",), (None,), ("{\"я\"}".encode("cp1251"),)], "b binary")
    got = [r[0] for r in df.select(brace.to_json(df.b)).collect()]
    assert [json.loads(x) if x else x for x in got] == [[["1", ["2", '"x"']]], None, None, [['"я"']]]
    assert brace.uuids([["x", U[1].upper(), [U[2], U[1]]]]) == [U[1], U[2]]


def test_container(spark, tmp_path):
    inner = container.pack_small({"deep.txt": b"in"}, deflate=False)
    files = {"имя.txt": b"hello" * 500, "empty": b"", "box": inner}
    data = container.pack_small(files)
    assert dict(container.unpack(data)) == {"имя.txt": files["имя.txt"], "empty": b"", "box/deep.txt": b"in"}
    (tmp_path / "a.cf").write_bytes(data)
    (tmp_path / "b.cf").write_bytes(b"not a container at all, but long enough to be read")
    rows = container.read_containers(spark, str(tmp_path), "*.cf").collect()
    assert {r.name for r in rows if r.error is None} == {"имя.txt", "empty", "box/deep.txt"} and sum(r.error is not None for r in rows) == 1


def role_file():
    return (f'{{10,{{3,{{{{1,{U[1]},0,0}},{{0,{U[5]},1,{U[6]},-1}}}},{{{{1,{U[2]},1,{{-2,{U[3]}}},1}},{{1,1,{U[5]},1,1,{{{U[5]},{{1,{{1,"ГДЕ А = &Б",0}}}}}}}}}},{{{{1,{U[1]},1,1}},{{0,{U[6].upper()},-1}}}}}},'
            '{1,{"Для(П)","ГДЕ ""х"""}},4294967295,1}').encode()


def test_rights(spark):
    r = rights_file.parse(role_file().decode())
    assert [(t.uuid, t.flags, t.sub_index, t.collection) for t in r.targets] == [(U[1], "0/0", None, None), (U[2], "1/1", -2, U[3]), (U[1], "1/1", None, None)]
    assert [(x.uuid, x.value, x.rls) for t in r.targets for x in t.rights] == [(U[5], "1", None), (U[6], "-1", None), (U[5], "1", "ГДЕ А = &Б"), (U[6], "-1", None)]
    assert r.templates == [("Для(П)", 'ГДЕ "х"')]
    files = spark.createDataFrame([(1, role_file()), (2, b"{7,{0},{0}}"), (3, b"broken {")], "role long, content binary")
    rows = rights_file.read_rights(files, "role", "content").collect()
    states = {x.role: x.state for x in rows if x.state is not None}
    assert states[1].parsed and states[1].rights == 4 and states[1].targets == 3 and not states[2].parsed and not states[3].parsed and states[3].error
    assert sum(x.role == 1 and x.right_uuid is not None for x in rows) == 4


def test_xdto():
    text = b"""<package xmlns="urn:schema-packages" xmlns:d2p1="urn:base" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" targetNamespace="urn:t"><import namespace="urn:base"/>
      <objectType name="Item" base="d2p1:Base"><property name="Code" type="d2p1:S" lowerBound="1" form="Attribute"/><property name="Rows" lowerBound="0" upperBound="-1">
      <typeDef xsi:type="ObjectType"><property name="No" type="x"/></typeDef></property></objectType>
      <valueType name="Kind" base="xs:string" maxLength="20"><pattern>a+</pattern><enumeration>In</enumeration><enumeration>Out</enumeration></valueType><property name="Root" localName="root"/></package>"""
    p = xdto.parse(text)
    assert (p.namespace, p.imports) == ("urn:t", ["urn:base"])
    types, properties = xdto.flatten(p)
    assert [(t[2], t[3], t[5], t[6], t[7]) for t in types] == [("Item", "objectType", "urn:base", None, None), (None, "typeDef", None, "type=ObjectType", None), ("Kind", "valueType", None, "maxLength=20; pattern=a+", "In | Out")]
    assert [(q[1], q[3], q[6], q[7], q[11]) for q in properties] == [(0, "Code", 1, None, None), (0, "Rows", 0, -1, 1), (1, "No", None, None, None), (None, "Root", None, None, None)]
    facets = xdto.parse(b'<package xmlns:a="urn:a"><objectType name="T" open="true" variety="Atomic" length="" a:z="1" a:b="2"/><property name="P" default="x" base="q" ref="r"/></package>')
    assert facets.types[0].facets == "variety=Atomic; open=true; b=2; z=1" and facets.properties[0].extra == "base=q; ref=r; default=x"
    assert xdto.parse(b"<html/>") is None and xdto.parse(b"<package><broken></package>") is None


def test_dump_and_base(spark, tmp_path):
    root = tmp_path / "dump"
    for d, t in (("", "Configuration"), ("Catalog/Товар", "Catalog"), ("Catalog/Товар/CatalogForm/Форма", "CatalogForm")):
        folder = root / d
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{t}.json").write_text("[]")
        (folder / f"{t}.id.json").write_text("{}")
    (root / "Catalog/Товар/Catalog.obj.bsl").write_bytes("﻿Процедура А()\nКонецПроцедуры".encode())
    (root / "Catalog/Товар/Catalog.mgr.bsl").write_bytes("Функция Б()".encode("cp1251"))
    (root / "Catalog/Товар/Template.0.bin").write_bytes("<x><query>\n ВЫБРАТЬ 1 &lt; 2 </query><d:query a='1'>Q2</d:query><query> </query></x>".encode())
    files = dump.file_map(spark, str(root))
    assert files.count() == 9 and files.where("kind = 'bin' and data is not null").count() == 0
    objects = {r.path: r for r in dump.objects(files).collect()}
    assert [objects[p].id for p in ("", "Catalog/Товар", "Catalog/Товар/CatalogForm/Форма")] == [1, 2, 3]
    assert [objects[p].parent_id for p in ("", "Catalog/Товар", "Catalog/Товар/CatalogForm/Форма")] == [None, 1, 2]
    bodies = {r.code_name: r.body for r in dump.modules(files).collect()}
    assert bodies["obj"].startswith("Процедура") and bodies["mgr"] == "Функция Б()"
    assert [r.query for r in dump.report_queries(dump.file_map(spark, str(root), True)).orderBy("ord").collect()] == ["ВЫБРАТЬ 1 < 2", "Q2"]
    base = str(tmp_path / "base")
    meta = dump.objects(files).select("id", "parent_id", "path", "type", "name")
    sinks.write_base(spark, {"meta_object": meta}, base)
    sinks.write_base(spark, {"meta_object": meta}, base)
    assert spark.read.parquet(f"{base}/meta_object").count() == 3 and spark.read.parquet(f"{base}/role_right").count() == 0
    assert spark.read.parquet(f"{base}/meta_object").columns == [c.split()[0] for c in TABLES["meta_object"].split(", ")]
    assert [p.name for p in (tmp_path / "base").parent.iterdir() if p.name.startswith("base.")] == []
    with pytest.raises(Exception, match="no such column|UNRESOLVED|boom|cannot"):  # a write that fails leaves the old base as it was
        sinks.write_base(spark, {"meta_object": meta.withColumn("name", F.raise_error(F.lit("boom")).cast("string"))}, base)
    assert spark.read.parquet(f"{base}/meta_object").count() == 3
    sha = dump.fingerprint_state(spark, str(root / "Catalog/Товар/Catalog.obj.bsl"), None).first()
    assert sha.state == "new" and dump.fingerprint_state(spark, str(root / "Catalog/Товар/Catalog.obj.bsl"), sha.sha256).first().state == "skip"


def _brace(x):
    return "{" + ",".join(map(_brace, x)) + "}" if isinstance(x, list) else str(x)


def _rows(rows):
    return ["1", len(rows), *rows]


def test_predefined(spark):
    from lodestone.sources import predefined

    ref = lambda u: ['"#"', U[9], ["1", u]]
    text = lambda s: ['"S"', f'"{s}"']
    flag = lambda b: ['"B"', b]
    column = lambda n, kind, name='""': [n, name, ['"Pattern"', *kind], '""', "0"]
    row = lambda n, values, children=(): ["2", n, len(values), *values, *([_rows(children)] if children else [])]
    table = lambda cols, rows: [[len(cols), *cols], ["2", len(cols), *[x for i, c in enumerate(cols) for x in (i, c[0])], _rows(rows), "-1"]]
    inner = [column(0, [['"#"', U[9]]]), column(1, [['"B"']], U[1]), column(2, [['"B"']], U[2]), column(3, [['"B"']])]
    kinds = lambda *k: ['"#"', U[8], ["9", *table(inner, [row(i, [ref(u), flag(a), flag(b), flag(1)]) for i, (u, a, b) in enumerate(k)])]]
    cols = [column(1, [['"#"', U[9]]]), column(2, [['"S"']]), column(3, [['"S"', "8"]]), column(4, [['"S"', "9"]]), column(5, [])]
    tree = row(0, [ref(U[0]), text("Счета"), text(""), text(""), ['"U"']], [
        row(1, [ref(U[3]), text("Средства"), text("01"), text("Основные"), kinds((U[5], 1, 0))], [row(2, [ref(U[4]), text("Орг"), text("01.01"), text('В ""орг""'), kinds((U[5], 1, 1), (U[6], 0, 0))])])])
    content = _brace(["2", ["1", *table(cols, [tree])]])
    header = [["3", ["1", "0", U[1]], '"Суммовой"'], ["3", ["1", "0", U[2]], '"Валютный"']]
    got = predefined.items(content, header)
    assert [(i.ord, i.parent, i.name, i.code, i.display) for i in got] == [(0, None, "Счета", "", ""), (1, 0, "Средства", "01", "Основные"), (2, 1, "Орг", "01.01", 'В "орг"')]
    assert got[1].kinds == ((U[5], "Суммовой"),) and got[2].kinds == ((U[5], "Суммовой;Валютный"), (U[6], None)) and got[1].uuid == U[3]
    two = [column(0, [['"#"', U[9]]]), column(3, [['"S"']]), column(5, [['"S"']])]
    assert [(i.name, i.code, i.display) for i in predefined.items(_brace(["0", ["1", *table(two, [row(0, [ref(U[0]), text("а"), text("б")])])]]))] == [("а", "", "б")]
    df = spark.createDataFrame([(1, content), (2, "{1}"), (3, None)], "id long, text string")
    bad = spark.createDataFrame([(1, "{1,2}"), (2, ""), (3, "no brace file")], "id long, text string")
    assert {r.id for r in predefined.unreadable(bad, ["id"], "text").collect()} == {1, 2, 3} and predefined.unreadable(df, ["id"], "text").count() == df.count() - predefined.read_items(df, ["id"], "text").select("id").distinct().count()
    assert [r.name for r in predefined.read_items(df, ["id"], "text").collect()] == ["Счета", "Средства", "Орг"]
