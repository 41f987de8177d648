"""Versions of a base, the stored n-gram index, and call edges kept from version to version."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.catalog import Catalog
from lodestone.errors import BadArguments, SchemaMismatch
from lodestone.schema import TABLES, empty
from lodestone.sources import edges, gram_index, sinks, versions
from lodestone.tools import Tools
from tests.test_tools import tables


def frames(spark, changed=False, **other):
    rows = tables(changed) | other
    return {n: spark.createDataFrame(r, TABLES[n]) for n, r in rows.items()}


def test_versions(spark, tmp_path):
    base = str(tmp_path / "base")
    one = sinks.commit_base(spark, frames(spark), base)
    c = Catalog(spark)
    c.open(base, "first")
    two = sinks.commit_base(spark, frames(spark, True), base)
    assert (one.number, two.number) == (1, 2) and one.folder != two.folder and versions.numbers(spark, base) == [1, 2]
    c.open(base, "last")
    c.open(base, "old", version=1)
    assert [c.table("meta_attribute", a).count() for a in ("first", "last", "old")] == [5, 6, 5]  # an opened base stays what it was
    with pytest.raises(Exception, match="boom"):  # a writer that fails leaves no version
        sinks.commit_base(spark, {"module": empty(spark, "module").unionByName(spark.createDataFrame([(1, 1, "o", None, "")], TABLES["module"])).withColumn("body", F.raise_error(F.lit("boom")).cast("string"))}, base)
    assert versions.numbers(spark, base) == [1, 2] and versions.resolve(spark, base).id == two.id
    with pytest.raises(BadArguments):
        versions.resolve(spark, base, 7)
    assert not versions.create_text(spark, f"{base}/_versions/{2:012d}.json", "{}")  # a number is given once
    gone = versions.vacuum(spark, base)
    assert len(gone) == 2 and versions.numbers(spark, base) == [2] and Catalog(spark).open(base) and c.table("meta_attribute", "last").count() == 6


def test_the_manifest_says_the_revision(spark, tmp_path):
    base = str(tmp_path / "base")
    sinks.commit_base(spark, frames(spark), base)
    log = tmp_path / "base/_versions/000000000001.json"
    saved = json.loads(log.read_text())
    (tmp_path / "base/_versions/.000000000001.json.crc").unlink(missing_ok=True)
    log.write_text(json.dumps(saved | {"revision": 7}))
    c = Catalog(spark)
    c.open(base, "a")
    with pytest.raises(SchemaMismatch, match="revision 7"):
        c.check("a")
    assert c.status("a").first().error == "DB_SCHEMA"


def test_search_through_the_index(spark, tmp_path):
    base = str(tmp_path / "base")
    sinks.commit_base(spark, frames(spark), base)
    c = Catalog(spark)
    c.open(base, "a")
    c.open("/memory", "m", {n: d for n, d in (frames(spark) | {n: empty(spark, n) for n in TABLES if n not in tables()}).items()})
    t = Tools(c)
    texts = ["возврат", "ОбщийМодуль1", "ю", "нет такого", "КонецПроцедуры", "1)", "Экспортная(2)", 'ВЫБРАТЬ Т', "\n\t"]
    found = lambda: [[r.name for r in t.find_methods(text=x, db="a").collect()] for x in texts]
    scanned = found()
    assert t.index_status("a").first().indexed is False
    built = gram_index.build(spark, base)
    assert built["grams"] > 50 and t.index_status("a").first().indexed and found() == scanned and any(scanned)
    ids = gram_index.candidate_ids(spark, base, "Экспортная", gram_index.manifest(spark, base))
    assert {r.id for r in ids.collect()} == {1, 2, 3} and gram_index.candidate_ids(spark, base, "нет такого", built).count() == 0
    assert gram_index.candidate_ids(spark, base, "ю", built) is None
    assert t.find_methods(text="возврат", db="*").count() == 2 and {r.base: r.indexed for r in t.index_status("*").collect()} == {"a": True, "m": False}
    assert t.method_hits("Экспортная", db="a").count() == 3
    sinks.commit_base(spark, frames(spark, True), base)  # another version: the index no longer serves
    c.open(base, "b")
    assert "changed" in t.index_status("b").first().reason and [r.name for r in t.find_methods(text="экспортная(2)", db="b").collect()] == ["Тест", "Закрытая"]
    assert t.index_status("a").first().indexed and found() == scanned  # but it does for those who read the old one
    gram_index.build(spark, base)
    assert t.index_status("b").first().indexed and [r.name for r in t.find_methods(text="экспортная(2)", db="b").collect()] == ["Тест", "Закрытая"]
    assert not t.index_status("a").first().indexed and found() == scanned
    gone = gram_index.vacuum(spark, base)
    assert gone == [f"grams-{built['build']}"] and t.index_status("b").first().indexed
    log = sorted((tmp_path / "base/_grams").glob("*.json"))[-1]
    (log.parent / f".{log.name}.crc").unlink(missing_ok=True)
    log.write_text("{broken")
    assert not t.index_status("b").first().indexed and t.find_methods(text="экспортная(2)", db="b").count() == 2


def test_index_of_a_base_without_versions(spark, tmp_path):
    base = str(tmp_path / "base")
    sinks.write_base(spark, frames(spark), base)
    gram_index.build(spark, base)
    c = Catalog(spark)
    c.open(base, "a")
    t = Tools(c)
    assert t.index_status().first().indexed and [r.name for r in t.find_methods(text="возврат").collect()] == ["Экспортная"]
    spark.createDataFrame(tables(True)["method"], TABLES["method"]).write.mode("overwrite").parquet(f"{base}/method")
    assert not t.index_status().first().indexed


def edge_rows(df):
    return sorted((r.depth, r.kind, r.src, r.line) for r in df.collect())


def test_edges(spark, tmp_path):
    more = tables(True)
    more["module"] = [*more["module"], (9, 3, "frm", None, "")]
    more["method"] = [*more["method"], (9, 9, 0, "процедура", "Форма", "", False, "", "", 5, 9, 'Процедура Форма()\n\tТест();\n\tОбъект.Закрытая();\n\tВыполнить("ОбщийМодуль1.Закрытая");\n\tНеизвестная();\n\t// Общиймодуль1.Экспортная()\nКонецПроцедуры')]
    base = str(tmp_path / "base")
    first = sinks.commit_base(spark, frames(spark, method=more["method"], module=more["module"]), base)
    c = Catalog(spark)
    c.open(base, "a")
    t = Tools(c)
    got = t.callers("CommonModule/ОбщийМодуль1", "закрытая", 3)
    closed, test = "commonmodule/общиймодуль1/закрытая", "catalog/справочник1/тест"
    form = "catalog/справочник1/form/формаэлемента/форма"
    want = [(1, "code", test, 5), (1, "string", form, 8), (1, "unconfirmed", form, 7)]
    assert edge_rows(got) == want
    assert edge_rows(t.callers("Catalog/Справочник1", "Закрытая", 1)) == [(1, "intercept", test, 3), (1, "unconfirmed", form, 7)]
    files = {f.rsplit("/", 2)[-2] for f in got.inputFiles()}
    assert files == {"call_edge"}  # callers read no body
    down = edge_rows(t.callees("CommonModule/ОбщийМодуль1", "закрытая", 2))
    assert down == [(1, "code", closed, 6)]
    assert {r.dst for r in t.callees("Catalog/Справочник1", "Тест", 2).where("kind = 'code'").collect()} == {"commonmodule/общиймодуль1/" + n for n in ("экспортная", "закрытая", "нету")}
    memory = Catalog(spark)
    memory.open("/m", "m", {n: d for n, d in (frames(spark, method=more["method"], module=more["module"]) | {n: empty(spark, n) for n in TABLES if n not in more}).items()})
    assert edge_rows(Tools(memory).callers("CommonModule/ОбщийМодуль1", "закрытая", 3)) == want
    changed = [(*r[:-1], r[-1].replace("Тест();", "Тест(1);")) if r[0] == 9 else r for r in more["method"] if r[1] != 2]
    old = spark.read.parquet(f"{first.folder}/call_site")
    all_, fresh = edges.refresh(old, spark.createDataFrame(changed, TABLES["method"]), spark.createDataFrame(more["module"], TABLES["module"]))
    assert [r.module_id for r in fresh.collect()] == [9]  # one module changed, one is gone, one is as it was
    whole = edges.parse(spark.createDataFrame(changed, TABLES["method"]), spark.createDataFrame(more["module"], TABLES["module"]))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(all_) == key(whole)
    with pytest.raises(BadArguments):
        t.callers("CommonModule/ОбщийМодуль1", "закрытая", 4)


def test_events_are_edges(spark):
    parsed = edges.parse(empty(spark, "method"), empty(spark, "module"))
    events = spark.createDataFrame([("EventSubscription/П", "CommonModule/М", "Обработать")], "path string, handler_path string, method string")
    found = edges.resolve(parsed, empty(spark, "meta_object"), empty(spark, "method"), empty(spark, "module"), events)
    assert [(r.kind, r.src, r.dst) for r in edges.callers(found, "CommonModule/М", "обработать", 2).collect()] == [("event", "eventsubscription/п", "commonmodule/м/обработать")]
