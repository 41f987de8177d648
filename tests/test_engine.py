"""Queries against their SQL, paging, catalog, rights and graphs."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.catalog import Catalog
from lodestone.errors import BadArguments, BadRequest, SchemaMismatch, category
from lodestone.functions import paths
from lodestone.operators import diff, graph, paging, rights, sampling, search, tree
from lodestone.plans import registry
from lodestone.schema import TABLES
from lodestone.sources import links
from lodestone.sql_access import rewrite_paths, run_sql
from lodestone.streaming import ingest

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted(tuple(map(str, r)) for r in df.collect())
    rel = duck.execute(SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    assert got == sorted(tuple(str(r[i]) for i in order) for r in rel.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) > 110


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_pages_are_a_partition(spark):
    df = spark.range(0, 95).selectExpr("id", "id % 7 AS k")
    pages = [r.id for o in range(0, 100, 10) for r in paging.page(df, ["k", "id"], 10, o).collect()]
    assert pages == [r.id for r in df.orderBy("k", "id").collect()]
    assert paging.clamp(0) == 1 and paging.clamp(None) == 20 and paging.clamp(1000) == 200
    note = paging.page_note(df, 10, 90).first()
    assert (note.total, note["first"], note["last"], note.next_offset) == (95, 91, 95, None)
    assert paging.page_note(df, 10, 500).first()["first"] == 0


def test_masks(spark):
    df = spark.createDataFrame([("Поле Один",), ("полеодин",), (None,), ("100%",)], "n string")
    assert df.where(search.mask(["n"], "ЕОД")).count() == 2 and df.where(search.mask(["n"], "")).count() == 4
    assert df.where(search.mask(["n"], "%")).count() == 1 and df.where(search.mask(["n"], "п%один", literal=False)).count() == 2


@pytest.mark.parametrize("needle", ["onth", "th", "zzz", "The ", "a"])
def test_index_and_scan_agree(spark, needle):
    q = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    scan = q.where(search.body_has(q.text, search.F.lit(needle)))
    found = search.index_search(q, search.ngram_postings(q, "item_id", "text"), "item_id", "text", needle)
    assert sorted(r.item_id for r in found.collect()) == sorted(r.item_id for r in scan.collect())


def test_rights_keys(spark):
    r = spark.createDataFrame([("a", 1, "0/0", "R", None), ("a", 1, "0/0", "W", "x"), ("b", None, "1/1", "R", "y" * 700), ("a", 1, "1/1", "W", None)], "target string, sub int, flags string, rights string, rls string")
    assert rights.targets(r, ["target", "sub", "flags"]).count() == 3 and rights.effective(r.withColumn("role", r.flags), ["target", "sub", "rights"]).count() == 3
    stats = rights.target_stats(r, ["target", "sub", "flags"], "sub", "rls").first()
    assert (stats.targets, stats.resolved, stats.unresolved, stats.rights, stats.with_rls, stats.long_rls) == (3, 2, 1, 4, 2, 1)
    sides = {(x.target, x["sub"]): x.side for x in rights.role_diff(r.where("target = 'b'"), r, ["target", "sub"]).collect()}
    assert sides == {("b", None): "common", ("a", 1): "only_b"}


def test_trees_and_graphs(spark):
    nodes = spark.createDataFrame([(1, None, None, "r"), (2, 1, 5, "b"), (3, 1, 1, "a"), (4, 3, None, "x")], "id long, parent_id long, ord long, name string")
    assert [r.name for r in tree.subtree(nodes, nodes.id == 1, 2).orderBy("sort_key").collect()] == ["r", "a", "x", "b"]
    assert [r.name for r in tree.ancestors(nodes, nodes.id == 4).orderBy("steps").collect()] == ["x", "a", "r"]
    p = spark.createDataFrame([(1, ""), (2, "A/b"), (3, "A/b/C/d"), (4, "A/bb"), (5, "A/b/C/d/E/f")], "id long, path string")
    assert {r.id: r.parent_id for r in tree.nearest_parent(p).collect()} == {2: 1, 3: 2, 4: 1, 5: 3}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.depth for r in graph.bfs(e, start, 3).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_sampling(spark):
    df = spark.range(0, 10_000).selectExpr("id * 3 AS k", "CASE WHEN id < 9999 THEN 'a' ELSE 'b' END AS kind").repartition(7)
    assert [(r.k, r.i) for r in sampling.row_index(df, "k").orderBy("k").collect()] == [(3 * i, i) for i in range(10_000)]
    got = sorted(r.k // 3 for r in sampling.systematic_sample(df, "k", "kind", 1000).collect())
    assert len(got) == 1001 and max(b - a for a, b in zip(got, got[1:])) <= 22 and 9999 in got
    assert sampling.systematic_sample(df.limit(5), "k", "kind", 10).count() == 5


def test_catalog(spark, tmp_path):
    c = Catalog(spark)
    part = spark.range(3)
    assert [c.open("/x/base.db", tables={"t": part}), c.open("/y/base", tables={"t": part}), c.open("/z/bad", tables={"t": part}, revision=1)] == ["base", "base_2", "bad"]
    assert c.scope() == ["base"] and c.scope("*") == ["base", "base_2", "bad"]
    assert c.table("t", "*").count() == 6 and {r.base: r.status for r in c.status("*").collect()} == {"base": "ok", "base_2": "ok", "bad": "error"}
    with pytest.raises(SchemaMismatch):
        c.table("t", "bad")
    c.group_create("Все")
    c.group_add("ВСЕ", "base_2")
    assert c.scope(group="все") == ["base_2"] and c.group_list().count() == 1
    c.close("base_2")
    assert c.scope(group="все") == [] and c.list().count() == 2
    c.use("bad")
    assert c.scope() == ["bad"]
    for call in (lambda: c.use("no"), lambda: c.group_use("no"), lambda: c.group_create("все")):
        with pytest.raises(BadArguments):
            call()
    assert category(BadRequest("x")) == "BAD_REQUEST" and category(ValueError()) == "BAD_ARGS" and len(TABLES) == 22


def test_sql_access(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    assert run_sql(spark, "SELECT * FROM numbers").count() == 200 and run_sql(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a").count() == 1
    for text in ("DROP VIEW numbers", "CREATE TABLE x (a int)", "INSERT INTO numbers VALUES (1)", "SET a = b", "SELEC 1"):
        with pytest.raises(BadRequest):
            run_sql(spark, text)
    assert rewrite_paths("a = 'Справочник.Х' AND b = 'x.y'") == "a = 'Catalog/Х' AND b = 'x.y'"


def test_small_functions(spark):
    df = spark.createDataFrame([("Catalog/X/CatalogForm/Y", '"a""b"', 80321, "on_before_x", "a/b.CF", "p:n")], "p string, q string, c int, e string, f string, n string")
    r = df.select(paths.russian_path(df.p), paths.unquoted(df.q), paths.compatibility(df.c), paths.event_name(df.e), paths.source_ext(df.f), paths.local_name(df.n)).first()
    assert tuple(r)[:5] == ("Справочник.X.Y", 'a"b', "8.3.21", "before_x", "cf") and tuple(r[5]) == ("p", "n")


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"f{i}.bin").write_bytes(b"x" * (i % 2 + 1))
    for n in (2, 3):
        ingest.ingest_new(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).select("sha256").count() == n
        (src / "new.bin").write_bytes(b"zz")
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user int, t string").selectExpr("user", "CAST(t AS TIMESTAMP) AS ts")
    assert sorted(r.n for r in ingest.session_counts(events, "ts", "user").collect()) == [1, 2]


def test_hierarchies_of_any_depth(spark):
    """Chains deeper than what is climbed without asking, long ids and ordinals, and a ring."""
    nodes = spark.createDataFrame([(i, i - 1 if i else None, i, f"n{i}") for i in range(40)], "id long, parent_id long, ord long, name string")
    assert [r.node for r in tree.ancestors(nodes, F.col("id") == 39).orderBy("steps").collect()] == list(range(39, -1, -1))
    assert tree.ancestors(nodes, F.col("id") == 39, most=3).count() == 4
    wide = spark.createDataFrame([(1, None, 0, "root"), (1234567890123, 1, 5, "a"), (1234567890129, 1, 5, "b"), (7, 1, 123456789, "c"), (8, 1, 12345678, "d")], nodes.schema)
    assert [r.name for r in tree.subtree(wide, F.col("id") == 1, 1).orderBy("sort_key").collect()] == ["root", "a", "b", "d", "c"]


def test_links_take_whole_values_only(spark):
    u = "0a1b2c3d-0000-1111-2222-333344445555"
    objects = spark.createDataFrame([(1, f'["{u}", "x {u}", "9{u}"]'), (2, f'["pre-{u}", null]'), (3, None)], "id long, header_json string")
    assert [(r.id, r.pos, r.uuid) for r in links.header_uuids(objects).collect()] == [(1, 0, u)]


def test_ranked_match_prefers_the_same_module(spark):
    calls = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (2, 1, 6), (3, 9, 5), (4, 1, None), (5, None, 5)], "call long, obj long, module long")
    methods = spark.createDataFrame([(1, 5, 30), (1, 5, 20), (1, 7, 10), (1, None, None), (2, 5, 1)], "obj long, module long, tie long")
    got = sorted((r.call, r.found_in or 0, r.found or 0) for r in diff.ranked_match(calls, methods, ["obj"], "module", "tie").collect())
    assert got == [(1, 5, 20), (2, 7, 10), (2, 7, 10), (3, 0, 0), (4, 7, 10), (5, 0, 0)]


def test_bfs_cuts_what_it_saw(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(3, 1)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.depth for r in graph.bfs(edges, start, 6).collect()} == {i: i for i in range(7)}
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    assert {r.node: r.depth for r in graph.bfs(edges, start, 30).collect()} == {i: i for i in range(13)}
