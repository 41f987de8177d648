"""Many needles in many texts: postings and verification against a brute-force contains."""

import random
from collections import Counter

from lodestone.operators import needles

ALPHABET = ["Справочники", "Справочник", "справ", ".", "X", "Xy", "_", " ", "\n", "ё", "//", "а", "Σ", "1", "%", "\\", "(", "кx"]


def some_text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_hits_equal_contains(spark):
    rng = random.Random(7)
    texts = [(i % 3, i, some_text(rng, rng.randint(0, 40))) for i in range(120)] + [(0, 900, None), (0, 901, ""), (1, 901, "СПРАВОЧНИКИ.X")]
    wanted = [(i, some_text(rng, rng.randint(1, 4))) for i in range(80)] + [(900, None), (901, ""), (902, "справочники.x"), (902, "справочники.x"), (903, "нет такого"), (904, "\n"), (905, "и.X")]
    t = spark.createDataFrame(texts, "kind int, id long, text string").repartition(3)
    n = spark.createDataFrame(wanted, "no int, needle string")
    got = needles.hits(n, "needle", t, ["kind", "id"], "text")
    want = Counter((no, w, k, i) for no, w in wanted for k, i, x in texts if w and x and w.lower() in x.lower())
    assert Counter((r.no, r.needle, r.kind, r.id) for r in got.collect()) == want and len(want) > 100
    stored = needles.token_postings(t, ["kind", "id"], "text")
    assert needles.hits(n, "needle", t, ["kind", "id"], "text", stored).count() == want.total()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    lines = {(r.no, r.kind, r.id): r.line for r in needles.first_lines(got, t, ["kind", "id"], "text", "needle").collect()}
    by_id = {(k, i): x for k, i, x in texts}
    assert all(line == by_id[k, i].lower()[: by_id[k, i].lower().index(dict(wanted)[no].lower())].count("\n") + 1 for (no, k, i), line in lines.items())


def test_no_needles_and_no_texts(spark):
    t = spark.createDataFrame([(1, "a")], "id long, text string")
    n = spark.createDataFrame([("a",)], "needle string")
    assert needles.hits(n.limit(0), "needle", t, ["id"], "text").collect() == [] and needles.hits(n, "needle", t.limit(0), ["id"], "text").collect() == []


def test_top_per(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "k string, v int")
    assert sorted((r.k, r.v, r.n) for r in needles.top_per(df, ["k"], ["v"], 2).collect()) == [("a", 0, 5), ("a", 1, 5), ("b", 1, 1)]
