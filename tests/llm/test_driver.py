"""What the near-duplicate join asks of the driver: no rounds that little input does not need."""

import importlib

from pyspark.sql import functions as F

from lodestone.llm import jaccard

stars = importlib.import_module("lodestone.llm.components")
DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_few_texts_take_one_round(spark, monkeypatch):
    docs = spark.read.parquet(DOCS)
    near = docs.select(F.col("doc_id") + 1_000_000, F.concat("text", F.lit(" more")).alias("text"))
    with jaccard.scratch(spark) as path:
        docs.select("doc_id", "text").union(near).write.parquet(f"{path}/docs")
        docs, seen, kept = spark.read.parquet(f"{path}/docs"), [], jaccard.stored
        monkeypatch.setattr(jaccard, "stored", lambda df, to: seen.append(to.rpartition("/")[2]) or kept(df, to))
        few = sorted(map(tuple, jaccard.similar_groups(docs).select("id", "n_shingles", "component_id").collect()), key=str)
        assert sum(s.startswith("met") for s in seen) == 1
        seen.clear()
        monkeypatch.setattr(jaccard, "ROUND_WORDS", 1)
        many = sorted(map(tuple, jaccard.similar_groups(docs).select("id", "n_shingles", "component_id").collect()), key=str)
        assert sum(s.startswith("met") for s in seen) == jaccard.ROUNDS
    assert few == many and any(i != c for i, _, c in few)


def test_rounds_follow_the_words():
    assert jaccard.rounds_for({}) == jaccard.rounds_for({0: 5.0, 8: 50_000.0}) == 1
    assert jaccard.rounds_for({9: 2.0e5}) == jaccard.ROUNDS == jaccard.rounds_for({9: 1.0e12})


def test_components_stop_at_stars(spark, monkeypatch):
    """Stars take no round, a path takes some, and none follows the one that leaves stars."""
    calls, star = [], stars._star
    monkeypatch.setattr(stars, "_star", lambda edges, small: calls.append(small) or star(edges, small))
    own = lambda edges: {r.node: r.component for r in stars.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert own([(1, 2), (3, 1), (5, 4), (4, 5), (None, 2), (9, 9)]) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} and not calls
    assert own([(2, 1), (3, 2)]) == {1: 1, 2: 1, 3: 1} and len(calls) == 2
    assert own([(1, 3), (2, 3)]) == {1: 1, 2: 1, 3: 1} and len(calls) == 4
    assert own([]) == {} and len(calls) == 4
