"""Steps of the near-duplicate join that bound its disk."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestone.llm import jaccard

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_signatures_go_before_sets_are_compared(spark, monkeypatch):
    seen, folder = [], {}
    old, verify = jaccard.scratch, jaccard._verify

    class Scratch:
        def __init__(self, spark):
            self.inner = old(spark)

        def __enter__(self):
            folder["path"] = self.inner.__enter__()
            return folder["path"]

        def __exit__(self, *error):
            return self.inner.__exit__(*error)

    def spy(*args):
        for file in glob.glob(folder["path"].removeprefix("file:").replace("///", "/") + "/**/*.parquet", recursive=True):
            seen.append([n for n in pq.ParquetFile(file).schema_arrow.names if n.startswith("sigs")])
        return verify(*args)

    monkeypatch.setattr(jaccard, "scratch", Scratch)
    monkeypatch.setattr(jaccard, "_verify", spy)
    assert jaccard.similar_groups(spark.read.parquet(DOCS)).count() == spark.read.parquet(DOCS).count()
    assert seen and not any(seen)


def test_rounds_cover_all_signatures(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 101}" for k in range(60 + i % 9))) for i in range(40)], "id long, text string").withColumn("row", F.col("id"))
    plan = jaccard.make_plan(85, 100, {6: 40.0})
    rows = jaccard._describe(docs, 4, plan).select(*jaccard.SIGS, "n").collect()
    assert len(jaccard.SIGS) == jaccard.ROUNDS > 1 and all(r["n"] for r in rows)
    size = (1 << 64) // jaccard.ROUNDS
    for k, name in enumerate(jaccard.SIGS):
        assert any(r[name] for r in rows)
        assert all((s % (1 << 64)) // size == k for r in rows if r[name] for s in r[name])
