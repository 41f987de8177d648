"""Corpus pipeline: toxicity filter, exact dedup, near-duplicate dedup, PII, packing.

Every stage takes the stored result of the one before it. A stage's decision takes
effect: toxic documents go, one document of each set of equal texts stays (the largest
doc_id), one of each group of near duplicates stays (the smallest doc_id; five words,
similarity 0.8 or more), identifiers are redacted, and the last stage gives the packed
pieces with their token ids.

Edge cases, as the stages' operators define them: null texts are scored as empty ones, kept
by the first stage and equal to empty texts in the second; texts without five words have no
near duplicates; an empty text gives one piece with the end id alone; of repeated rows one
stays; null ids are kept; other columns stay until the last stage; no documents give no
pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, jaccard, packing, pii, toxicity
from lodestone.llm.common import cut, scratch, stored


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_on_tables(spark, sf_dir, docs)
    return toxicity.with_scores(docs, model, name="__score").where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("toxicity", toxicity_filter), ("exact_dedup", exact), ("ngram_jaccard", near), ("pii", private), ("packing", pack)]

#: A trained model and a tokenizer cannot be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as path:
        for n, (name, stage) in enumerate(STAGES):
            docs = stored(stage(spark, docs, sf_dir), f"{path}/{n}_{name}")
        return cut(docs)
