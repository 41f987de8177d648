"""The n-gram index: each body is cut once and in linear time, postings are stored by blocks of bodies."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.sources import gram_index

LETTERS = ["а", "Б", "ё", "Σ", "İ", "x", "X", " ", "\n", "\0", "😀", "﻿", "1", '"', "\U0010ffff"]


def test_postings_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(200, None), (None, "без ключа"), (201, "ааааа"), (202, "аБв")]
    df = spark.createDataFrame(rows, "id long, body string").repartition(3)
    low = {r.id: r.low for r in df.select("id", F.lower("body").alias("low")).collect() if r.low}
    for n in (1, 2, 3, 4, 6):
        for chars in (1 << 20, 50):
            monkeypatch.setattr(search, "BLOCK_CHARS", chars)
            got = [(r.id, r.gram) for r in search.ngram_postings(df, "id", "body", n).collect()]
            assert len(got) == len(set(got)) and set(got) == {(k, t[i : i + n]) for k, t in low.items() for i in range(len(t) - n + 1)}


def test_rows_of_frequent_grams_are_bounded():
    grams, offsets, rows = search._inverted(["абв", "абвг"] * 1000, 3)
    parts = [(g, rows[a:b].tolist()) for g, a, b in zip(grams, offsets[:-1], offsets[1:], strict=True)]
    assert max(len(r) for _, r in parts) == search.BLOCK_KEYS and len(parts) == 8 + 4
    assert sorted(i for g, r in parts if g == "абв" for i in r) == list(range(2000)) and sorted(i for g, r in parts if g == "бвг" for i in r) == list(range(1, 2000, 2))


def test_long_bodies_are_cut_in_linear_time(spark):
    text = " ".join(f"имя{i * 7919 % 100003}" for i in range(40_000))
    df, start = spark.createDataFrame([(1, text)], "id long, body string"), time.monotonic()
    assert search.ngram_postings(df, "id", "body").count() == len({text[i : i + 3] for i in range(len(text) - 2)})
    assert time.monotonic() - start < 30  # minutes where each n-gram is looked for from the text's beginning


def test_index_cuts_bodies_once_and_stores_blocks(spark, tmp_path, monkeypatch):
    base, log, cut = str(tmp_path / "base"), str(tmp_path / "log"), search._inverted
    method = spark.range(400).coalesce(1).select(F.col("id"), F.concat(F.lit("Функция Имя"), F.col("id") % 10, F.lit("()")).alias("body"))
    method.write.parquet(f"{base}/method")

    def logged(texts, n):
        with open(log, "a") as f:
            f.write(f"{len(texts)} {os.getpid()}\n")
        return cut(texts, n)

    monkeypatch.setattr(search, "_inverted", logged)
    built = gram_index.build(spark, base)
    lines = [line.split() for line in open(log)]
    assert sum(int(n) for n, _ in lines) == 400 and len(lines) > 1  # one pass, though the table is one split
    where = f"{base}/grams-{built['build']}"
    postings = spark.read.parquet(f"{where}/postings")
    texts = {r.id: r.body.lower() for r in method.collect()}
    pairs = {(t[i : i + 3], k) for k, t in texts.items() for i in range(len(t) - 2)}
    got = [tuple(r) for r in postings.select("gram", F.explode("ids")).collect()]
    assert len(got) == len(set(got)) == built["postings"] and set(got) == pairs and postings.count() <= built["grams"] * len(lines) < len(pairs) / 4
    assert {r.gram: r.df for r in spark.read.parquet(f"{where}/frequencies").collect()} == {g: sum(p[0] == g for p in pairs) for g in {p[0] for p in pairs}}
    assert sorted(n for n in os.listdir(where) if not n.startswith(".")) == ["frequencies", "postings"]
    assert {r.id for r in gram_index.candidate_ids(spark, base, "Имя7(", built).collect()} == set(range(7, 400, 10))


def test_index_of_another_layout_is_refused(spark, tmp_path):
    base = str(tmp_path / "base")
    spark.range(3).select("id", F.lit("Функция").alias("body")).write.parquet(f"{base}/method")
    gram_index.build(spark, base)
    gram_index.manifest(spark, base)
    log = sorted((tmp_path / "base/_grams").glob("*.json"))[-1]
    (log.parent / f".{log.name}.crc").unlink(missing_ok=True)
    log.write_text(json.dumps({k: v for k, v in json.loads(log.read_text()).items() if k != "layout"}))
    with pytest.raises(gram_index.StaleIndex, match="layout"):
        gram_index.manifest(spark, base)
