"""The pipeline's stages, one by one, on planted documents."""

import pytest

import corpus_pipeline as C
from lodestone.llm import packing, pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """name -> rows after the stage; the input is sf0.001 with planted documents."""
    base = tmp_path_factory.mktemp("pipeline")
    sf = "/root/testdata/sf0.01"
    words = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    near = list(words)
    near[5] = "changedword"
    extra = [(10_001, " ".join(words)), (10_002, " ".join(near)), (10_003, "exact copy of a text that is there twice"), (10_004, "exact copy of a text that is there twice"),
             (10_005, "you are such an idiot and a moron you worthless scum " * 3), (10_006, "write to some.one@example.org or +1 (366) 555-9807 today"), (10_007, None), (10_008, "")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in extra], COLUMNS))
    docs.write.parquet(str(base / "documents.parquet"))
    import os

    os.symlink(f"{sf}/labels.parquet", base / "labels.parquet")
    docs, out = spark.read.parquet(str(base / "documents.parquet")), {"input": spark.read.parquet(str(base / "documents.parquet")).toPandas()}
    for name, stage in C.STAGES:
        stage(spark, docs, str(base)).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out[name] = docs.toPandas()
    return out


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "pii", "packing"] and C.ORACLE_SQL is None


def test_decisions(stages):
    ids = {n: set(d.doc_id) for n, d in stages.items()}
    assert ids["input"] > ids["toxicity"] > ids["exact_dedup"] > ids["ngram_jaccard"] and ids["ngram_jaccard"] == ids["pii"] == ids["packing"]
    assert 10_005 not in ids["toxicity"] and {10_001, 10_002, 10_006, 10_007} <= ids["toxicity"]
    assert 10_003 not in ids["exact_dedup"] and 10_004 in ids["exact_dedup"] and 10_007 not in ids["exact_dedup"] and 10_008 in ids["exact_dedup"]
    assert 10_001 in ids["ngram_jaccard"] and 10_002 not in ids["ngram_jaccard"]
    assert stages["exact_dedup"].text.fillna("").is_unique
    for n in ("toxicity", "exact_dedup", "ngram_jaccard", "pii"):
        assert list(stages[n].columns) == list(stages["input"].columns)


def test_redaction(stages):
    clean = stages["pii"].set_index("doc_id")
    assert clean.text[10_006] == "write to [EMAIL] or [PHONE] today" and clean.n_chars[10_006] == len(clean.text[10_006])
    assert not any(pii.base_spans(t or "") for t in clean.text)
    before = stages["ngram_jaccard"].set_index("doc_id").text
    untouched = [i for i in clean.index if not pii.base_spans(before[i] or "")]
    assert all(clean.text[i] == before[i] for i in untouched)


def test_pieces(stages):
    p = stages["packing"]
    assert p.sequence_id.is_unique and (p.length == p.ids.map(len)).all()
    total = p.groupby("doc_id").length.sum()
    tokens = packing.WordEncoder(packing.tokenizer_path()).encode([stages["pii"].set_index("doc_id").text[10_006]])[0]
    assert total[10_006] == len(tokens) // 4 + 1 and total[10_008] == 1


def test_run(spark):
    assert C.run(spark, "/root/testdata/sf0.001").count() > 0
