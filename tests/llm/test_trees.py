"""Undecided pairs of the near-duplicate join: chance meetings make no trees, and large groups are dealt in rounds."""

import random

import pytest

from lodestone.llm import jaccard


def stored(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def brute(texts, width=4, num=85, den=100):
    sets = [frozenset(zip(*(t.split()[k:] for k in range(width)), strict=False)) for t in texts]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) and least[i] != least[j]:
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = [new if c == old else c for c in least]
    return least


@pytest.fixture
def dealt(monkeypatch):
    """(group, rows) of each time that groups were dealt to cells."""
    seen, deal = [], jaccard._deal

    def spy(rows, group, *more):
        out = deal(rows, group, *more)
        seen.append((group, out.count()))
        return out

    monkeypatch.setattr(jaccard, "_deal", spy)
    return seen


def found(docs):
    return [r.component_id for r in sorted(jaccard.similar_groups(docs).collect(), key=lambda r: r.id)]


def test_chance_meetings_make_no_trees(spark, tmp_path, dealt):
    """Long texts, each with nearly half of the next one's words: they meet, and none is like another."""
    r = random.Random(3)
    parts = [[f"w{r.getrandbits(40)}" for _ in range(1200)] for _ in range(30)]
    texts = [" ".join(parts[i] + parts[(i + 1) % 30][:1000]) for i in range(30)]
    assert found(stored(spark, tmp_path / "d", texts)) == brute(texts) == list(range(30))
    assert sum(n for g, n in dealt if g == "sig") >= 30 and sum(n for g, n in dealt if g == "tree") == 0


def test_large_trees_in_rounds(spark, tmp_path, dealt, monkeypatch):
    """Texts below the threshold, each with a copy above it, first as they are, then all in one tree that is dealt block by block."""
    r = random.Random(5)
    base, texts = [f"w{r.getrandbits(40)}" for _ in range(600)], []
    for i in range(24):
        words = list(base)
        for k in r.sample(range(600), 9):
            words[k] = f"v{i}x{k}"
        copy = list(words)
        copy[r.randrange(600)] = f"c{i}"
        texts += [" ".join(words), " ".join(copy)]
    docs, expected = stored(spark, tmp_path / "d", texts), brute(texts)
    assert len(set(expected)) == 24 and found(docs) == expected
    dealt.clear()
    for name, value in (("FEW", 0), ("LONG", jaccard.SKETCH), ("BLOCK", 8), ("CHUNK", 16), ("BLOCK_TOKENS", 1 << 12), ("CHUNK_TOKENS", 1 << 13), ("ROUND_TOKENS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    assert found(docs) == expected
    rounds = [n for g, n in dealt if g == "tree"]
    assert len(rounds) > 2 and sum(rounds) > 3 * len(texts) and max(rounds) < sum(rounds) / 2


def test_sketches_fold():
    r = random.Random(7)
    tokens = jaccard.np.array(sorted(r.getrandbits(64) for _ in range(900)), dtype=jaccard.np.uint64)
    long = jaccard.sketch(tokens, 32)
    while len(long) > jaccard.SKETCH:
        long = long[: len(long) // 2] ^ long[len(long) // 2 :]
    assert (long == jaccard.sketch(tokens)).all()
