"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a given and of a learned lexicon (words, and stems of
4 to 6 letters, that separate the training labels), how near such words stand to a
second-person pronoun, shares of capitals, exclamation and question marks, other marks,
digits inside words and repeated letters (obfuscation), and lexicon hits that only show
after undoing common letter substitutions.

The model is trained here, on at most ``max_rows`` labelled rows (a documented bound; the
rows with the smallest hash of doc_id, so any order of the input gives the same sample).
The sample's texts become features and stem counts on the executors; the driver gets a
bounded number of numbers, fits histogram trees in numpy and sends the model (some tens
of KB) with the scoring tasks. Scoring is map-only.

Edge cases: null and empty texts have all-zero features and get the score of such texts;
null labels and null ids are not trained on; without any training row, or with one class
only, the share of positives (0 without rows) is every text's score; repeated rows are
scored alike; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import WORKER_CACHES, steps, table

#: Insults in four languages, and second-person words.
LEXICON = frozenset("""
idiot idiots moron morons stupid dumb scum trash loser losers clown pathetic worthless disgusting garbage vermin
crétin débile connard abruti ordure minable nul pauvre-type imbécile
dummkopf abschaum versager widerlich erbärmlich trottel vollidiot
estúpido basura escoria inútil patético asqueroso imbécil payaso
""".split())
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted tú ti tus vos ustedes".split())
#: Letters that digits and marks stand for.
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

WORD = re.compile(r"[^\W_]+(?:[*@$!'-][^\W_]+)*")
STEMS = (4, 5, 6)

#: Bounds of training: labelled rows, rows used for choosing stems, learned stems.
MAX_ROWS, STEM_ROWS, MAX_STEMS = 12_000, 12_000, 400

FEATURES = ["given_density", "learned_density", "learned_any", "learned_max", "undone_density", "second_density", "near_second",
            "caps_words", "caps_chars", "exclaims", "questions", "marks", "digits_inside", "stretched", "log_words", "mean_word"]


def tokens(text: str) -> list[str]:
    return WORD.findall(text)


def stem_set(text: str) -> set[str]:
    """What of a text can enter the learned lexicon: its words and their beginnings."""
    out = set()
    for w in set(text.lower().split()):
        w = w.strip(".,;:!?\"'()[]{}|#*$%&<>")
        if 3 <= len(w) <= 24 and w.isalpha():
            out.add("=" + w)
            out.update(w[:n] for n in STEMS if len(w) >= n)
    return out


class Words(dict):
    """word -> row of ``traits``; row 0 is for words without any trait. Learns on lookup.

    Bounded: beyond ``most`` words it starts anew."""

    most = 300_000

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned, self.traits = learned, [(0.0,) * 6]

    def restart_if_full(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.traits = self.traits[:1]

    def __missing__(self, w: str) -> int:
        low = w.lower()
        weight = self.learned.get("=" + low, 0.0)
        for k in STEMS:
            if len(low) >= k:
                weight = max(weight, self.learned.get(low[:k], 0.0))
        undone = inside = 0.0
        if not low.isalpha():
            plain = low.translate(SUBSTITUTES).replace("*", "").replace("-", "")
            inside = float(not low.isdigit() and any(c.isdigit() for c in low))
            undone = float(plain != low and (plain in LEXICON or "=" + plain in self.learned))
        row = (float(low in LEXICON), weight, undone, float(low in SECOND), float(len(w) > 2 and w.isupper()), inside)
        self[w] = at = len(self.traits) if any(row) else 0
        if at:
            self.traits.append(row)
        return at


def _near(a: np.ndarray, b: np.ndarray, reach: int = 5) -> int:
    """How many of the positions ``a`` have one of ``b`` at most ``reach`` words away."""
    if not len(a) or not len(b):
        return 0
    return int((np.searchsorted(b, a + reach, side="right") > np.searchsorted(b, a - reach, side="left")).sum())


def features(text: str, known: Words) -> list[float]:
    raw = tokens(text)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    known.restart_if_full()
    code = np.fromiter(map(known.__getitem__, raw), dtype=np.int64, count=n)
    at = np.flatnonzero(code)
    trait = np.array([known.traits[c] for c in code[at]]).reshape(len(at), 6)
    given, weight, undone, second, caps, inside = trait.T
    hits = at[(given > 0) | (weight > 0) | (undone > 0)]
    near = _near(hits, at[second > 0])
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    upper = int(np.count_nonzero((data >= 65) & (data <= 90)))
    stretched = int(np.count_nonzero((data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])))
    chars, letters = max(len(text), 1), sum(map(len, raw))
    return [given.sum() / n, weight.sum() / n, float(min((weight > 0).sum(), 50)), float(weight.max(initial=0.0)), undone.sum() / n,
            second.sum() / n, near / n, caps.sum() / n, upper / max(letters, 1), text.count("!") / chars, text.count("?") / chars,
            (chars - letters - text.count(" ")) / chars, inside.sum() / n, stretched / n, float(np.log1p(n)), letters / n]


@dataclass
class Trees:
    """Histogram gradient boosting for a 0/1 label, in numpy."""

    bins: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    start: float = 0.0
    rate: float = 0.15

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, n_bins: int = 32, least: int = 8) -> "Trees":
        self.bins = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, n_bins))) for c in x.T]
        coded = self._code(x)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.start)
        width = max(len(b) for b in self.bins) + 1
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node, tree = np.zeros(len(y), dtype=np.int64), []
            for level in range(depth):
                k = 1 << level
                best = [(0.0, 0, width) for _ in range(k)]  # (gain, feature, cut): without gain all go left
                for f in range(x.shape[1]):
                    key = node * width + coded[:, f]
                    sg, sh, sn = (np.bincount(key, w, k * width).reshape(k, width).cumsum(1) for w in (g, h, np.ones(len(y))))
                    tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[(sn < least) | (tn - sn < least)] = 0
                    at = gain.argmax(1)
                    for j in range(k):
                        if gain[j, at[j]] > best[j][0] + 1e-9:
                            best[j] = (float(gain[j, at[j]]), f, int(at[j]))
                tree.append([(f, c) for _, f, c in best])
                fs, cs = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                node = node * 2 + (coded[np.arange(len(y)), fs[node]] > cs[node])
            leaves = np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + 1)
            self.trees.append((tree, self.rate * leaves))
            raw += self.rate * leaves[node]
        return self

    def _code(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, c, side="right") for b, c in zip(self.bins, x.T, strict=True)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        coded, out = self._code(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for tree, leaves in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in tree:
                fs, cs = np.array([f for f, _ in level]), np.array([c for _, c in level])
                node = node * 2 + (coded[rows, fs[node]] > cs[node])
            out += leaves[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: steps (raw score, calibrated share), both ascending."""
    order = np.argsort(raw, kind="stable")
    values, at = np.unique(raw[order], return_inverse=True)
    blocks: list[list[float]] = []
    for v, s, n in zip(values, np.bincount(at, y[order]), np.bincount(at), strict=True):
        blocks.append([float(s), float(n), float(v)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, v2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, v2]
    ends = np.array([b[2] for b in blocks])
    # half a positive and half a negative of doubt keep small blocks off 0 and 1
    shares = np.array([(b[0] + 0.25) / (b[1] + 0.5) for b in blocks])
    return ends, np.maximum.accumulate(shares)


@dataclass
class Model:
    learned: dict
    trees: Trees | None
    ends: np.ndarray
    shares: np.ndarray
    constant: float = 0.0

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        known = words_of(self)
        x = np.array([features(t, known) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
        raw = self.trees.raw(x)
        return self.shares[np.minimum(np.searchsorted(self.ends, raw, side="left"), len(self.shares) - 1)]


def words_of(model: Model) -> Words:
    """The worker's words for ``model``. They are no part of the model, whose broadcast a worker
    keeps to its end: other operators' steps drop them."""
    kept = WORKER_CACHES.get("toxicity")
    if kept is None or kept[0] is not model:
        kept = WORKER_CACHES["toxicity"] = (model, Words(model.learned))
    return kept[1]


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled texts (text, y, fold): those with the smallest hash.

    The sample of labels is chosen first, on the narrow table. An id with several labels is toxic
    if one says so; of an id with several texts, the least text is taken."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    some = known.withColumn("rank", F.xxhash64("doc_id", F.lit(7))).orderBy("rank", "doc_id").limit(max_rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "y", "rank").agg(
        F.min("text").alias("text")).select("text", "y", (F.pmod("rank", F.lit(5))).cast("int").alias("fold"))


def learn_lexicon(rows: DataFrame, max_stems: int = MAX_STEMS, support: int = 4) -> dict[str, float]:
    """Stems that toxic texts have and clean ones hardly do, with their log-odds (bounded)."""
    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s in stem_set(text):
                    count[s, y] += 1
        if count:
            yield pa.RecordBatch.from_pydict({"stem": [k[0] for k in count], "y": pa.array([k[1] for k in count], pa.int32()), "n": list(count.values())})

    sums = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sums.get(1, 0), sums.get(0, 0)
    if not bad or not good:
        return {}
    n = rows.select("text", "y").mapInArrow(run, "stem string, y int, n long").groupBy("stem").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("g"))
    odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("g") + 0.5) / (good + 1))
    best = n.where(F.col("b") >= support).withColumn("odds", odds).where("odds > 2.5").orderBy(
        (F.col("odds") * F.sqrt("b")).desc(), "stem").limit(max_stems)
    return {r["stem"]: float(r["odds"]) for r in best.select("stem", "odds").collect()}


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits lexicon, trees and calibration. Fold 0 calibrates and has no part in the rest."""
    rows = training_rows(docs, labels, max_rows).persist()
    try:
        learned = learn_lexicon(rows.where("fold != 0"))

        def run(batches):
            known = Words(learned)
            for batch in batches:
                x = np.array([features(t, known) for t in batch.column(0).to_pylist()], dtype=float).reshape(batch.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "fold"])

        found = rows.select("text", "y", "fold").mapInArrow(run, "x array<double>, y int, fold int").toPandas()
    finally:
        rows.unpersist()
    if not len(found) or found["y"].nunique() < 2:
        return Model({}, None, np.zeros(0), np.zeros(0), float(found["y"].mean()) if len(found) else 0.0)
    found = found.assign(k=found["x"].map(tuple)).sort_values(["fold", "y", "k"])
    x, y, fold = np.array(found["x"].tolist()), found["y"].to_numpy(float), found["fold"].to_numpy()
    own, rest = fold != 0, fold == 0
    if len(np.unique(y[own])) < 2 or len(np.unique(y[rest])) < 2:
        own = rest = np.ones(len(y), dtype=bool)
    trees = Trees().fit(x[own], y[own])
    return Model(learned, trees, *isotonic(trees.raw(x[rest]), y[rest]))


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the calibrated score of each whole text."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts, _ in steps(batches, text_col, cache="toxicity"):
            values = pa.array(sent.value.score(texts.to_pylist()), pa.float64())
            left = [n for n in batch.schema.names if n != name]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in left), values], [*left, name])

    return docs.mapInArrow(run, schema)


THRESHOLD = 0.7


def remainder(column="doc_id"):
    """crc32 of the id as text, modulo 3: rows with 1 are held out of training."""
    return (F.crc32(F.col(column).cast("string")) % 3).cast("int")


def fit_on_tables(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Model:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder() != 1)
    return train(docs, labels)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, fit_on_tables(spark, sf_dir)).drop("text")
    return scored.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
