"""Repetition coverage: which share of a text's characters repeats inside the text.

Word n-grams of several lengths get rolling 64-bit hashes in numpy, for all texts of an
Arrow batch at once: the hash of length n is the hash of length n-1 plus the next word's
term. A sort finds the n-grams that occurred before in the same text; the characters of
all words inside such repeats, divided by the characters of all words, are the coverage.
Lines are compared as they are.

The limits are the published ones for repetition removal: lines 0.30 of the lines and 0.20
of the characters, 5- to 10-grams 0.15 down to 0.10 of the characters. In a short text one
line said twice reaches such a share, so the limits count from ``MIN_DUP_LINES`` repeated
lines and ``MIN_REPEATED`` words inside repeated n-grams on, at every length.

Map-only and one pass: no shuffle, memory bounded by ``STEP_BYTES`` of text or one text.

Edge cases: a null or empty text has no words and fails the base rule; a text with fewer
than n words has no n-grams; repeated rows are judged alike; an empty table gives an
empty result; other columns are kept as they are by `with_quality`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import SPACES, mix, steps, table, utf8, words

#: Largest share of characters inside repeated n-grams, by n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20
MIN_DUP_LINES, MIN_REPEATED = 3, 25  # fewer repeats are no evidence, whatever their share
MIN_WORDS = 50
#: Fixed values of the contract.
SYMBOLS, REPEAT_WINDOW = "#*$%&|<>", 3

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
_HEAD = np.ones(256, dtype=np.int64)  # bytes that begin a code point
_HEAD[0x80:0xC0] = 0
_STEP = 0xD6E8FEB86659FD93

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
          ("dup_line_share", "double"), ("dup_line_char_share", "double"), *((f"dup_{n}gram_share", "double") for n in NGRAM_LIMITS),
          *((f"dup_{n}gram_words", "long") for n in NGRAM_LIMITS)]


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of n that begins at one of ``starts``."""
    edge = np.zeros(total + 1, dtype=np.int32)
    edge[starts] += 1
    edge[starts + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def _repeats(keys: np.ndarray, first_too: bool) -> np.ndarray:
    """Indices of the keys that occurred before (or, with ``first_too``, that occur twice)."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later = np.append(False, same)
    if first_too:
        later |= np.append(same, False)
    return order[later]


def measure(texts: pa.Array, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts and shares of FIELDS for each text."""
    data, n_docs = utf8(texts), len(texts)
    start, end, doc, hashes = words(data, offs)
    heads = np.append(0, np.cumsum(_HEAD[data]))
    symbols = np.append(0, np.cumsum(_SYMBOL[data]))
    chars = heads[end] - heads[start]
    per_doc = lambda at, weights=None: np.bincount(doc[at], None if weights is None else weights[at], n_docs)
    everything = slice(None)
    out = {"n_words": per_doc(everything).astype(np.int64), "word_chars": per_doc(everything, chars).astype(np.int64), "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]]}
    base = np.maximum(out["word_chars"], 1)
    salt = mix(doc.astype(np.uint64) + np.uint64(1))
    rolled, power = np.zeros(len(doc), dtype=np.uint64), 1
    for n in range(1, max(NGRAM_LIMITS) + 1):
        size = max(len(doc) - n + 1, 0)
        rolled = rolled[:size] + hashes[n - 1 :] * np.uint64(power) if size else rolled[:0]
        power = power * _STEP % (1 << 64)
        if n != REPEAT_WINDOW and n not in NGRAM_LIMITS:
            continue
        inside = np.flatnonzero(doc[:size] == doc[n - 1 :]) if size else np.zeros(0, dtype=np.int64)
        keys = mix(rolled[inside] ^ salt[inside])
        if n == REPEAT_WINDOW:
            out["n_repeat_words"] = per_doc(_covered(inside[_repeats(keys, True)], n, len(doc))).astype(np.int64)
        else:
            covered = _covered(inside[_repeats(keys, False)], n, len(doc))
            out[f"dup_{n}gram_share"] = per_doc(covered, chars) / base
            out[f"dup_{n}gram_words"] = per_doc(covered).astype(np.int64)
    out |= _lines(texts)
    return out


def _lines(texts: pa.Array) -> dict[str, np.ndarray]:
    dup, share, char_share = [], [], []
    for text in texts.to_pylist():
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        distinct = set(lines)
        dup.append(n := len(lines) - len(distinct))
        share.append(n / max(len(lines), 1))
        total = sum(map(len, lines))
        char_share.append((total - sum(map(len, distinct))) / max(total, 1) if n else 0.0)
    return {"n_dup_lines": np.array(dup, dtype=np.int64), "dup_line_share": np.array(share), "dup_line_char_share": np.array(char_share)}


def with_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with FIELDS, base_failed and kept (prefix ``q_``where a name is taken)."""
    names = {name: name if name not in docs.columns else f"q_{name}" for name, _ in FIELDS}
    schema = T.StructType(docs.schema.fields + [T.StructField(names[n], T._parse_datatype_string(t)) for n, t in FIELDS])

    def run(batches):
        for batch, texts, offs in steps(batches, text_col):
            found = measure(texts, offs)
            extra = [pa.array(found[n], pa.int64() if t == "long" else pa.float64()) for n, t in FIELDS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names.values()])

    out = docs.mapInArrow(run, schema)
    c = lambda n: F.col(names[n])
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    bad = (c("n_dup_lines") >= MIN_DUP_LINES) & ((c("dup_line_share") > LINE_LIMIT) | (c("dup_line_char_share") > LINE_CHARS_LIMIT))
    for n, limit in NGRAM_LIMITS.items():
        bad = bad | ((c(f"dup_{n}gram_words") >= MIN_REPEATED) & (c(f"dup_{n}gram_share") > limit))
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~bad})


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                     F.col("dup_5gram_words").alias("n_dup_5gram_words"), F.col("dup_10gram_words").alias("n_dup_10gram_words"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
c AS (SELECT r, sum(length(word)) AS chars FROM p GROUP BY r),
g AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM w, (SELECT unnest([3, 5, 6, 7, 8, 9, 10]) AS n), unnest(range(1, len(ws) - n + 2)) AS u(i) WHERE len(ws) >= n),
s AS (SELECT r, n, i FROM (SELECT r, n, i, row_number() OVER (PARTITION BY r, n, gram ORDER BY i) AS k, count(*) OVER (PARTITION BY r, n, gram) AS m FROM g) WHERE k > 1 OR (n = 3 AND m > 1)),
v AS (SELECT DISTINCT r, n, i + o AS i FROM s, unnest(range(0, n)) AS u(o)),
h AS (SELECT v.r, n, count(*) AS words, sum(length(word)) AS chars FROM v JOIN p ON p.r = v.r AND p.i = v.i GROUP BY v.r, n),
f AS (SELECT h.r, max(CASE WHEN n = 3 THEN words END) AS again,
             coalesce(max(CASE WHEN n = 5 THEN h.words END), 0) AS n_dup_5gram_words, coalesce(max(CASE WHEN n = 10 THEN h.words END), 0) AS n_dup_10gram_words,
             bool_or(n > 3 AND h.words >= 25 AND h.chars / c.chars > CASE n WHEN 5 THEN 0.15 WHEN 6 THEN 0.14 WHEN 7 THEN 0.13 WHEN 8 THEN 0.12 WHEN 9 THEN 0.11 ELSE 0.10 END) AS bad FROM h JOIN c ON c.r = h.r GROUP BY h.r),
x AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
y AS (SELECT r, count(*) AS lines, count(DISTINCT line) AS kinds, sum(length(line)) AS chars FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
z AS (SELECT r, sum(length(line)) AS chars FROM (SELECT DISTINCT r, line FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) GROUP BY r),
b AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(c.chars, 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(lines - kinds, 0) AS n_dup_lines, coalesce(again, 0) AS n_repeat_words, coalesce(bad, false) AS bad,
             coalesce(n_dup_5gram_words, 0) AS n_dup_5gram_words, coalesce(n_dup_10gram_words, 0) AS n_dup_10gram_words,
             coalesce(lines - kinds >= 3 AND ((lines - kinds) / lines > 0.30 OR (y.chars - z.chars) / y.chars > 0.20), false) AS bad_lines
      FROM w LEFT JOIN c ON c.r = w.r LEFT JOIN f ON f.r = w.r LEFT JOIN y ON y.r = w.r LEFT JOIN z ON z.r = w.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT bad AND NOT bad_lines AS kept, n_dup_5gram_words, n_dup_10gram_words
FROM b
"""
