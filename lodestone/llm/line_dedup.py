"""Line dedup: lines that many documents share go from all of them.

Lines are exploded and normalised (white space stripped at both ends, A-Z lowered), and
hashed to 128 bits. A document counts once per key (its keys are made distinct before
the explode), so one count with map-side combining gives the number of documents per
key, however common a line is. In a second pass a bitmap of the keys over the threshold
(of a fixed size, so its broadcast is bounded) lets the other lines go; what is left
joins those keys exactly (a skewed join that adaptive execution splits: one side has one
row a key). A document then gets its dropped positions and is put together by position.

Edge cases: null and empty texts are one empty line, which has no code points and stays;
a text that loses all lines becomes empty; repeated rows each count as a document; an
empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, cut, maybe_in, not_null_text, number_rows, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """The key of a line: stripped of `[\\x20\\x09-\\x0D]`, A-Z in lower case.

    For lines of ASCII only, that is the (much faster) general lower case."""
    bare = F.trim(line, F.lit(SPACES))
    return F.when(F.octet_length(line) == F.length(line), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` (a stored table) with three more columns: n_lines, n_dropped (long) and kept_text."""
    rows = number_rows(docs, "__row")
    parts = F.split(not_null_text(text_col), "\n")
    hashes = lambda key: (F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2"))
    once = rows.select(F.explode(F.array_distinct(F.transform(parts, line_key))).alias("key")).where(F.length("key") >= min_chars)
    common = cut(once.select(*hashes("key")).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs).select("k1", "k2"))
    lines = rows.select("__row", F.posexplode(F.transform(parts, line_key)).alias("pos", "key"))  # a key is made once
    keyed = lines.where(F.length("key") >= min_chars).select("__row", "pos", *hashes("key"))
    hits = maybe_in(keyed, "k1", common.select("k1")).join(common, ["k1", "k2"])
    dropped = cut(hits.groupBy("__row").agg(F.collect_list("pos").alias("__drop")))
    out = rows.join(dropped, "__row", "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drop"))
    kept = F.when(F.col("__drop").isNull(), not_null_text(text_col)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    return out.select(*docs.columns, F.size(parts).cast("long").alias("n_lines"),
                      F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, row_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t FROM documents)),
keyed AS (
  SELECT doc_id, row_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.key IS NULL THEN k.line END, chr(10) ORDER BY k.pos), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY k.row_id, k.doc_id
"""
