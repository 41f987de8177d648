"""Importance resampling towards a target: documents drawn by how much their n-grams look like it.

Documents and target texts become arrays of n-grams (A-Z lowered, words of digits, letters
and everything beyond ASCII), exploded and hashed into buckets by `crc32 % buckets`. Bucket
counts of both sides give an integer gain for each bucket; the gain table has one row a
bucket, so its broadcast is bounded by ``buckets``. A second explode joins it, and a
document's weight is the sum of its features' gains. Gumbel noise, seeded by the document's
id, turns the weights into draws without replacement: the highest scores are drawn.

Ranks need no single task: the scored rows are sorted into range partitions, each counts
its rows, and a row's rank is its place in its partition plus the rows of the ones
before it. Bucket counts and document sums combine in the map tasks, so frequent words and
long documents are no hot keys.

Edge cases: null texts have no words, weight 0; a null doc_id is drawn with the seed and an
empty id, and comes last among ties; repeated rows are each drawn or not, with ranks of
their own; an empty target or an empty table of documents has counts of 0; no documents
give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, number_rows, table
from lodestone.llm.line_dedup import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED, PERCENT, MIN_WORDS = 10000, 2024, 10, 20


def word_array(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def ngrams(words: Column, least: int, most: int) -> Column:
    """All runs of ``least`` to ``most`` words, joined by one space."""
    if least == most == 1:
        return words

    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(*(of(n) for n in range(least, most + 1)))


def features(texts: DataFrame, text_col: str, keep: list[str], least: int, most: int, buckets: int) -> DataFrame:
    """One row a feature: ``keep``, its bucket and n_words, the number of the text's words."""
    words = texts.select(*keep, word_array(F.col(text_col)).alias("__words"))
    sized = words.select(*keep, "__words", F.size("__words").cast("long").alias("n_words"))
    grams = sized.select(*keep, "n_words", F.explode(ngrams(F.col("__words"), least, most)).alias("gram"))
    return grams.select(*keep, "n_words", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def gain_table(docs: DataFrame, target: DataFrame, text_col: str, least: int, most: int, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))."""
    one = lambda df, at: features(df.select(text_col), text_col, [], least, most, buckets).select("bucket", F.lit(at).alias("source"))
    both = one(docs, 1).union(one(target, 0))
    count = lambda at: F.coalesce(F.sum((F.col("source") == at).cast("long")), F.lit(0))
    counts = both.groupBy("bucket").agg(count(1).alias("s"), count(0).alias("t"))
    all_ = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["s", "t"])
    all_ = cut(all_)
    total = all_.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()  # two numbers
    double = lambda c: c.cast("double")
    up = double(F.col("t") + 1) * double(F.lit(total["S"] + buckets))
    down = double(F.col("s") + 1) * double(F.lit(total["T"] + buckets))
    return all_.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 32 bits of sha256(`seed:doc_id`)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with a rank 1,2,3... in ``order``: range partitions and the counts of those before."""
    at = cut(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = at.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("__part", before.alias("__before"))
    return at.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__row") + 1).drop("__part", "__row", "__at", "__before")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS,
             percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_features, n_words, weight, score, rank) of each row of ``docs`` (a stored table);
    n_words is 0 for texts too short for a feature.

    Of the N documents with at least ``min_words`` words, floor(percent N / 100) are drawn."""
    gains = gain_table(docs, target, text_col, least, most, buckets)
    rows = number_rows(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__doc")
    found = features(rows, "__text", ["__doc"], least, most, buckets).join(F.broadcast(gains), "bucket")
    sums = found.groupBy("__doc").agg(F.count(F.lit(1)).alias("n_features"), F.max("n_words").alias("n_words"), F.sum("gain").alias("weight"))
    scored = rows.select("__doc", "__id").join(sums, "__doc", "left").fillna(0, ["n_features", "n_words", "weight"])
    scored = scored.select("__id", "n_features", "n_words", "weight", (F.col("weight") + noise(F.col("__id"), seed)).alias("score"))
    scored = cut(scored)
    can = ranked(scored.where(F.col("n_words") >= min_words), [F.col("score").desc(), F.col("__id").asc_nulls_last()], "rank")
    n = scored.where(F.col("n_words") >= min_words).count()
    can = can.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return can.unionByName(rest).withColumnRenamed("__id", id_col)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs.select("doc_id", "text"), target.select("text")).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM benchmark),
shift8 AS (SELECT list(c ORDER BY i) AS tab
           FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
                 FROM (SELECT unnest(range(256)) AS i))),
used AS (SELECT r, unnest(ws) AS word FROM d),
wanted AS (SELECT unnest(ws) AS word FROM q),
bytes AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT) AS bs
          FROM (SELECT word FROM used UNION SELECT word FROM wanted)),
hashed AS (SELECT word, xor(list_reduce([4294967295] || bs, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
           FROM bytes, shift8),
s AS (SELECT bucket, count(*) AS s FROM used JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM used) + {BUCKETS} AS s_all, (SELECT count(*) FROM wanted) + {BUCKETS} AS t_all),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * s_all::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * t_all::DOUBLE)))::BIGINT AS gain
         FROM s FULL JOIN t USING (bucket), total),
weight AS (SELECT r, sum(gain)::BIGINT AS weight FROM used JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                             / 4294967296::DOUBLE)))::BIGINT AS score
           FROM d LEFT JOIN weight USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
"""
