"""Many needles in many texts without a nested loop: postings of tokens, then the exact test.

Texts are lowered and cut into tokens: runs of letters, digits and `_`, and any other
character on its own, so every needle of at least one character has tokens. Inside a needle
a token is whole (``exact``); its first one may end a longer token of the text
(``suffix``), its last one may begin one (``prefix``), and a needle of one token may lie
anywhere in one (``inside``). These are looked up in the vocabulary, by equality with
the ends of its tokens in the lengths that needles have. The anchor whose tokens stand in
the fewest texts is joined to the postings, and each pair found that way is verified. The
result is that of `contains(lower(text), lower(needle))` for every pair.

Edge cases: null and empty needles, and null texts, have no hits; repeated needles
and texts keep their rows; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"
WORD = r"^[\p{L}\p{N}_]"


def tokens(text) -> Column:
    """The tokens of a text, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_postings(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(token, keys): which texts have a token, each pair once. ``keys`` name a text."""
    return texts.select(*keys, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))


def anchors(needles: DataFrame, needle: str) -> DataFrame:
    """(needle, pos, mode, form) for every token of every distinct needle in lower case."""
    once = needles.where(F.length(needle) > 0).select(F.lower(needle).alias("needle")).distinct()
    cut = once.withColumn("ts", tokens(F.col("needle"))).select("needle", F.size("ts").alias("n"), F.posexplode("ts").alias("pos", "form"))
    word, first, last = F.col("form").rlike(WORD), F.col("pos") == 0, F.col("pos") == F.col("n") - 1
    mode = F.when(~word, "exact").when(first & last, "inside").when(first, "suffix").when(last, "prefix").otherwise("exact")
    return cut.select("needle", "pos", mode.alias("mode"), "form")


def _forms(vocabulary: DataFrame, lengths: dict[str, list[int]]) -> DataFrame:
    """(mode, form, token, df): what each token of the vocabulary can be matched by."""
    token, size = F.col("token"), F.length("token")

    def cuts(mode: str) -> Column:
        fitting = F.filter(F.array(*(F.lit(n) for n in lengths[mode])), lambda n: n <= size)
        if mode == "inside":
            starts = lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(token, i, n))
            return F.array_distinct(F.flatten(F.transform(fitting, starts)))
        return F.transform(fitting, lambda n: F.substring(token, F.lit(1), n) if mode == "prefix" else F.substring(token, size - n + 1, n))

    parts = [vocabulary.select(F.lit("exact").alias("mode"), token.alias("form"), "token", "df")]
    parts += [vocabulary.select(F.lit(m).alias("mode"), F.explode(cuts(m)).alias("form"), "token", "df") for m in ("suffix", "prefix", "inside") if lengths.get(m)]
    return reduce(DataFrame.unionByName, parts)


def candidates(needles: DataFrame, needle: str, postings: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (needle in lower case, keys): the texts that have the needle's rarest token."""
    wanted = anchors(needles, needle)
    found = wanted.where("mode <> 'exact'").groupBy("mode").agg(F.sort_array(F.collect_set(F.length("form"))).alias("ls")).collect()  # three rows
    vocabulary = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    matched = wanted.join(_forms(vocabulary, {r["mode"]: r["ls"] for r in found}), ["mode", "form"], "left")
    weight = matched.groupBy("needle", "pos").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("w"))
    best = weight.groupBy("needle").agg(F.min_by("pos", F.struct("w", "pos")).alias("pos"))
    rare = matched.join(best, ["needle", "pos"]).where("token is not null").select("needle", "token")
    return rare.join(postings, "token").select("needle", *keys).distinct()


def hits(needles: DataFrame, needle: str, texts: DataFrame, keys: list[str], text: str, postings: DataFrame | None = None) -> DataFrame:
    """``needles`` joined to the keys of all ``texts`` that contain them; ``postings``, if
    stored ones are given, are those of `token_postings` with the same keys."""
    spark = texts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = texts.select(*keys, text).repartition(tasks, *keys)  # by number: a small file is one split, and its pairs are many times its bytes
    own = token_postings(rows, keys, text) if postings is None else postings
    pairs = candidates(needles, needle, own, keys).withColumnRenamed("needle", "__low")
    sure = pairs.join(rows.select(*keys, F.lower(text).alias("__text")).hint("merge"), keys).where(F.contains("__text", F.col("__low"))).select("__low", *keys)
    return needles.withColumn("__low", F.lower(needle)).join(sure, "__low").drop("__low")


def first_lines(found: DataFrame, texts: DataFrame, keys: list[str], text: str, needle: str) -> DataFrame:
    """``found`` (needle, keys) with the 1-based line of the first hit in its text."""
    at = F.instr(F.lower(text), F.lower(needle))
    both = found.join(texts.select(*keys, text), keys)
    before = F.left(F.lower(F.col(text)), at - 1)
    return both.withColumn("line", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")).drop(text)


def top_per(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """At most ``k`` rows of each group, with ``n``, the group's size."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__k", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("__k") <= k).drop("__k")
