"""Scopes pinned by fingerprints: prefixes of fingerprints resolved to bases by equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_pins(pins: DataFrame, bases: DataFrame) -> DataFrame:
    """``pins`` (pin, prefix) with n_bases, base and state.

    ``bases`` has alias and fingerprint. A fingerprint is looked up by its beginnings, in the
    lengths that prefixes have, so the range of fingerprints behind a prefix is one key. The
    state is resolved (one base), ambiguous (several; base is null), missing (none) or empty (no
    prefix). Case does not count. A null fingerprint is behind no prefix; repeated pins each
    get their row."""
    p = pins.withColumn("__key", F.lower("prefix"))
    keys = p.where("length(__key) > 0").select("__key").distinct()
    most = bases.agg(F.max(F.length("fingerprint")).alias("n")).first()["n"] or 0
    lengths = [r["n"] for r in keys.select(F.length("__key").alias("n")).where(F.col("n") <= most).distinct().collect()]  # at most a fingerprint's length
    f = F.lower("fingerprint")
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length(f))
    begin = bases.where("fingerprint is not null").select("alias", F.explode(F.transform(fitting, lambda n: F.substring(f, F.lit(1), n))).alias("__key"))
    ends = begin.groupBy("__key").agg(F.count(F.lit(1)).alias("n_bases"), F.min("alias").alias("__one"))
    found = ends.join(keys.hint("merge"), "__key")  # as many keys as pins: none are gathered on the driver
    n = F.coalesce("n_bases", F.lit(0))
    state = F.when(F.coalesce(F.length("__key"), F.lit(0)) == 0, "empty").when(n == 0, "missing").when(n == 1, "resolved").otherwise("ambiguous")
    out = p.join(found.hint("merge"), "__key", "left")
    return out.select(*pins.columns, n.alias("n_bases"), F.when(n == 1, F.col("__one")).alias("base"), state.alias("state"))


def states(wanted: DataFrame, bases: DataFrame) -> DataFrame:
    """``wanted`` (alias, asked, inside, expected) with fingerprint, state and reason."""
    both = wanted.join(bases, "alias", "left")
    pinned = F.col("expected").isNotNull()
    reason = (F.when(~pinned, F.lit(None)).when(F.col("fingerprint").isNull(), "no fingerprint is stored, so the snapshot cannot be confirmed")
        .when(~F.col("fingerprint").startswith(F.lower("expected")), F.concat(F.lit("expected "), "expected", F.lit(", the base has "), "fingerprint")))
    state = F.when(F.col("asked"), "asked").when(~F.col("inside"), "outside").when(F.col("reason").isNotNull(), "rejected").otherwise("in_scope")
    return both.withColumn("reason", reason).withColumn("state", state)


def by_scope(hits: DataFrame, keys: list[str], bases: DataFrame) -> DataFrame:
    """For each key what its ``hits`` (keys, base, detail) mean: keys, where, base and detail.

    ``where`` is here (in the asked base), other (in one base of the scope), ambiguous (in
    several) or outside (in bases beyond the scope only); ``bases`` has alias and state."""
    both = hits.join(bases.select(F.col("alias").alias("base"), "state"), "base").where("state <> 'rejected'")
    of = lambda state: F.col("state") == state
    n = lambda state: F.count_distinct(F.when(of(state), F.col("base")))
    first = lambda state: F.min(F.when(of(state), F.struct("base", "detail")))
    one = both.groupBy(*keys).agg(n("asked").alias("n_asked"), n("in_scope").alias("n_in"), first("asked").alias("a"), first("in_scope").alias("i"), first("outside").alias("o"),
                                  F.sort_array(F.collect_set(F.when(of("in_scope"), F.col("base")))).alias("bases"))
    where = F.when(F.col("n_asked") > 0, "here").when(F.col("n_in") > 1, "ambiguous").when(F.col("n_in") == 1, "other").otherwise("outside")
    best = F.when(F.col("n_asked") > 0, F.col("a")).when(F.col("n_in") == 1, F.col("i")).when(F.col("n_in") == 0, F.col("o"))
    return one.select(*keys, where.alias("where"), F.when(F.col("n_in") > 1, F.array_join("bases", ", ")).otherwise(best["base"]).alias("base"), best["detail"].alias("detail"))
