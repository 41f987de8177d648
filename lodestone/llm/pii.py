"""PII: patterns for direct identifiers, and information-theoretic sanitisation of the rest.

**Base.** E-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers are
found in every whole text, leftmost and without overlap per kind.

**Method.** Every found value is a protected entity e. From the whole corpus we count, in
documents, how often e occurs, how often a term t occurs, and how often both occur in one,
at whatever distance.
With IC(e) = log(N / n(e)) and PMI(e; t) = log(p(e|t) / p(e)), the disclosure PMI / IC is
the share of e's information that seeing t reveals, and -log p(e|t) what is still unknown
of e then. A term is revealing if the disclosure reaches ``GENERALISE`` and less than ``LEFT``
bits stay unknown; the second condition does not loosen as the corpus grows, so a word that
half of its documents use without e is left alone at every size. Every entity is judged,
however rare: for the disclosure p(e|t) is smoothed to (n(e,t) + a p(e)) / (n(t) + a), as if
t had been seen in a = ``PRIOR`` more documents at e's own rate, so few sightings weigh less
(a term seen once, beside a value seen once, reveals it from about 1,500 documents on).
Terms whose disclosure reaches ``GENERALISE`` are
generalised to ``[TERM]``, from ``REMOVE`` on they are removed, wherever they occur in any
text: with the entity or without it, by the entity that they reveal most of. Terms inside
base spans go with these.

Data flow: one pass over the texts gives each document's base spans and, where there are
any, its terms; only those narrow rows are shuffled. Pairs that the documents with
identifiers alone bring under the limit go at once, as more documents of the term only
lower its disclosure. Values (and terms) that stand in the same documents are one class, so
a document's values are not paired with each of its words. A second pass counts the documents of the others over the whole
corpus, and a third finds all places of the revealing terms; bitmaps of a fixed size keep
other words out of the shuffle. Counts combine in the map tasks, so a value that a third
of all rows contain is no hot key.

Edge cases: a null or empty text has no spans; overlapping spans of different kinds are
all reported, and redacted as one stretch; repeated rows each count as a document; null
ids are kept; an empty table gives an empty result; other columns are kept by `sanitise`.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, not_null_text, number_rows, scratch, steps, stored, table

#: Fixed values of the contract: kinds in their order, and their patterns.
KINDS = ["email", "ip", "card", "phone", "term"]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a run of digits is entered at its start only
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

PRIOR = 2.0  # documents of no evidence added to each term's own
GENERALISE, REMOVE = 0.85, 0.98  # share of an entity's information
LEFT = 1.0  # a revealing term leaves less of an entity's information unknown, in bits
TERM = re.compile(r"[^\W\d_]{4,}")
_MASK = (1 << 24) - 1
_NON_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """What EMAIL.finditer gives, from the @ signs on: time is linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = _local_start(text, done, at)
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(done, at + 1))


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _local_start(text: str, low: int, at: int) -> int:
    while at > low and text[at - 1] in _LOCAL_CHARS:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds, in order."""
    out = [(m.start(), 0, m.end()) for m in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NON_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def entity(kind: int, value: str) -> int:
    """The number of a protected value, written in one way."""
    return _hash(f"{kind}:{value.lower() if kind == 0 else value if kind == 1 else _NON_DIGIT.sub('', value)}")


def document_terms(text: str) -> set[str]:
    return {t.lower() for t in set(TERM.findall(text))}


def terms_outside(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The terms of a text that stand outside the spans at least once."""
    out, reach, i = set(), 0, 0
    for m in TERM.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            reach, i = max(reach, spans[i][2]), i + 1
        if m.start() >= reach:
            out.add(m[0].lower())
    return sorted(out)


_SPAN = "struct<s:int,k:int,x:int>"


def detect(docs: DataFrame) -> DataFrame:
    """docs (row, id, text) -> row, id, spans, entities, terms (none where there is no entity)."""
    schema = f"row long, id {docs.schema['id'].dataType.simpleString()}, spans array<{_SPAN}>, entities array<bigint>, terms array<string>"
    span_type = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("x", pa.int32())]))

    def run(batches):
        for batch, texts, _ in steps(batches):
            spans, entities, terms = [], [], []
            for text in texts.to_pylist():
                found = base_spans(text)
                spans.append([{"s": s, "k": k, "x": x} for s, k, x in found])
                entities.append(sorted({entity(k, text[s:x]) for s, k, x in found}))
                terms.append(terms_outside(text, found) if found else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, span_type), pa.array(entities, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.string()))],
                                             ["row", "id", "spans", "entities", "terms"])

    return docs.select("row", "id", "text").mapInArrow(run, schema)


def _sent_mask(candidates: DataFrame):
    """A broadcast bitmap in which the places of all candidate terms are set."""
    at = F.crc32(F.encode("t", "UTF-8")).bitwiseAND(F.lit(_MASK))
    bits = candidates.select("t").distinct().select(at.alias("at")).groupBy((F.col("at") / 32768).cast("int").alias("b")).agg(
        F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    mask = np.zeros((_MASK + 1) // 8, dtype=np.uint8)
    for r in bits.collect():  # at most 512 rows of 4 KiB
        mask[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return candidates.sparkSession.sparkContext.broadcast(mask.tobytes())


def _in_mask(flags: bytes, term: str) -> int:
    h = zlib.crc32(term.encode("utf-8", "replace")) & _MASK
    return flags[h >> 3] >> (h & 7) & 1


def _term_counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(t, nt): in how many documents each candidate term occurs, over all documents."""
    sent = _sent_mask(candidates)

    def run(batches):
        flags, count = sent.value, Counter()
        for _, texts, _ in steps(batches):
            for text in texts.to_pylist():
                for t in document_terms(text):
                    if _in_mask(flags, t):
                        count[t] += 1
            if len(count) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], ["t", "n"])
                count = Counter()
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], ["t", "n"])

    return docs.select("text").mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n").alias("nt"))


def _places(docs: DataFrame, revealing: DataFrame) -> DataFrame:
    """(row, t, s, x): all places of the revealing terms (and of few others) in all documents."""
    sent = _sent_mask(revealing)
    schema = pa.schema([("row", pa.int64()), ("t", pa.string()), ("s", pa.int32()), ("x", pa.int32())])

    def run(batches):
        flags = sent.value
        for batch, texts, _ in steps(batches):
            out = []
            for row, text in zip(batch.column(0).to_pylist(), texts.to_pylist()):
                if here := {t for t in document_terms(text) if _in_mask(flags, t)}:
                    out += [(row, t, m.start(), m.end()) for m in TERM.finditer(text) if (t := m[0].lower()) in here]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)

    return docs.select("row", "text").mapInArrow(run, "row long, t string, s int, x int")


def _disclosure(net, nt, ne, total: int, prior: float):
    """PMI / IC; 0 where LEFT bits or more stay unknown. Falls as nt grows."""
    rate, both = ne / F.lit(float(total)), F.least(net, nt, ne)
    seen = (both + prior * rate) / (nt + prior)
    ic = -F.log(rate)
    return F.when((ic > 0) & (-F.log2(both / nt) < LEFT), F.log(seen / rate) / ic).otherwise(0.0)


def _classes(rows: DataFrame, item: str, n: str, cls: str) -> DataFrame:
    """(item, n, cls) of (row, item): items that stand in the same documents have one class, a 128-bit digest of the set."""
    digest = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"))
    return rows.groupBy(item).agg(digest.alias(cls)).select(item, F.col(f"{cls}.n").alias(n), cls)


def disclosures(docs: DataFrame, found: DataFrame, prior: float = PRIOR, least: float = GENERALISE) -> DataFrame:
    """(t, disclosure) of all terms that reveal a protected entity at least that much: the most that they reveal of any.

    Counts depend only on the documents in which a value and a term stand, so pairs are made of
    classes with equal documents: a document with thousands of values and words that stand
    nowhere else gives one pair. A term that stands in twice as many documents as any value, or
    more, leaves at least ``LEFT`` bits unknown and is not paired."""
    total = found.count()
    entities = found.select("row", F.explode("entities").alias("e"))
    by_entity = _classes(entities, "e", "ne", "ce").select("e", "ce")
    most = by_entity.agg(F.max("ce.n").alias("n")).first()["n"]  # one number
    empty = docs.sparkSession.createDataFrame([], "t string, disclosure double")
    if most is None:
        return empty
    terms = found.where(F.size("entities") > 0).select("row", F.explode("terms").alias("t"))
    by_term = cut(_classes(terms, "t", "nd", "ct").where(F.col("nd") < 2**LEFT * most).select("t", "ct"))
    # dealt out by row once: distinct rows and the join then need no shuffle of their own
    own = entities.join(by_entity, "e").select("row", "ce").repartition("row").distinct()
    near = terms.join(by_term, "t").select("row", "ct").repartition("row").distinct()
    both = own.join(near, "row").where(F.col("ct.n") < 2**LEFT * F.col("ce.n")).groupBy("ce", "ct").agg(F.count(F.lit(1)).alias("net"))
    score = lambda nt: _disclosure(F.col("net"), nt, F.col("ne"), total, prior)
    pairs = both.select("ct", "net", F.col("ce.n").alias("ne")).where(score(F.col("ct.n")) >= least).distinct()
    pairs = cut(pairs.join(by_term, "ct").select("t", "net", "ne").distinct())
    if pairs.isEmpty():
        return empty
    scored = pairs.join(_term_counts(docs, pairs), "t").withColumn("disclosure", score(F.col("nt"))).where(F.col("disclosure") >= least)
    return scored.groupBy("t").agg(F.max("disclosure").alias("disclosure"))


def find(docs: DataFrame, work: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id and spans (s, k, x, d) of each document: base spans and revealing terms (k = 4, d its disclosure)."""
    rows = number_rows(docs.select(docs[id_col].alias("id"), not_null_text(text_col).alias("text")), "row")
    found = stored(detect(rows), work)
    revealing = cut(disclosures(rows, found).withColumnRenamed("disclosure", "d"))
    more = _places(rows, revealing).join(revealing, "t").groupBy("row").agg(F.collect_list(F.struct("s", F.lit(4).alias("k"), "x", "d")).alias("more"))
    base = F.transform("spans", lambda p: F.struct(p["s"].alias("s"), p["k"].alias("k"), p["x"].alias("x"), F.lit(None).cast("double").alias("d")))
    outside = F.filter("more", lambda m: ~F.exists("spans", lambda p: (p["s"] < m["x"]) & (m["s"] < p["x"])))
    return found.select("row", "id", "spans").join(more, "row", "left").select(
        "row", "id", F.array_sort(F.concat(base, F.coalesce(outside, F.expr("cast(array() as array<struct<s:int,k:int,x:int,d:double>>)")))).alias("spans"))


def _joined(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.get(names, p["k"]), p["s"].cast("string"), p["x"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with identifiers replaced by their kind and revealing terms generalised or removed."""
    with scratch(docs.sparkSession) as work:
        spans = cut(find(docs, work, id_col, text_col).where(F.size("spans") > 0).select(F.col("row").alias("__row"), F.col("spans").alias("__spans")))
    rows = number_rows(docs, "__row").join(spans, "__row", "left")

    def redact(text, spans):
        if text is None or spans is None:
            return text
        out, at = [], 0
        for p in spans:
            if p["s"] >= at:
                out += [text[at : p["s"]], f"[{KINDS[p['k']].upper()}]" if p["d"] is None or p["d"] < REMOVE else ""]
            at = max(at, p["x"])
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            i, j = batch.schema.get_field_index(text_col), batch.schema.get_field_index("__spans")
            texts = pa.array(map(redact, batch.column(i).to_pylist(), batch.column(j).to_pylist()), batch.column(i).type)
            yield pa.RecordBatch.from_arrays([texts if n == text_col else batch.column(k) for k, n in enumerate(batch.schema.names) if k != j],
                                             [n for n in batch.schema.names if n != "__spans"])

    return rows.drop("__row").mapInArrow(run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as work:
        found = find(table(spark, sf_dir, "documents"), work)
        base = F.filter("spans", lambda p: p["k"] < 4)
        count = lambda k: F.size(F.filter("spans", lambda p: p["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
        return cut(found.select(F.col("id").alias("doc_id"), *map(count, range(4)), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")))
