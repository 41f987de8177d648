"""Code operators on DataFrames: Arrow batches through the pure functions of `functions.code`."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import code as C
from lodestone.ql.checker import Context, check


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to many tasks: small files, whose splits are few, can hold texts that take long to parse."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *rows.columns)  # by number: tasks are not to be coalesced by their bytes


def expand(df: DataFrame, keys: list[str], text: str, schema: str, rows_of: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """One output row per tuple that ``rows_of`` gives for a row's text, with the row's keys."""
    extra = T._parse_datatype_string(schema)
    full = T.StructType([df.schema[k] for k in keys] + extra.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in extra.fields]
        for batch in batches:
            source, rows = [], []
            for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                for r in rows_of(t or ""):
                    source.append(i)
                    rows.append(r)
            take = pa.array(source, pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(keys))), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], full.names)

    return spread(df.select(*keys, text)).mapInArrow(run, full)


def methods(modules: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The methods of each module text."""
    return expand(modules, keys, text, "ord int, kind string, name string, signature string, is_export boolean, directives string, description string, line_start int, line_end int, body string",
                  lambda t: ((m.ord, m.kind, m.name, m.signature, m.is_export, m.directives, m.description, m.line_start, m.line_end, m.body) for m in C.split_module(t)[1]))


def residual(modules: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Each module's text without its methods' code."""
    return expand(modules, keys, text, "residual string", lambda t: [(C.split_module(t)[0],)])


def call_facts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """All calls: line, form, left, name, conditions."""
    return expand(texts, keys, text, "line int, form string, left string, name string, conditions array<string>", lambda t: ((c.line, c.form, c.left, c.name, list(c.conditions)) for c in C.calls(t)))


def uses(methods: DataFrame, keys: list[str]) -> DataFrame:
    """What methods (name, signature, body) name beyond themselves: keys, kind, line, left and name."""
    def rows(both):
        m = json.loads(both)
        return C.uses(m.get("body") or "", [n for n, _, _ in C.parameters(m.get("signature") or "")], m.get("name"))

    packed = methods.select(*keys, F.to_json(F.struct("name", "signature", "body")).alias("__method"))
    return expand(packed, keys, "__method", "kind string, line int, left string, name string", rows)


def metadata_facts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    return expand(texts, keys, text, "line int, type string, name string", C.metadata_uses)


def literal_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    return expand(texts, keys, text, "offset int, line int, value string", C.literals)


def query_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    return expand(texts, keys, text, "line int, query string, complete boolean", C.embedded_queries)


def schema_rows(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    return expand(texts, keys, text, "kind string, name string, line int", C.result_schema)


def query_violations(texts: DataFrame, keys: list[str], text: str, context: Context) -> DataFrame:
    """Errors of the query texts in literals, at the literal's 0-based line and column."""
    sent = texts.sparkSession.sparkContext.broadcast(context)

    def rows(t):
        at = C.Lines.of(t)
        for offset, _, value in C.literals(t):
            if C.QUERY_HEAD.match(value) and C.QUERY_SOURCE.search(value):
                line, col = at(offset)
                for e in check(value, sent.value).errors:
                    yield line, col, line + value.count("\n"), e

    return expand(texts, keys, text, "line int, col int, line_end int, message string", rows)


def dependency_state(calls: DataFrame, modules: DataFrame, methods: DataFrame) -> DataFrame:
    """Dotted calls with their state: ok, not_export, missing_method or unknown_module.

    calls: caller keys, left, name; modules: module; methods: module, name, is_export."""
    low = lambda c: F.lower(c)
    m = modules.select(low("module").alias("l")).distinct().withColumn("known", F.lit(True))
    n = methods.select(low("module").alias("l"), low("name").alias("n"), "is_export").groupBy("l", "n").agg(F.bool_or("is_export").alias("is_export"))
    dotted = calls.where("form = 'dotted'").withColumn("l", low("left")).withColumn("n", low("name"))
    both = dotted.join(m, "l", "left").join(n, ["l", "n"], "left")
    state = F.when(F.col("known").isNull(), "unknown_module").when(F.col("is_export").isNull(), "missing_method").when(~F.col("is_export"), "not_export").otherwise("ok")
    return both.withColumn("state", state).drop("l", "n", "known", "is_export")
