"""The check over many stored texts: the context goes with the tasks, texts stay in place."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.operators.code import spread
from lodestone.ql.checker import Context, check


def check_texts(texts: DataFrame, key: str, query: str, context: Context) -> DataFrame:
    """key and error: one row per error, or one with a null error for a sound query."""
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("error", T.StringType())])
    sent = texts.sparkSession.sparkContext.broadcast(context)

    def run(batches):
        for batch in batches:
            source, errors = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for e in check(text or "", sent.value).errors or [None]:
                    source.append(i)
                    errors.append(e)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), pa.array(errors, pa.string())], [key, "error"])

    return spread(texts.select(key, query)).mapInArrow(run, schema)
