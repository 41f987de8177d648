"""Shared pieces of the training-data operators: durable cuts of lineage, scratch
folders and vectorised views of Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; bounds the worker's memory.
STEP_BYTES = 2 << 20

#: The white space of the contracts, `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one where unset."""
    jsc = spark.sparkContext._jsc.sc()
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(set_)
        return set_
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: lost executors cost nothing."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    free_shuffles(df.sparkSession)
    return out


_FREED = [0.0]


def free_shuffles(spark: SparkSession, pause: float = 2.0) -> None:
    """Asks the driver to collect garbage (every ``pause`` seconds at most): Spark deletes the shuffle
    files of steps that nothing refers to only then, and they would fill the executors' disks."""
    if time.monotonic() - _FREED[0] >= pause:
        gc.collect()  # data frames in cycles still hold their plans, and these the shuffles
        spark.sparkContext._jvm.System.gc()
        _FREED[0] = time.monotonic()


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a `cut` that nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        delete_path(df.sparkSession, file.get())


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one; it goes when the block ends."""
    path = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete_path(spark, path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table at ``path``, read with its own schema."""
    df.write.mode("overwrite").parquet(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a row number that is the same in every scan of the same stored table.

    Splits of files depend on the cores that are up; they are pinned here, so that a lost
    executor cannot change the numbers between two scans. ``docs`` must come straight from
    files (or a checkpoint), not from a shuffle."""
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        conf.set("spark.sql.files.minPartitionNum", str(max(1, docs.sparkSession.sparkContext.defaultParallelism)))
    return docs.withColumn(name, F.monotonically_increasing_id())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker keeps from task to task, by the operator that may do so.
WORKER_CACHES: dict[str, object] = {}


def give_back() -> None:
    """Freed memory goes back to the system: that of Arrow's pool, and the C library's where it can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def steps(batches, column: str = "text", limit: int = STEP_BYTES, cache: str | None = None):
    """Slices of the Arrow batches whose texts have at most ``limit`` bytes (or one row).

    Yields (batch, large_string array without nulls, byte offsets). A worker serves all
    operators in turn, so the caches of others than ``cache`` go at the start, and freed
    memory is given back at the end."""
    for name in [n for n in WORKER_CACHES if n != cache]:
        del WORKER_CACHES[name]
    try:
        yield from _steps(batches, column, limit)
    finally:
        give_back()


def _steps(batches, column: str, limit: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        texts = texts.cast(pa.large_string()).fill_null("")
        offs = offsets(texts)
        at = 0
        while at < len(texts):
            end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), len(texts))
            yield batch.slice(at, end - at), texts.slice(at, end - at), offs[at : end + 1] - offs[at]
            at = end


def offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]


def utf8(texts: pa.Array) -> np.ndarray:
    """The UTF-8 bytes of a large_string array, one text after the other."""
    offs, data = offsets(texts), texts.buffers()[2]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, dtype=np.uint8)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, STEP_BYTES + 1)
        _POWERS[:] = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0][:n], _POWERS[1][:n]


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False):
    """The words `[^\\x20\\x09-\\x0D]+` of texts laid end to end.

    Returns (start, end, doc, hash64): byte positions, the index of the text, and a
    64-bit polynomial hash of the word's bytes, A-Z lowered if ``lower``."""
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offs] = True
    edge = np.empty(len(data), dtype=bool)  # a word may begin here
    if len(data):
        edge[0] = True
        edge[1:] = space[:-1]
        edge |= first[:-1]
    start = np.flatnonzero(edge & ~space)
    stop = np.empty(len(data), dtype=bool)
    if len(data):
        stop[-1] = True
        stop[:-1] = space[1:]
        stop |= first[1:]
    end = np.flatnonzero(stop & ~space) + 1
    doc = np.searchsorted(offs, start, side="right") - 1
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    values = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    np.cumsum(values * power[:-1], out=sums[1:])
    hash_ = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return start, end, doc, hash_


def not_null_text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bits of a membership filter: 8 to 16 a key, within these bounds. At most 2**19 words of 64 bits are broadcast.
FILTER_BITS = 1 << 16, 1 << 25


def filter_size(keys: int) -> int:
    least, most = FILTER_BITS
    return min(max(least, 1 << (8 * keys).bit_length()), most)


def _place(key: str, size: int):
    at = F.pmod(F.xxhash64(key), F.lit(size))
    return F.shiftright(at, 6).alias("__word"), at.bitwiseAND(F.lit(63)).cast("int").alias("__bit")


def filter_of(keys: DataFrame, key: str, size: int) -> DataFrame:
    """A membership filter of ``keys``: 64-bit words of ``size`` bits, as (__word, __mask)."""
    return keys.select(*_place(key, size)).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__mask"))


def passing(df: DataFrame, key: str, filter_: DataFrame, size: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` the filter (broadcast, at most its largest size) lets pass."""
    rows = df.select("*", *_place(key, size)).join(F.broadcast(filter_), "__word")
    return rows.where(F.expr("shiftrightunsigned(__mask, __bit) & 1L") == 1).drop("__word", "__bit", "__mask")


def maybe_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among those of ``keys`` (same column name, stored).

    A filter sized by the number of keys, up to a fixed size, is broadcast. It lets some other
    rows pass (all of them, far beyond its largest size), so an exact join follows."""
    size = filter_size(keys.count())
    return passing(df, key, filter_of(keys, key, size), size)
