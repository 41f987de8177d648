"""Embedding whitening: components of a compensated covariance, and vectors projected on them.

Entries become integers x = floor(256 c). The fit list holds each distinct x vector once; it
is stored as packed integers (one distinct aggregate that combines in the map tasks, so a
vector with a third of the rows is one row a task). Sums are exact. The covariance is
accumulated in double-double: each task centres its vectors by error-free subtraction, cuts
the centred columns into slices of 20 bits (by column, so that columns of any scale keep
their bits), multiplies the slices as matrices, which is exact in doubles for blocks of
`BLOCK` rows, and adds the products with two-sums. A task gives the high and the low part of
its d x d matrix; parts are merged pairwise with two-sums in tasks, at most `FAN_IN` in one,
until `FAN_IN` are left, so the driver never holds more than that many matrices.

The eigen-solve runs on the driver over one d x d matrix: Householder reduction to
tridiagonal form and divide and conquer (LAPACK's `syevd`, numpy's `eigh`). A second pass
over the fit list gives the covariance of the whitened vectors, whose distance from the
identity comes with each row.

Edge cases: rows whose vector is null, empty, or holds a null or non-finite entry, or one too
large for a 64-bit x, are dropped; of vectors of several lengths the most frequent length
counts (of ties the longer), the others are dropped; repeated rows each get their rows, but
count once in the fit; null ids stay; an empty table gives an empty result; where the
covariance has fewer than k components of an eigenvalue above rounding, the others have
``explained`` 0 and null ``whitened`` and are no part of the identity error; a deviation
beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import give_back, scratch, stored, table

SCALE, COMPONENTS = 256, 4
BLOCK = 4096  # rows of a block: sums of BLOCK products of 20-bit slices are exact in 53 bits
SLICE_BITS, SLICES = 20, 5
FAN_IN = 16
KINDS = [np.int8, np.int16, np.int32, np.int64]


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as the rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def integers(batch: pa.RecordBatch, name: str, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the usable rows, their x vectors) of a batch; without ``dims``, lengths instead of vectors."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.list_(pa.float64()))
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = column.flatten()  # the entries of all vectors that are not null
    entries = np.floor(SCALE * np.asarray(flat.fill_null(np.nan), dtype=np.float64))
    ends = np.cumsum(lengths)
    bad = ~(np.abs(entries) < 2.0**63)  # also what is no number
    bad_before = np.append(0, np.cumsum(bad))
    good = (lengths > 0) & (bad_before[ends] == bad_before[ends - lengths])
    if dims is None:
        return np.flatnonzero(good), lengths[good]
    rows = np.flatnonzero(good & (lengths == dims))
    at = (ends[rows] - dims)[:, None] + np.arange(dims)
    return rows, entries[at].astype(np.int64) if len(rows) else np.zeros((0, dims), dtype=np.int64)


def pack(x: np.ndarray) -> list[bytes]:
    """Each vector as a byte for the least fitting width and its integers; equal vectors, equal bytes."""
    low, high = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    width = sum(((low < np.iinfo(k).min) | (high > np.iinfo(k).max)).astype(int) for k in KINDS[:3])
    return [bytes([w]) + v.astype(KINDS[w]).tobytes() for w, v in zip(width.tolist(), x, strict=True)]


def unpack(packed: pa.Array, dims: int) -> np.ndarray:
    """The x vectors of packed ones, as int64."""
    out = np.empty((len(packed), dims), dtype=np.int64)
    for i, v in enumerate(packed.to_pylist()):
        out[i] = np.frombuffer(v, dtype=KINDS[v[0]], offset=1)
    return out


def _blocks(batches, dims: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield unpack(batch.column(0).slice(at, BLOCK), dims)


def fit_list(vectors: DataFrame, vector_col: str, path: str) -> tuple[DataFrame, int]:
    """(the distinct x vectors, packed and stored at ``path``; their length, 0 without any)."""
    def lengths(batches):
        for batch in batches:
            found = np.unique(integers(batch, "v", None)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["dims", "n"])

    rows = vectors.select(F.col(vector_col).alias("v"))
    best = rows.mapInArrow(lengths, "dims long, n long").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = best["dims"] if best else 0

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pack(integers(batch, "v", dims)[1]), pa.binary())], ["x"])
        give_back()

    return stored(rows.mapInArrow(packed, "x binary").distinct(), path), dims


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(n, the exact sum of each dimension): high and low halves are summed in 64 bits, then as decimals."""
    def run(batches):
        n, high, low = 0, np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64)
        for x in _blocks(batches, dims):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(np.append(high, 0)), pa.array(np.append(low, n))], ["at", "high", "low"])

    rows = fit.mapInArrow(run, "at long, high long, low long").groupBy("at").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")))
    found = {r["at"]: int(r["low"]) + (int(r["high"]) << 32) for r in rows.collect()}  # dims + 1 rows
    return found.get(dims, 0), [found.get(i, 0) for i in range(dims)]


def mean_of(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S/n as a double-double."""
    exact = [Fraction(s, n) for s in total]
    high = np.array([float(v) for v in exact])
    return high, np.array([float(v - Fraction(h)) for v, h in zip(exact, high.tolist(), strict=True)])


def centred(x: np.ndarray, mean: tuple) -> tuple[np.ndarray, np.ndarray]:
    """x - S/n as a double-double; x of up to 64 bits is split so that no bit is lost."""
    high = (x >> 26) << 26
    a = two_sum(high.astype(np.float64), (x - high).astype(np.float64))
    return add(a, (-mean[0], -mean[1]))


def slices(y: tuple) -> list[np.ndarray]:
    """Columns of a double-double as sums of integers of SLICE_BITS times a power of two, one for each column and slice."""
    top = np.abs(y[0]).max(axis=0, initial=0.0)
    exponent = np.frexp(top)[1] + 1
    rest, low, out = y[0], y[1], []
    for k in range(1, SLICES + 1):
        unit = np.ldexp(1.0, exponent - SLICE_BITS * k)
        part = np.rint(rest / unit) * unit
        out.append(part)
        rest, low = two_sum(rest - part, low)  # rest - part is exact
    return out


def products(y: tuple, acc: tuple) -> tuple[np.ndarray, np.ndarray]:
    """``acc`` plus the outer products of the rows of ``y``: every matrix product is exact."""
    parts = slices(y)
    for i in range(SLICES):
        for j in range(SLICES - i):
            acc = add(acc, (p := parts[i].T @ parts[j], np.zeros_like(p)))
    return acc


def merged(parts: DataFrame, size: int, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum of rows (high binary, low binary) of ``size`` doubles."""
    def run(batches):
        acc = None
        for batch in batches:
            for h, lo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(h), np.frombuffer(lo)
                acc = part if acc is None else add(acc, part)
        if acc is not None:
            yield _row(acc)

    parts = stored(parts, f"{path}_0")
    left, level = parts.count(), 0
    while left > FAN_IN:
        level += 1
        parts = stored(parts.repartition(-(-left // FAN_IN)).mapInArrow(run, parts.schema), f"{path}_{level}")
        left = parts.count()
    acc = np.zeros(size), np.zeros(size)
    for r in parts.collect():  # FAN_IN matrices at most
        acc = add(acc, (np.frombuffer(r["high"]), np.frombuffer(r["low"])))
    return acc


def _row(acc: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in acc], ["high", "low"])


def covariance(fit: DataFrame, n: int, mean: tuple, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The covariance of the fit list, divisor n, as a double-double d x d matrix."""
    dims = len(mean[0])

    def run(batches):
        acc = np.zeros((dims, dims)), np.zeros((dims, dims))
        for x in _blocks(batches, dims):
            acc = products(centred(x, mean), acc)
        yield _row(acc)
        give_back()

    high, low = merged(fit.mapInArrow(run, "high binary, low binary"), dims * dims, path)
    return _divided((high + high.reshape(dims, dims).T.ravel()) / 2, (low + low.reshape(dims, dims).T.ravel()) / 2, n, dims)


def _divided(high: np.ndarray, low: np.ndarray, n: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    exact = [(Fraction(h) + Fraction(lo)) / n for h, lo in zip(high.tolist(), low.tolist(), strict=True)]
    top = np.array([float(v) for v in exact])
    rest = np.array([float(v - Fraction(t)) for v, t in zip(exact, top.tolist(), strict=True)])
    return top.reshape(dims, dims), rest.reshape(dims, dims)


def fit(vectors: DataFrame, vector_col: str = "embedding", k: int = COMPONENTS) -> dict | None:
    """The whitening model of ``vectors`` (a stored table); None without usable vectors.

    n, sums S (exact), mean (double-double), components (d x k, unit columns), eigenvalues,
    explained, identity_error."""
    spark = vectors.sparkSession
    with scratch(spark) as path:
        rows, dims = fit_list(vectors, vector_col, f"{path}/fit")
        if not dims:
            return None
        n, total = sums(rows, dims)
        mean = mean_of(n, total)
        top, rest = covariance(rows, n, mean, f"{path}/covariance")
        values, axes = np.linalg.eigh(top)  # LAPACK syevd: tridiagonal form, divide and conquer
        order = np.argsort(-values, kind="stable")[:k]
        values, axes = values[order], axes[:, order]
        # one Rayleigh quotient with the low part of the matrix
        values = values + np.einsum("ij,ik,kj->j", axes, rest, axes)
        trace = float(np.trace(top) + np.trace(rest))
        live = values > dims * np.finfo(float).eps * max(trace, 0.0)
        model = {"n": n, "sums": total, "mean": mean, "components": axes, "eigenvalues": values, "live": live,
                 "explained": np.where(live, values / trace if trace > 0 else 0.0, 0.0)}
        model["identity_error"] = _identity_error(rows, model, f"{path}/identity")
        return model


def _whitened(x: np.ndarray, model: dict) -> np.ndarray:
    """Rows of x, projected; nan for components without an eigenvalue."""
    high, low = centred(x, model["mean"])
    scale = np.sqrt(np.where(model["live"], model["eigenvalues"], np.nan))
    return ((high + low) @ model["components"]) / scale


def _identity_error(rows: DataFrame, model: dict, path: str) -> float:
    """Largest entry of (covariance of the whitened fit list - identity): sums and products in double-double."""
    live = model["live"]
    k, dims = int(live.sum()), len(model["sums"])
    if not k:
        return 0.0

    def run(batches):
        acc = np.zeros((k + 1, k + 1)), np.zeros((k + 1, k + 1))
        for x in _blocks(batches, dims):
            w = np.column_stack([_whitened(x, model)[:, live], np.ones(len(x))])  # the last column gives the sums
            acc = products((w, np.zeros_like(w)), acc)
        yield _row(acc)

    high, low = merged(rows.mapInArrow(run, "high binary, low binary"), (k + 1) ** 2, path)
    all_ = (high + low).reshape(k + 1, k + 1) / model["n"]
    mean = all_[:k, k]
    return float(np.abs(all_[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    largest = max((abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))) * n + max(map(abs, total), default=0)
    if largest * largest * max(len(total), 1) < 1 << 63:
        return ((n * x - np.array(total, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    whole = ((n * x.astype(object) - np.array(total, dtype=object)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in whole]


def whiten(vectors: DataFrame, model: dict | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    one = [f for f in vectors.schema.fields if f.name == id_col][0].dataType.simpleString()
    schema = f"id {one}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dims, k = len(model["sums"]), len(model["eigenvalues"])

    def run(batches):
        for batch in batches:
            rows, x = integers(batch, "v", dims)
            w, dev = _whitened(x, model), deviation(x, model["n"], model["sums"])
            ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
            count = len(rows)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, model["n"], dtype=np.int64)),
                pa.array([v for v in dev for _ in range(k)], pa.int64()), pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                pa.array(np.tile(model["explained"], count)), pa.array(np.full(count * k, model["identity_error"]))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        give_back()

    return named.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(vectors, fit(vectors))
