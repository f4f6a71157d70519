"""Embedding whitening: a compensated covariance of all distinct vectors, then projections on its leading eigenvectors.

Entries become integers, x = floor(scale * entry). The distinct x-vectors are found by one shuffle of their packed bytes, in which
each task has already merged its copies, and are kept as a table; two passes over it give the mean and the covariance.

Covariance: a row is centred in double-double (an exact difference and its error). A batch of centred rows is split, column by
column, into `SLICES` slices of `BITS` bits on a common grid; so every product of two slices, summed over the batch, is exact in a double,
whatever order a matrix product takes, and the split is an error-free transformation of the batch's outer products. The batches' sums are added up by two-sums into
a high and a low part, and the parts of all tasks are merged the same way, in two rounds of groups of matrix rows.

Eigenvectors: LAPACK's symmetric solver (Householder tridiagonalisation, then divide and conquer) on the high part; the leading ones
are then refined by residuals taken in double-double, so that close eigenvalues don't cost digits.

Defined results: rows whose vector is null, or holds a null, NaN or infinite entry, are dropped. So are rows of another length than most rows
have (of the longest such, if lengths tie): they have no coordinates in common. Null and repeated ids stay. Entries beyond the range of a long count as its
ends. A component whose eigenvalue is 0 (to 1e-13 of the largest) can't be whitened and is left out, so one distinct vector, or none, gives no row. `deviation` is
null where it is no long.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hold

SCALE, COMPONENTS = 256, 4
#: Bits of a slice, and rows of a batch: a sum of products of two slices has 2 * BITS + log2(ROWS) bits, at most 53.
BITS, ROWS = 21, 1024
SLICES = 4
#: First-round groups of a matrix row's partial sums.
PARTS = 32


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as the nearest double and what that leaves out, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def plus(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The double-double high + low plus the double-double more + rest."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, np.broadcast_to(rest, np.shape(low)))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(high: np.ndarray, low: np.ndarray, grid: np.ndarray) -> list[np.ndarray]:
    """Slices of each column of high + low: multiples of 2^-BITS, 2^-2BITS and so on of its power of two in `grid`."""
    out, unit = [], grid
    for _ in range(SLICES):
        unit = unit * 2.0**-BITS
        part = np.rint(high / unit) * unit
        high, low = two_sum(high - part, low)
        out.append(part)
    return out


def outer(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the outer products of `ROWS` rows at most, as a double-double."""
    top = np.abs(high).max(axis=0)
    grid = np.exp2(np.ceil(np.log2(np.where(top > 0, top, 1.0)))) * 2.0
    parts = [s / grid for s in slices(high, low, grid)]
    total, rest = np.zeros((high.shape[1],) * 2), np.zeros((high.shape[1],) * 2)
    for order in range(SLICES + 1):
        for k in range(max(0, order - SLICES + 1), order // 2 + 1):
            exact = parts[k].T @ parts[order - k]
            total, rest = plus(total, rest, exact)
            if 2 * k < order:
                total, rest = plus(total, rest, exact.T)
    unit = np.outer(grid, grid)
    return total * unit, rest * unit


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * value) as longs."""
    x = np.floor(values * float(SCALE))
    out = np.clip(x, -(2.0**63), 2.0**62).astype(np.int64)
    out[x > 2.0**62] = np.where(x[x > 2.0**62] >= 2.0**63, np.iinfo(np.int64).max, np.clip(x[x > 2.0**62], 0, 2.0**63 - 1024).astype(np.int64))
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _keys(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Each distinct vector of a batch once, packed in the least width that holds all its entries: equal vectors are equal bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        packed = set()
        for at in range(0, batch.num_rows, ROWS):
            x = integers(_matrix(batch.column(0).slice(at, ROWS), dims))
            top = np.maximum(x.max(axis=1), -1 - x.min(axis=1))
            for kind, least, most in ((np.int16, 0, 2**15 - 1), (np.int32, 2**15, 2**31 - 1), (np.int64, 2**31, 2**63 - 1)):
                packed.update(r.tobytes() for r in x[(top >= least) & (top <= most)].astype(kind))
        yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.binary())], names=["x"])


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of `_keys` again, in any order."""
    rows = column.to_pylist()
    parts = [np.frombuffer(b"".join(r for r in rows if len(r) == dims * np.dtype(kind).itemsize), kind).reshape(-1, dims).astype(np.int64) for kind in (np.int16, np.int32, np.int64)]
    return np.concatenate(parts)


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Per-dimension sums of a task, in two halves of 32 bits, so that no sum leaves a long."""
    n, low, high = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
    for batch in batches:
        x = _unpacked(batch.column(0), dims)
        n += len(x)
        low += (x & 0xFFFFFFFF).sum(axis=0)
        high += (x >> 32).sum(axis=0)
    if n:
        arrays = [pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(low), pa.array(high)]
        yield pa.RecordBatch.from_arrays(arrays, names=["k", "n", "low", "high"])


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """sums / n as a double-double."""
    exact = [Fraction(s, n) for s in sums]
    high = [float(m) for m in exact]
    return np.array(high), np.array([float(m - Fraction(h)) for m, h in zip(exact, high, strict=True)])


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x - mean as a double-double; x may have more bits than a double."""
    top = x.astype(np.float64)
    top[top >= 2.0**63] = 2.0**63 - 1024
    high, low = two_sum(top, -mean[0])
    return two_sum(high, low + ((x - top.astype(np.int64)).astype(np.float64) - mean[1]))


def _covariance(batches: Iterator[pa.RecordBatch], dims: int, mean: tuple[np.ndarray, np.ndarray], seed: int = 0) -> Iterator[pa.RecordBatch]:
    high, low, n = np.zeros((dims, dims)), np.zeros((dims, dims)), 0
    for batch in batches:
        x = _unpacked(batch.column(0), dims)
        for at in range(0, len(x), ROWS):
            high, low = plus(high, low, *outer(*centred(x[at : at + ROWS], mean)))
        if len(x):
            seed, n = seed ^ int(x[0, 0]) ^ len(x), n + len(x)
    if n:
        yield _rows(np.arange(dims), high, low, seed % PARTS)


def _rows(index: np.ndarray, high: np.ndarray, low: np.ndarray, part: int) -> pa.RecordBatch:
    width = high.shape[1] if len(index) else 0
    lists = [pa.ListArray.from_arrays(np.arange(0, len(index) * width + 1, width, dtype=np.int32), pa.array(np.ascontiguousarray(v).reshape(-1))) for v in (high, low)]
    return pa.RecordBatch.from_arrays([pa.array(index.astype(np.int64)), pa.array(np.full(len(index), part)), *lists], names=["i", "part", "high", "low"])


_PARTIAL = "i long, part long, high array<double>, low array<double>"


def _merge(table: pa.Table) -> pa.Table:
    """One row of a matrix from its partial sums, taken in the order of their values, so that reruns agree."""
    rows = sorted(zip(table["high"].to_pylist(), table["low"].to_pylist(), strict=True))
    high, low = np.array(rows[0][0]), np.array(rows[0][1])
    for h, e in rows[1:]:
        high, low = plus(high, low, np.array(h), np.array(e))
    return pa.Table.from_batches([_rows(np.array([table["i"][0].as_py()]), high[None], low[None], 0)])


def _scaled(high: np.ndarray, low: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The double-double times doubles (Dekker's product)."""
    p = high * by

    def split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = v * 134217729.0
        top = t - (t - v)
        return top, v - top

    (a, b), (c, d) = split(high), split(np.broadcast_to(by, np.shape(high)))
    return two_sum(p, ((a * c - p) + a * d + b * c) + b * d + low * by)


def _product(high: np.ndarray, low: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(high + low) @ v for each row, as a double-double."""
    p, e = _scaled(high, low, v)
    total, rest = np.zeros(len(high)), np.zeros(len(high))
    for k in range(high.shape[1]):
        total, rest = plus(total, rest, p[:, k], e[:, k])
    return total, rest


def eigen(high: np.ndarray, low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and unit eigenvectors in rows, of a symmetric double-double matrix."""
    unit = 2.0 ** np.ceil(np.log2(np.abs(high).max() or 1.0))
    high, low = high / unit, low / unit
    values, vectors = np.linalg.eigh(high)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    top, out = [], []
    for k in range(min(most, len(values))):
        q, rest, value = vectors[:, k].copy(), np.zeros(len(values)), values[k]
        for _ in range(4):
            # The residual of q + rest, where rest holds what q has no digits for.
            a, e = _product(high, low, q)
            norm, norm_e = _product(q[None], rest[None], q)
            ray, ray_e = _product(a[None], (e + high @ rest)[None], q)
            value = (ray[0] + ray_e[0] + a @ rest) / (norm[0] + norm_e[0] + q @ rest)
            p, f = _scaled(q, np.zeros_like(q), np.array(-value))
            r, r_e = plus(a, e, p, f)
            r = r + (r_e + high @ rest - value * rest)
            along = vectors.T @ (r - q * (q @ r))  # the eigenvalue's own rounding lies along q
            gap = value - values
            close = np.abs(gap) <= 1e-15
            close[k] = True
            q, rest = two_sum(q, rest + vectors @ np.where(close, 0.0, along / np.where(close, 1.0, gap)))
        length = np.sqrt(float(q @ q + 2 * (q @ rest)))
        top.append(value)
        out.append((q + rest) / length)
    return np.array(top) * unit, np.array(out).reshape(len(top), len(values))


def _identity(batches: Iterator[pa.RecordBatch], dims: int, mean: tuple[np.ndarray, np.ndarray], values: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each pair of components the task's sum of products of whitened coordinates."""
    total = np.zeros((len(values),) * 2)
    for batch in batches:
        high, low = centred(_unpacked(batch.column(0), dims), mean)
        w = (high @ vectors.T + low @ vectors.T) / np.sqrt(values)
        total += w.T @ w
    pair = np.arange(total.size)
    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total.reshape(-1))], names=["pair", "s"])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum over dimensions of (n * x - S)^2 of each row, exact; null where it is no long."""
    top = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    most = n * top + max(map(abs, sums), default=0)
    if most * most * len(sums) < 2**63:
        d = n * x - np.array(sums, np.int64)
        return pa.array((d * d).sum(axis=1))
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def _projected(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, explained: np.ndarray, error: float) -> Iterator[pa.RecordBatch]:
    mean, kept = _mean(n, sums), len(values)
    for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
        rows = batch.num_rows
        x = integers(_matrix(batch.column(1), len(sums)))
        high, low = centred(x, mean)
        w = (high @ vectors.T + low @ vectors.T) / np.sqrt(values)
        each = pa.array(np.repeat(np.arange(rows), kept))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows)), pa.array(np.full(rows * kept, n)), deviations(x, n, sums).take(each),
                pa.array(w.reshape(-1)), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * kept, error)),
            ],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the rows whose vector has finite entries only, as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def covariance(distinct: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray, np.ndarray]:
    """n, sums, and the high and low part of the covariance (divisor n) of a table of packed vectors; d * d numbers reach the driver."""
    found = distinct.mapInArrow(lambda it: _sums(it, dims), "k long, n long, low long, high long").groupBy("k")
    found = found.agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high"))).orderBy("k").collect()
    n, sums = (int(found[0].n) if found else 0), [int(r.low) + (int(r.high) << 32) for r in found]
    high, low = np.zeros((dims, dims)), np.zeros((dims, dims))
    if n:
        mean = _mean(n, sums)
        partial = distinct.mapInArrow(lambda it: _covariance(it, dims, mean), _PARTIAL)
        merged = partial.groupBy("i", "part").applyInArrow(_merge, _PARTIAL).groupBy("i").applyInArrow(_merge, _PARTIAL).collect()
        for r in merged:
            high[r.i], low[r.i] = r.high, r.low
        share = high / n
        back, rest = _scaled(share, np.zeros_like(share), np.array(float(n)))
        high, low = two_sum(share, ((high - back) - rest + low) / n)
    return n, sums, high, low


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row of `vectors` and leading component."""
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    nothing = vectors.sparkSession.createDataFrame([], _RESULT)
    if lengths is None or lengths.dims == 0:
        return nothing
    dims = lengths.dims
    rows = rows.filter(F.size("v") == dims)
    distinct = hold(rows.select("v").mapInArrow(lambda it: _keys(it, dims), "x binary").distinct(), "distinct")
    n, sums, high, low = covariance(distinct, dims)
    values, axes = eigen(high, low, most)
    good = values > 1e-13 * values[0] if values[0] > 0 else np.zeros(len(values), bool)
    values, axes = values[good], axes[good]
    if not len(values):
        return nothing
    mean = _mean(n, sums)
    found = distinct.mapInArrow(lambda it: _identity(it, dims, mean, values, axes), "pair long, s double").groupBy("pair").agg(F.sum("s").alias("s")).collect()
    unit = np.eye(len(values)).reshape(-1)
    error = max(abs(r.s / n - unit[r.pair]) for r in found)
    explained = values / np.trace(high)
    return rows.mapInArrow(lambda it: _projected(it, n, sums, values, axes, explained, error), _RESULT)


def op12_whitening(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings)
