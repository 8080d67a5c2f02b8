"""Whitening of embeddings along the leading eigenvectors of their covariance.

Vectors are brought to whole numbers, each distinct one is kept once, and their sums and
covariance are added up over partitions. The matrix, whose size depends on the number of
dimensions alone, is solved on the driver: eigenvectors in single precision, which
Ogita-Aishima iterations of a few matrix products in a higher one correct to the last
digits. Where eigenvalues lie too close for the correction, the block of their vectors
is diagonalised by a solve of its own, shifted by their mean.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import column_of, pick
from linkloom.sources.lineage import cut

#: Up to so many dimensions products are taken in extended precision, else in double.
EXTENDED = 512
_WIDTHS = {b"h": np.int16, b"i": np.int32, b"q": np.int64}


# eigenvectors


def eigenpairs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors (columns) of a symmetric matrix."""
    size = float(np.abs(matrix).max(initial=0.0))
    if size == 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    wide = np.longdouble if len(matrix) <= EXTENDED else np.float64
    a = matrix.astype(wide) / wide(size)
    x = np.linalg.eigh((matrix / size).astype(np.float32))[1][:, ::-1].astype(wide)
    before = np.inf
    for _ in range(30):
        x, values, change = _corrected(a, x)
        if change <= 4 * np.finfo(np.float64).eps or change >= before and change < 1e-10:
            break
        before = change
    x = x + x @ (np.eye(len(a), dtype=wide) - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return (values[order] * wide(size)).astype(np.float64), x.astype(np.float64)


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction of approximate eigenvectors, and a solve for each cluster of eigenvalues."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    ax = a @ x
    s = x.T @ ax
    s, r = (s + s.T) / 2, (r + r.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: float(np.linalg.norm(m.astype(np.float64), 2))
    near = 2 * (norm(s - np.diag(values)) + norm(a) * norm(r))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    x = x + x @ e
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    starts = np.flatnonzero(np.r_[True, -np.diff(values) > near])
    change = float(np.abs(e).max())
    for first, end in zip(starts, [*starts[1:], len(values)], strict=True):
        if end - first > 1:
            block = x[:, first:end]
            middle = values[first:end].mean()
            inner = (block.T @ (a @ block - middle * block)).astype(np.float64)
            turn = np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1]
            x[:, first:end] = block @ turn.astype(a.dtype)
            values[first:end] = np.einsum("ij,ij->j", x[:, first:end], a @ x[:, first:end])
            moved = np.abs(inner - np.diag(np.diag(inner))).max()
            if moved > 1e-14:
                change = max(change, float(moved / max(near, 1e-300)))
    return x, values, change


# vectors


def _coded(x: np.ndarray) -> list[bytes]:
    """Each vector of whole numbers in the narrowest of three widths, marked by its first byte."""
    low, high = x.min(axis=1), x.max(axis=1)
    narrow = {mark: (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max) for mark, kind in _WIDTHS.items()}
    marks = np.where(narrow[b"h"], b"h", np.where(narrow[b"i"], b"i", b"q"))
    return [mark + row.astype(_WIDTHS[mark]).tobytes() for mark, row in zip(marks.tolist(), x, strict=True)]


def _decoded(column: pa.Array, dims: int) -> np.ndarray:
    found = np.empty((len(column), dims), np.int64)
    for k, data in enumerate(column.to_pylist()):
        found[k] = np.frombuffer(data, _WIDTHS[data[:1]], offset=1)
    return found


def _whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(256 c), at most the ends of a long."""
    with np.errstate(over="ignore"):
        scaled = np.floor(256 * values)
    whole = np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    whole[scaled >= 2.0**63] = np.iinfo(np.int64).max
    return whole


def _read(batches):
    """vec_id, dims, x of the vectors without nulls and with finite entries only."""
    for batch in batches:
        vectors = column_of(batch, "vector")
        vectors = vectors.cast(pa.large_list(vectors.type.value_type))
        starts, sizes = np.asarray(vectors.offsets)[:-1], np.diff(np.asarray(vectors.offsets))
        entries = vectors.values
        values = entries.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(entries) else np.zeros(0)
        there = np.asarray(vectors.is_valid().to_numpy(zero_copy_only=False), bool) & (sizes > 0)
        rows, kept = np.zeros(0, np.int64), []
        for dims in np.unique(sizes[there]):
            which = np.flatnonzero(there & (sizes == dims))
            found = values[starts[which, None] + np.arange(dims)]
            finite = np.isfinite(found).all(axis=1)
            rows = np.r_[rows, which[finite]]
            kept += _coded(_whole_numbers(found[finite])) if finite.any() else []
        yield pa.record_batch({"vec_id": column_of(batch, "vec_id").take(pa.array(rows)), "dims": pa.array(sizes[rows].astype(np.int32)), "x": pa.array(kept, pa.binary())})


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dims, x (packed whole numbers) of the rows that take part."""
    rows = pick(table, vec_id=id_col, vector=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    return rows.withColumn("vector", F.col("vector").cast("array<double>")).mapInArrow(_read, "vec_id long, dims int, x binary")


def _sums(dims: int) -> Callable:
    def run(batches):
        high, low, n = np.zeros(dims, np.int64), np.zeros(dims, np.int64), 0
        for batch in batches:
            x = _decoded(column_of(batch, "x"), dims)
            high, low, n = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0), n + len(x)
        if n:
            yield pa.record_batch({"dim": pa.array(np.arange(dims, dtype=np.int32)), "high": pa.array(high), "low": pa.array(low), "n": pa.array(np.full(dims, n))})

    return run


def _products(mean: np.ndarray) -> Callable:
    def run(batches):
        total = None
        for batch in batches:
            x = _decoded(column_of(batch, "x"), len(mean)) - mean
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.record_batch({"dim": pa.array(np.arange(len(mean), dtype=np.int32)), "row": pa.array([r.tobytes() for r in total], pa.binary())})

    return run


def _added(batches):
    """The sum of the rows of each dimension; rows are sorted by dimension."""
    now, total = None, None
    for batch in batches:
        out = []
        for dim, row in zip(*[column_of(batch, c).to_pylist() for c in ("dim", "row")], strict=True):
            if dim != now and now is not None:
                out.append((now, total.tobytes()))
            total, now = np.frombuffer(row) + (total if dim == now else 0), dim
        yield pa.record_batch({"dim": pa.array([d for d, _ in out], pa.int32()), "row": pa.array([r for _, r in out], pa.binary())})
    if now is not None:
        yield pa.record_batch({"dim": pa.array([now], pa.int32()), "row": pa.array([total.tobytes()], pa.binary())})


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Number, exact sums and covariance (divisor n, centred first) of the vectors ``fit(x)``."""
    found = fit.mapInArrow(_sums(dims), "dim int, high long, low long, n long").groupBy("dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")])
    rows = sorted(found.collect(), key=lambda r: r.dim)
    n, sums = int(rows[0].n), [(int(r.high) << 32) + int(r.low) for r in rows]
    mean = np.array([s / n for s in sums])
    # A matrix of partial sums takes dims^2 numbers, so a task should read many more.
    tasks = fit.coalesce(max(1, n // (32 * dims)))
    partial = tasks.mapInArrow(_products(mean), "dim int, row binary")
    total = partial.repartition("dim").sortWithinPartitions("dim").mapInArrow(_added, "dim int, row binary")
    matrix = np.stack([np.frombuffer(r.row) for r in sorted(total.collect(), key=lambda r: r.dim)]) / n
    return n, sums, (matrix + matrix.T) / 2


def _projected(mean: np.ndarray, turn: np.ndarray) -> Callable:
    """One column for each component."""

    def run(batches):
        for batch in batches:
            white = (_decoded(column_of(batch, "x"), len(mean)) - mean) @ turn
            yield pa.record_batch({f"c{k}": pa.array(np.ascontiguousarray(white[:, k])) for k in range(turn.shape[1])})

    return run


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of the squares of n x - S, without rounding; null beyond 38 digits."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if len(sums) * most * most < 1 << 62:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [d if d < 10**38 else None for d in found]


def _rows(mean: np.ndarray, turn: np.ndarray, n: int, sums: list[int]) -> Callable:
    count = turn.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _decoded(column_of(part, "x"), len(mean))
                each = pa.array(np.repeat(np.arange(len(x)), count))
                yield pa.record_batch(
                    {
                        "vec_id": column_of(part, "vec_id").take(each), "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                        "deviation": pa.array(_deviations(x, n, sums), pa.decimal128(38, 0)).take(each), "whitened": pa.array(((x - mean) @ turn).ravel()),
                    }
                )

    return run


def whiten(table: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector that takes part and each of the first ``components`` components.

    vec_id, component (from 1, by falling eigenvalue), n (distinct vectors), deviation (sum
    of (n x - S)^2 as a decimal, null beyond 38 digits), whitened, explained (share of the
    trace), identity_error (largest difference of the covariance of ``whitened`` over the
    distinct vectors from the identity).

    Null vectors, empty ones and those with null or non-finite entries take no part.
    Entries become floor(256 c), at most the ends of a long. If lengths differ, the length
    with the most distinct vectors counts (of equals the largest) and the others take no
    part. Components without variance (eigenvalue below the rounding error of the largest)
    are left out, so fewer come out of few dimensions, and none of a single distinct
    vector or an empty table. Repeated rows and null ids each get their rows. Other
    columns are not read.
    """
    schema = "vec_id long, component int, deviation decimal(38,0), whitened double"
    rows = whole_vectors(table, id_col, vector_col)
    every = cut(rows.select("dims", "x").distinct())
    lengths = every.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return _described(rows.sparkSession.createDataFrame([], schema), 0, np.zeros(0), 1.0, 0.0)
    dims, fit = lengths["dims"], every.filter(F.col("dims") == lengths["dims"]).select("x")
    n, sums, matrix = moments(fit, dims)
    values, vectors = eigenpairs(matrix)
    keep = np.flatnonzero(values > dims * np.finfo(np.float64).eps * max(values[0], 0))[:components]
    if not len(keep):
        return _described(rows.sparkSession.createDataFrame([], schema), n, np.zeros(0), 1.0, 0.0)
    values, turn = values[keep], vectors[:, keep] / np.sqrt(values[keep])
    mean = np.array([s / n for s in sums])
    names = [f"c{k}" for k in range(len(keep))]
    white = fit.mapInArrow(_projected(mean, turn), ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    found = white.agg(*[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs]).first()
    error = max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True))
    part = rows.filter(F.col("dims") == dims).select("vec_id", "x").mapInArrow(_rows(mean, turn, n, sums), schema)
    return _described(part, n, values, float(np.trace(matrix)), error)


def _described(part: DataFrame, n: int, values: np.ndarray, trace: float, error: float) -> DataFrame:
    shares = F.array(*[F.lit(float(v / trace)) for v in values]) if len(values) else F.array().cast("array<double>")
    return part.select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
