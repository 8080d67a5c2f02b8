"""Whitened embeddings against plain integer and double arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from linkloom.llm import whitening
from linkloom.llm.queries import op11_whitening


@pytest.mark.parametrize(
    "values",
    [
        [3.0], [5.0, 5.0], list(range(1, 40)), [10, 10 - 1e-9, 10 - 2e-9, 5, 5, 5, 1, 1 - 1e-12, 0.5, 0, 0],
        [1 + 1e-8 * k for k in range(30)] + [3 + 1e-11 * k for k in range(8)], [1e6] + [1e-6 * k for k in range(1, 20)], [1e-200, 2e-200], [4e150, 1e150, 1e150],
    ],
)
def test_eigenpairs(values):
    rng = np.random.default_rng(len(values))
    turn = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    matrix = (turn * np.array(values)) @ turn.T
    found, vectors = whitening.eigenpairs((matrix + matrix.T) / 2)
    size = max(values)
    assert np.allclose(found / size, np.sort(values)[::-1] / size, atol=1e-14, rtol=0)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-14
    assert np.abs((matrix / size) @ vectors - vectors * (found / size)).max() < 1e-14


def test_single_precision_alone_is_not_enough():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    values = 1 + 1e-6 * np.arange(30)
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    rough = np.linalg.eigh(matrix.astype(np.float32))[1].astype(float)
    error = lambda x: np.abs(x.T @ matrix @ x - np.diag(np.diag(x.T @ matrix @ x))).max()
    assert error(rough) > 1e-9 and error(whitening.eigenpairs(matrix)[1]) < 1e-14


def plain(rows, count=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of a list of rows."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v and None not in v and all(np.isfinite(v))]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    matrix = centred.T @ centred / n
    e, q = np.linalg.eigh(matrix)
    e, q = e[::-1][:count], q[:, ::-1][:, :count]
    found = []
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        for k in range(len(e)):
            white = sum(float(Fraction(n * c - s, n)) * q[j, k] for j, (c, s) in enumerate(zip(x, sums, strict=True))) / np.sqrt(e[k])
            found.append((i, k + 1, n, deviation, white, e[k] / np.trace(matrix)))
    return found


def same(got, want):
    """Equal up to the sign of each component."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([abs(g[4]) for g in got], [abs(w[4]) for w in want], rtol=1e-9, atol=1e-11)
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)
    assert all(g[6] < 1e-10 for g in got)
    for k in {g[1] for g in got}:
        a, b = (np.array([r[4] for r in rows if r[1] == k]) for rows in (got, want))
        assert np.sign(a @ b) != 0 and np.allclose(a * np.sign(a @ b), b, rtol=1e-9, atol=1e-11)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = op11_whitening(spark, sf_dir)
    assert dict(got.dtypes)["deviation"] == "bigint"
    same(got.collect(), plain(rows))


def test_awkward_rows(spark):
    """Nulls, non-finite entries, repeated rows and vectors, null ids, vectors of another length, clashing columns, large entries."""
    rng = np.random.default_rng(3)
    good = [(k, rng.normal(size=6).tolist()) for k in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (103, [1.0, float("nan")] * 3), (104, [float("inf")] + [1.0] * 5), (105, [1.0, 2.0])]
    good += [(3, good[3][1]), (3, good[4][1]), (None, good[5][1]), (7, [0.0, -0.0, 1e-300, -1e-300, 30.0, -30.0])]
    table = spark.createDataFrame([(*r, 0, "x", 1.0, 2) for r in good + bad], "vec_id long, embedding array<double>, n int, x string, whitened double, dims int").repartition(3)
    same(whitening.whiten(table).collect(), plain(good))


def test_bounds(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).collect() == [] and make([(1, None)]).collect() == []
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).collect() == []
    line = make([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0])]).collect()
    assert sorted((r.vec_id, r.component, r.n, abs(round(r.whitened, 9)), round(r.explained, 9)) for r in line) == [(1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 5.0]), (3, [0.5, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation is None for r in huge} == {True, False} or all(r.deviation > 2**63 for r in huge)
    assert all(np.isfinite(r.whitened) for r in huge)


def test_many_distinct_partitions(spark):
    """More vectors than one task adds up, so partial matrices meet."""
    rng = np.random.default_rng(9)
    rows = [(k, (rng.normal(size=3) * [3, 2, 1]).tolist()) for k in range(900)]
    same(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), components=2).collect(), plain(rows, 2))
