"""Neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import ann
from linkloom.llm.queries import QUERIES


def brute(rows, k):
    """Nearest k of all rows but the query's own, for queries divisible by 50."""
    ids = np.array([i for i, _ in rows])
    unit = np.array([v for _, v in rows], float)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    out = {}
    for q, v in zip(ids, unit, strict=True):
        if q % 50 == 0:
            cosine = (unit * v).sum(axis=1)
            order = [i for i in np.lexsort((ids, -np.round(cosine, 12))) if ids[i] != q][:k]
            out[q] = [(int(ids[i]), cosine[i]) for i in order]
    return out


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute(rows, 5)
    got = QUERIES["op1_ann"][0](spark, path).collect()
    vectors = dict(rows)
    mine: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append(r)
        a, b = np.array(vectors[r.query_id], float), np.array(vectors[r.vec_id], float)
        assert abs(r.score - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12
    assert {*mine} == {*want}
    assert all([r.rank for r in rows] == [1, 2, 3, 4, 5] and rows == sorted(rows, key=lambda r: (-r.score, r.vec_id)) for rows in mine.values())
    hits = sum(len({r.vec_id for r in mine[q]} & {i for i, _ in best}) for q, best in want.items())
    assert hits >= 0.9 * 5 * len(want)


def test_copies_of_one_vector(spark, monkeypatch):
    """A third of all rows are one vector, in lists cut into many blocks; ties go to the smaller id."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, -1.0] if i % 3 == 0 else rng.standard_normal(3).tolist()) for i in range(600)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6), F.col("vec_id") % 50 == 0)
    best = brute(rows, 5)
    hits = 0
    for r in got.collect():
        hits += (r.vec_id, r.rank) in {(i, k) for k, (i, _) in enumerate(best[r.query_id], 1)}
    assert hits >= 0.9 * 60
    assert {r.vec_id for r in got.filter("query_id = 150").collect()} == {0, 3, 6, 9, 12}


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (8, [2.0, 0.1]), (8, [2.0, 0.1]), (50, [1.0, 0.0]), (50, [1.0, 0.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, list string")
    got = {(r.query_id, r.rank): r.vec_id for r in ann.search(table, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 1): 50, (0, 2): 8, (50, 1): 0, (50, 2): 8}
    assert ann.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(table.filter("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_every_row_six_times(spark):
    """Repeated rows do not take the places of others; lists too small for k are not the end of a search."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    for copies, k in ((6, 5), (1, 40)):
        table = spark.createDataFrame(rows * copies, "vec_id long, embedding array<double>").repartition(4)
        got = ann.search(table, F.col("vec_id") % 50 == 0, k=k).collect()
        want = brute(rows, k)
        assert len(got) == k * len(want)
        assert sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got) >= 0.9 * len(got)


def test_few_rows_in_the_probed_list(spark, monkeypatch):
    """The nearest list holds two ids; the query goes on to others."""
    lists = ann.Lists(np.eye(2), np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]), 1)
    monkeypatch.setattr(ann, "fit_lists", lambda *_: lists)
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1])] + [(i, [0.1, float(i)]) for i in range(2, 6)] + [(i, [-1.0, 0.0]) for i in range(6, 9)]
    got = ann.search(spark.createDataFrame(rows * 2, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=5)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_tiny_and_huge_vectors(spark):
    """Finite vectors whose squares vanish or overflow take part with their true cosines, and empty no other result."""
    rng = np.random.default_rng(2)
    plain = {i: rng.standard_normal(8) for i in range(300)}
    sizes = {0: 1e-200, 7: 1e-310, 50: 1e200, 51: 1e-200, 100: 1e-310, 150: 1e300, 13: 1e200}
    rows = [(i, (v * sizes.get(i, 1.0)).tolist()) for i, v in plain.items()]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 50 == 0, k=5).collect()
    want = brute([(i, v.tolist()) for i, v in plain.items()], 5)
    assert len(got) == 5 * len(want) == 30
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    assert all(abs(r.score - cosine(plain[r.query_id], plain[r.vec_id])) < 1e-9 for r in got)
    assert sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got) >= 0.9 * len(got)
    few = ann.search(spark.createDataFrame(rows[:4] + rows[50:51], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=5)
    assert {r["count"] for r in few.groupBy("query_id").count().collect()} == {4}
