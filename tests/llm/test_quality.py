"""The classifier on held-out rows and awkward ones."""

import zlib

import numpy as np
import pytest

from linkloom.llm import quality
from linkloom.llm.queries import QUERIES

from .conftest import ROWS


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality"][0](spark, folder).toPandas()
    marks = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id] == got.held_out.tolist()
    both = got[got.held_out].merge(marks, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95
    assert (both[both.quality == 1].predicted == 1).all()


def test_features_are_the_set_of_grams():
    assert len(quality.features(b"")) == 0
    assert quality.features(b"a").tolist() == quality.features(b"aaa"[:1]).tolist()
    assert {*quality.features(b"abc")} <= {*quality.features(b"abcabc")}
    long = bytes(np.random.default_rng(0).integers(97, 100, 3_000_000, dtype=np.uint8))
    assert {*quality.features(long)} >= {*quality.features(long[1 << 20 : (1 << 20) + 50])}


def test_descent_separates():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 20, 8)) for _ in range(200)]
    signs = np.array([1.0 if 3 in r else -1.0 for r in rows])
    weights = quality.dual_coordinate_descent(rows, signs, np.ones(30), 10.0, 60)
    margins = np.array([weights[r].sum() / np.sqrt(len(r)) + weights[-1] for r in rows])
    assert (np.sign(margins) == signs).mean() > 0.97


def test_awkward_rows(spark, messy, nothing, documents, labels):
    model = quality.fit(documents, labels)
    scores = quality.score(messy, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    kept = quality.drop_rejected(messy, model, least=0.0)
    assert kept.columns == messy.columns and kept.count() == len(ROWS)
    assert quality.drop_rejected(messy, model, least=1.1).count() == 0
    assert quality.score(nothing, model).count() == 0
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in quality.score(documents, model).collect()[:20]:
        assert abs(r.score - model.score(quality.features(texts[r.doc_id].encode()))) < 1e-12


def test_no_labels_and_one_class(spark, messy, labels):
    empty = quality.fit(messy, labels.limit(0))
    assert {round(r.score, 3) for r in quality.score(messy, empty).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, None) for i in (1, 2, 6, 10, 12)] + [(None, 0, None), (8, None, None)], "doc_id long, quality int, text string")
    assert all(r.score > 0.9 for r in quality.score(messy, quality.fit(messy, ones)).collect())


def test_repeated_labels_count_by_their_mean(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (2, 1)], "doc_id long, quality int")
    assert {(r.doc_id, r.label) for r in quality.labelled(rows).collect()} == {(1, 1), (2, 0)}
