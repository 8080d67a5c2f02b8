"""Quality classifier: naive Bayes log-count ratios scale the features of a linear SVM.

A text is the set of its n-grams of 1 to 4 bytes, hashed to ``BUCKETS`` places, and
of the steps that the share of its word bigrams with twice the same word reaches.
Class counts of every place come from all labelled rows and give the log-count
ratio r. A row is its indicators times r, at length 1, and a linear hinge-loss
model is fitted to such rows by dual coordinate descent. The fit uses a sample of
at most ``SAMPLE_ROWS`` labelled rows, the first by a hash of their doc_id; one in
three of them turns margins into probabilities instead. What the driver holds is
bounded by these parameters, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import as_bytes, column_of, parts, pick
from linkloom.sources.lineage import cut

#: Places of the hashed n-grams.
BUCKETS = 1 << 16
#: Most labelled rows that the model is fitted to (two in three) and calibrated by (the others).
SAMPLE_ROWS = 4000
#: Labelled doc_ids that are broadcast to the texts; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Shares of repeated-word bigrams, one more place each.
REPEATS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5)
PLACES = BUCKETS + len(REPEATS)
_LONGEST = 4
#: Fixed odd multipliers, one for each n-gram length.
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
_CHUNK = 1 << 20


def features(text: bytes) -> np.ndarray:
    """Sorted places of the n-grams that a text has; none for an empty text."""
    marks = np.zeros(PLACES, bool)
    bigrams = twice = 0
    for at in range(0, len(text), _CHUNK):
        data = np.frombuffer(text[at : at + _CHUNK + _LONGEST - 1], np.uint8).astype(np.uint32)
        value = np.zeros(len(data), np.uint32)
        for n in range(min(_LONGEST, len(data))):
            value = (value[: len(data) - n] << np.uint32(8)) | data[n:]
            marks[(value + np.uint32(n)) * _MIX[n] >> np.uint32(16)] = True
        words = text[at : at + _CHUNK].split()
        bigrams += max(0, len(words) - 1)
        twice += sum(map(eq, words, words[1:]))
    marks[BUCKETS:] = [twice > 0 and twice >= share * bigrams for share in REPEATS]
    return np.flatnonzero(marks).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Log-count ratios, weights with the intercept last, and the slope and offset of the probability."""

    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, places: np.ndarray) -> float:
        scaled = self.ratio[places]
        length = float(np.sqrt(scaled @ scaled)) or 1.0
        return float(scaled @ self.weights[places]) / length + self.weights[-1]

    def score(self, places: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(places) + self.offset, -35, 35))))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of doc_id as text leaves no remainder by 5. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id, label (0 or 1): one row per labelled doc_id; repeated labels count by their mean, from 0.5 on as 1."""
    marks = pick(labels, doc_id=id_col, mark=label_col).dropna()
    return marks.groupBy("doc_id").agg(F.when(F.avg("mark") >= 0.5, 1).otherwise(0).alias("label"))


def _class_counts(batches):
    counts = np.zeros((2, PLACES), np.int64)
    for batch in parts(batches):
        for label, text in zip(column_of(batch, "label").to_pylist(), as_bytes(column_of(batch, "text")), strict=True):
            counts[label, features(text)] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    yield pa.record_batch({"place": pa.array(seen), "zeros": pa.array(counts[0, seen]), "ones": pa.array(counts[1, seen])})


def _feature_rows(batches):
    for batch in parts(batches):
        rows = [features(x).tobytes() for x in as_bytes(column_of(batch, "text"))]
        yield pa.record_batch({"doc_id": column_of(batch, "doc_id"), "label": column_of(batch, "label"), "places": pa.array(rows, pa.binary())})


def dual_coordinate_descent(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int = 0) -> np.ndarray:
    """Weights, intercept last, of the L2-regularized hinge loss, row costs balanced between the classes."""
    weights = np.zeros(len(ratio) + 1)
    ratio = ratio.astype(np.float32)
    scaled = [x / (np.sqrt(x @ x) or 1.0) for x in (ratio[places] for places in rows)]
    norms = np.array([x @ x + 1.0 for x in scaled])
    share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    most = cost * 0.5 / share
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            places, x = rows[k], scaled[k]
            gradient = signs[k] * (weights[places] @ x + weights[-1]) - 1.0
            new = min(max(alpha[k] - gradient / norms[k], 0.0), most[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * signs[k]
                weights[places] += step * x
                weights[-1] += step
                alpha[k] = new
    return weights


def calibrated(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton steps towards smoothed targets."""
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    points = np.stack([margins, np.ones(len(margins))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(points @ at, -35, 35)))
        hessian = (points * (p * (1 - p))[:, None]).T @ points + 1e-3 * np.eye(2)
        at = at - np.linalg.solve(hessian, points.T @ (p - target) + 1e-3 * (at - np.array([1.0, 0.0])))
    return float(at[0]), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cost: float = 1.0, epochs: int = 12, smoothing: float = 1.0) -> Model:
    """Model of ``labels.quality`` learned from labelled rows that are not held out.

    With no row of one class the model answers with the share of the class that there is.
    """
    marks = labelled(labels, id_col, label_col).filter(~held_out())
    texts = pick(docs, doc_id=id_col, text=text_col)
    marks = cut(marks)
    known = texts.join(F.broadcast(marks) if marks.count() <= MOST_BROADCAST else marks, "doc_id")
    table = known.select("label", "text").mapInArrow(_class_counts, "place long, zeros long, ones long")
    table = table.groupBy("place").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    zeros, ones = np.full(PLACES, smoothing), np.full(PLACES, smoothing)
    zeros[table["place"].to_numpy()] += table["zeros"].to_numpy()
    ones[table["place"].to_numpy()] += table["ones"].to_numpy()
    ratio = np.log(ones / ones.sum()) - np.log(zeros / zeros.sum())
    first = cut(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    sample = texts.join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    found = sample.mapInArrow(_feature_rows, "doc_id long, label int, places binary").toArrow().sort_by("doc_id")
    found = [(y, np.frombuffer(x, np.int32)) for y, x in zip(found["label"].to_pylist(), found["places"].to_pylist(), strict=True)]
    (fit_labels, fit_rows), (check_labels, check_rows) = ([np.array([y for y, _ in part]), [x for _, x in part]] for part in ([r for k, r in enumerate(found) if k % 3], found[::3]))
    if len({*fit_labels.tolist()}) < 2:
        share = float(np.mean(fit_labels)) if len(fit_labels) else 0.5
        return Model(ratio, np.zeros(PLACES + 1), 0.0, float(np.log((share + 0.01) / (1.01 - share))))
    weights = dual_coordinate_descent(fit_rows, np.where(fit_labels > 0, 1.0, -1.0), ratio, cost, epochs)
    if len({*check_labels.tolist()}) < 2:
        check_rows, check_labels = fit_rows, fit_labels
    plain = Model(ratio, weights, 1.0, 0.0)
    slope, offset = calibrated(np.array([plain.margin(x) for x in check_rows]), check_labels)
    return Model(ratio, weights, slope, offset)


def _scorer(model: Model) -> Callable:
    def run(batches):
        for batch in parts(batches):
            scores = [model.score(features(x)) for x in as_bytes(column_of(batch, "text"))]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            yield pa.record_batch(dict(kept) | {"score": pa.array(scores, pa.float64())})

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row; a null text is an empty one. Nothing but the text is looked at."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_scorer(model), "doc_id long, score double")


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, with all their columns, in one pass."""
    names = docs.columns
    rows = docs.toDF(*[f"_c{k}" for k in range(len(names))])
    place = names.index(text_col)

    def keep(batches):
        for batch in parts(batches):
            good = [model.score(features(x)) >= least for x in as_bytes(batch.column(place))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(keep, rows.schema).toDF(*names)
