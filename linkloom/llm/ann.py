"""Nearest neighbours by cosine: inverted lists scanned with an adaptive number of dimensions.

Unit vectors are rotated at random, so that the first dimensions of a difference
estimate its length. A list is scanned in column blocks of ``WIDTH`` dimensions.
After each, a candidate is given up when the hypothesis that its whole distance is
below the k-th best so far is rejected from the partial one; what is left after the
last block gets its exact cosine on the original vectors.

The centroids and the number of lists to probe are fitted to a sample of at most
``FIT_ROWS`` vectors, the first by a hash of their id. Every vector is indexed.
A list is cut into blocks by its size and by the number of queries that probe it,
so a popular list, or many copies of one vector, is the work of many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.shared import column_of
from linkloom.sources.lineage import cut

#: Most vectors that centroids and probes are fitted to, and most lists.
FIT_ROWS, MOST_LISTS = 16_384, 1024
#: Dimensions of a column block, and the factor of the test: larger gives up later.
WIDTH, EPSILON = 8, 2.1
#: Most vectors of a block of a list, and most vector-query pairs that meet in one, give or take a query.
BLOCK_ROWS, BLOCK_PAIRS = 8192, 20_000_000
#: Share of near pairs of the sample whose list is probed.
REACH = 0.97


@dataclass(frozen=True)
class Lists:
    """Rotation, unit centroids, and the number of nearest lists that a query probes."""

    rotation: np.ndarray
    centroids: np.ndarray
    probes: int


def takes_part(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vec (doubles) of the rows that take part: valid, with an id, and of the commonest dimension."""
    rows = frame.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & takes_part(F.col("vec")))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("vec") == (common.d if common else 0))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish; directions stay as they are."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1]) if rows.size else rows


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_lists(rows: DataFrame, k: int, reach: float = REACH, rounds: int = 8, seed: int = 0) -> Lists | None:
    """Spherical k-means on the sample, about sqrt(n) / 2 lists for n ids, each with one vector; None without vectors."""
    rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(FIT_ROWS).collect()
    if not sample:
        return None
    rng = np.random.default_rng(seed)
    points = _unit(np.array([r.vec for r in sample]))
    d = points.shape[1]
    centroids = np.unique(points[: max(1, min(MOST_LISTS, len(points), round(n**0.5 / 2)))], axis=0)
    for _ in range(rounds):
        nearest = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    asked = points[:256]
    near = asked @ points.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2.0
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(points) - 1)]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    home = (points @ centroids.T).argmax(axis=1)
    ranks = np.sort(np.take_along_axis(place, home[best], axis=1).ravel())
    probes = int(ranks[max(0, int(np.ceil(reach * len(ranks))) - 1)]) + 1 if len(ranks) else len(centroids)
    return Lists(rotation, centroids, probes)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def _assign(lists: Lists, sizes: np.ndarray | None = None, k: int = 0) -> Callable:
    """Rows with the nearest list, or with ``sizes`` one row for each of the lists that a query probes.

    A query probes further lists until those probed hold k ids besides its own;
    ``sizes`` has the ids of each list.
    """
    d = lists.centroids.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vec = column_of(part, "vec")
                rows = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                nearest = np.argsort(-(_unit(rows) @ lists.centroids.T), axis=1, kind="stable")
                if sizes is None:
                    taken = np.arange(nearest.shape[1]) < 1
                else:
                    before = np.cumsum(sizes[nearest], axis=1) - sizes[nearest]
                    taken = (np.arange(nearest.shape[1]) < lists.probes) | (before < k + 1)
                row, place = np.nonzero(np.broadcast_to(taken, nearest.shape))
                nearest = nearest[row, place]
                data = [x.tobytes() for x in rows]
                yield pa.record_batch(
                    {"list": pa.array(nearest.ravel().astype(np.int32)), "vec_id": column_of(part, "vec_id").take(pa.array(row)), "data": pa.array([data[i] for i in row], pa.binary())}
                )

    return run


class Block:
    """The vectors of one block of a list, rotated, in column blocks."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, rotation: np.ndarray):
        keys = np.concatenate([ids.astype(np.int64)[:, None], np.ascontiguousarray(rows).view(np.int64)], axis=1)
        alone = np.sort(np.unique(np.ascontiguousarray(keys).view(f"V{keys.shape[1] * 8}").ravel(), return_index=True)[1])
        self.ids, self.rows = ids, rows = ids[alone], _scaled(rows[alone])  # repeated rows once
        self.repeats = len(np.unique(ids)) < len(ids)
        self.length = np.sqrt((rows * rows).sum(axis=1))
        turned = (rows / self.length[:, None]) @ rotation
        self.columns = [np.ascontiguousarray(turned[:, at : at + WIDTH]) for at in range(0, turned.shape[1], WIDTH)]

    def nearest(self, query_id: int, query: np.ndarray, turned: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest that the scan finds, the query's own id left out."""
        d = len(turned)
        left = np.flatnonzero(self.ids != query_id)
        if not len(left):
            return self.ids[:0], self.length[:0]
        diff = self.columns[0][left] - turned[:WIDTH]
        partial = np.einsum("ij,ij->i", diff, diff)
        if self.repeats:
            # the limit is that of k ids, each by one of its vectors
            order = np.argsort(partial, kind="stable")
            first = left[order[np.sort(np.unique(self.ids[left[order]], return_index=True)[1])[:k]]]
        else:
            first = left if len(left) <= k else left[np.argpartition(partial, k - 1)[:k]]
        limit = sum(np.einsum("ij,ij->i", x, x) for x in (c[first] - turned[n * WIDTH : (n + 1) * WIDTH] for n, c in enumerate(self.columns))).max()
        limit += 1e-9
        for n, column in enumerate(self.columns):
            seen = min(d, (n + 1) * WIDTH)
            if n:
                diff = column[left] - turned[n * WIDTH : seen]
                partial += np.einsum("ij,ij->i", diff, diff)
            slack = (1 + EPSILON / np.sqrt(seen)) ** 2 if seen < d else 1.0
            open_ = partial * (d / seen) <= limit * slack
            left, partial = left[open_], partial[open_]
        cosine = (self.rows[left] * query).sum(axis=1) / (self.length[left] * np.sqrt((query * query).sum()))
        order = np.lexsort((self.ids[left], -cosine))
        ids, where = np.unique(self.ids[left][order], return_index=True)
        best = order[np.sort(where)][:k]
        return self.ids[left][best], cosine[best]


def _scan(lists: Lists, k: int) -> Callable:
    """Rows come sorted by list, block and kind: the vectors of a block, then the queries that probe it."""
    d = lists.rotation.shape[0]

    def found(block: Block, ids: list[int], rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = _scaled(rows)
        turned = _unit(rows) @ lists.rotation
        for at in range(0, len(ids), 512):
            hits = [(q, *block.nearest(q, rows[i], turned[i], k)) for i, q in enumerate(ids[at : at + 512], at)]
            yield pa.record_batch(
                {
                    "query_id": pa.array(np.repeat([q for q, _, _ in hits], [len(x) for _, x, _ in hits]).astype(np.int64)),
                    "vec_id": pa.array(np.concatenate([x for _, x, _ in hits]).astype(np.int64)),
                    "score": pa.array(np.concatenate([x for _, _, x in hits]).astype(np.float64)),
                }
            )

    def run(batches):
        here, block, ids, rows = None, None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(column_of(batch, c)) for c in ("list", "block", "kind")], axis=1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            for start, end in zip(starts, [*starts[1:], len(key)], strict=True):
                part = batch.slice(start, end - start)
                cell, kind = tuple(key[start, :2]), key[start, 2]
                if cell != here:
                    here, block, ids, rows = cell, None, [], []
                data, names = _matrix(column_of(part, "data"), d), column_of(part, "vec_id").to_pylist()
                if kind == 0:
                    ids += names
                    rows.append(data)
                elif rows:
                    block = block or Block(np.array(ids), np.concatenate(rows), lists.rotation)
                    yield from found(block, names, data)

    return run


def search(frame: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that ``queries`` selects by ``vec_id``.

    Candidates are all rows but those with the query's own id. Nearest first by
    cosine, ties to the smaller vec_id. Rows whose vector is null, zero, holds a
    null or a non-finite component, or is of another dimension than most take no
    part, nor do rows without id. A repeated vec_id counts once, with its best
    score. With no valid vector the result is empty. Other columns are not read.
    """
    spark, schema = frame.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = vectors(frame, id_col, vector_col)
    lists = fit_lists(rows, k)
    if lists is None:
        return spark.createDataFrame([], schema)
    kinds = "list int, vec_id long, data binary"
    index = cut(rows.mapInArrow(_assign(lists), kinds))
    sizes = np.zeros(len(lists.centroids), np.int64)
    # an id in several lists counts in one of them
    for r in index.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    asked = cut(rows.filter(queries).mapInArrow(_assign(lists, sizes, k), kinds))
    loads = index.groupBy("list").agg(F.count("*").alias("n")).join(asked.groupBy("list").agg(F.count("*").alias("q")), "list")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("n") * F.col("q") / BLOCK_PAIRS)).cast("int")
    loads = F.broadcast(loads.select("list", blocks.alias("blocks")))  # at most MOST_LISTS rows
    held = index.join(loads, "list").select("list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "data")
    sent = asked.join(loads, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", "data")
    dealt = held.unionByName(sent).repartition("list", "block").sortWithinPartitions("list", "block", "kind")
    hits = dealt.mapInArrow(_scan(lists, k), "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
