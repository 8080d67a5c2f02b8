"""Jaccard join of word shingle sets with a forest of signature trees.

Every distinct set has a bitmap of its shingles. A tree has sets at its leaves; a node
holds the OR of the bitmaps below it, the range of their sizes and the largest number
of shingles that share a bit with others. Two nodes can have an overlap of at most the
bits common to their bitmaps and those shared shingles, so the dual traversal, from the
root paired with itself, drops every pair of nodes that cannot reach the overlap that
their sizes ask for.

Roots divide the work. Sets that link share one of their smallest shingle hashes, n - ceil(t n) + 1
of them, so a root gathers the sets that hold a shingle there; where neighbouring sizes are too
far apart, it is split, and roots of the same sets are one. A root with more than ``CELL``
sets is divided into cells, pairs of parts of neighbouring sizes, each a root of its own.

The first traversal reads bitmaps alone. The sets that are still connected travel, each
once, to their cluster, where a second traversal compares what it reaches exactly.
Within a tree, sets that are connected already are not compared again, so links
returned span what all links connect.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.components import components
from linkloom.llm.shared import as_bytes, attach, column_of, parts, pick
from linkloom.sources.lineage import cut

#: Sets of a root that one task compares; beyond it the root is cut into cells.
CELL = 4096
#: Shingles of a cluster's part, so that a cell fits in memory with its sets.
PART_SHINGLES = 1 << 20
FAN = 8
_CHUNK = 1 << 20
_SPACE = frozenset(b" \t\n\r\x0b\x0c")
_FACTOR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


# sets


class _Hashes(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int, hashes: dict | None = None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``size`` words, A-Z in lower case.

    A text with fewer words counts as one shingle; one without words has none.
    """
    hashes = _Hashes() if hashes is None else hashes
    found, tail, at = [], np.zeros(0, np.uint64), 0
    factors = [np.uint64(pow(_FACTOR, k + 1, 1 << 64)) for k in range(size)]
    text = text.lower()
    while at < len(text):
        end = at + _CHUNK
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        words = np.array([hashes[w] for w in text[at:end].split()], np.uint64)
        words = np.concatenate([tail, words]) if len(tail) else words
        n = len(words) - size + 1
        if n > 0:
            found.append(sum(words[k : k + n] * f for k, f in enumerate(factors)))
        tail, at = words[max(0, n) :], end
    if not found and len(tail):
        found = [(tail * np.array(factors[: len(tail)], np.uint64)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(tail))]
    return np.unique(_mixed(np.concatenate(found))) if found else np.zeros(0, np.uint64)


def width(n: int) -> int:
    """Bits of the bitmap of n shingles, a power of two that never shrinks as n grows."""
    return max(64, min(4096, 1 << (4 * n - 1).bit_length()), 1 << (n - 1).bit_length()) if n else 64


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit for each shingle's hash modulo the width."""
    bits = np.zeros(width(len(shingles)), np.uint8)
    bits[shingles & np.uint64(len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def prefix_size(n: int, percent: int) -> int:
    """How many of the smallest shingles of n suffice to meet every set that links."""
    return n - -(-percent * n // 100) + 1


def _read(size: int, percent: int) -> Callable:
    def run(batches):
        hashes = _Hashes()
        for batch in parts(batches):
            n, digest, prefix, maps = [], [], [], []
            for text in as_bytes(column_of(batch, "text")):
                found = shingle_set(text, size, hashes)
                n.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                prefix.append(found[: prefix_size(len(found), percent)].tobytes() if len(found) else b"")
                maps.append(bitmap(found).tobytes())
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                {
                    "doc_id": column_of(batch, "doc_id"), "text_key": column_of(batch, "text_key"), "n": pa.array(n, pa.int64()), "class": pa.array(halves[:, 0].copy()),
                    "check": pa.array(halves[:, 1].copy()), "prefix": pa.array(prefix, pa.binary()), "bitmap": pa.array(maps, pa.binary()),
                }
            )

    return run


def _set_rows(size: int) -> Callable:
    def run(batches):
        hashes = _Hashes()
        for batch in parts(batches):
            found = [shingle_set(text, size, hashes).tobytes() for text in as_bytes(column_of(batch, "text"))]
            yield pa.record_batch({"class": column_of(batch, "class"), "shingles": pa.array(found, pa.binary())})

    return run


# trees


def can_link(a: np.ndarray, b: np.ndarray, overlap: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and this overlap are similar enough."""
    return 100 * overlap >= percent * (a + b - overlap)


class Tree:
    """A signature tree over sets with bitmaps of one width."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, percent: int):
        self.percent = percent
        self.order = np.lexsort((maps[:, 0], sizes))
        sizes, maps = sizes[self.order], maps[self.order]
        #: For each level, leaves first: bitmaps, smallest and largest size, most shingles without a bit of their own.
        self.levels = [(maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > FAN:
            maps, low, high, spare = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether anything below the nodes can be similar enough."""
        maps, low, high, spare = self.levels[level]
        overlap = np.empty(len(a), np.int64)
        step = max(1, (1 << 20) // maps.shape[1])
        for at in range(0, len(a), step):
            overlap[at : at + step] = np.bitwise_count(maps[a[at : at + step]] & maps[b[at : at + step]]).sum(axis=1, dtype=np.int64)
        overlap = np.minimum(overlap + np.minimum(spare[a], spare[b]), np.minimum(high[a], high[b]))
        # The union is at least the larger of the smallest sizes, and what both have beyond the overlap.
        return can_link(np.maximum(low[a], overlap), np.maximum(low[b], overlap), overlap, self.percent)

    def pairs(self, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets that the traversal reaches and whose labels differ, a few nodes at a time.

        ``label`` has one entry for each set; the caller may change it between pairs.
        """
        top = len(self.levels) - 1
        first, second = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, first, second)]
        while stack:
            level, a, b = stack.pop()
            if level:
                apart = self._apart(level, label)
                keep = apart[0][a] | apart[0][b] | (apart[1][a] != apart[1][b])
            else:
                mine = label[self.order]
                keep = (a != b) & (mine[a] != mine[b])
            a, b = a[keep], b[keep]
            keep = self._possible(level, a, b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                yield self.order[a], self.order[b]
                continue
            count = len(self.levels[level - 1][0])
            for at in reversed(range(0, len(a), 1024)):
                x, y = a[at : at + 1024, None, None] * FAN + np.arange(FAN)[:, None], b[at : at + 1024, None, None] * FAN + np.arange(FAN)
                x, y = (z.ravel() for z in np.broadcast_arrays(x, y))
                there = (x <= y) & (y < count)
                stack.append((level - 1, x[there], y[there]))

    def _apart(self, level: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node, whether its sets have different labels, and the smallest."""
        at = np.arange(0, len(label), FAN**level)
        mine = label[self.order]
        low = np.minimum.reduceat(mine, at)
        return np.maximum.reduceat(mine, at) != low, low


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give sets connected by the pairs one label, their smallest."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label != label[label]).any():
            label[:] = label[label]


def _forest(sizes: np.ndarray, maps: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, Tree]]:
    """Members and tree of each width of bitmaps; wider ones of near sizes join, folded."""
    widths = np.array([len(m) for m in maps])
    for words in np.unique(widths):
        most = sizes[widths == words].max()
        which = np.flatnonzero((widths == words) | (widths == 2 * words) & (percent * sizes <= 100 * most))
        if len(which) > 1:
            yield which, Tree(sizes[which], np.stack([maps[k] if len(maps[k]) == words else maps[k][:words] | maps[k][words:] for k in which]), percent)


def candidate_labels(sizes: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest index of those that bitmaps connect it with."""
    label = np.arange(len(sizes))
    for which, tree in _forest(sizes, maps, percent):
        inner = _inner_labels(label, which)
        for a, b in tree.pairs(inner):
            _joined(inner, a, b)
        _joined(label, which, which[inner])
    return label


def _inner_labels(label: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Labels of some of the sets, as indices among these."""
    _, first, back = np.unique(label[which], return_index=True, return_inverse=True)
    return first[back]


def spanning_links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links, as an index and others, that connect whatever all links connect."""
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    for which, tree in _forest(sizes, [bitmap(s) for s in sets], percent):
        inner = _inner_labels(label, which)
        for a, b in tree.pairs(inner):
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            for s, e in zip(starts, [*starts[1:], len(a)], strict=True):
                one, others = a[s], b[s:e]
                others = others[inner[others] != inner[one]]
                if len(others):
                    hits = others[_similar(sets, which[one], which[others], percent)]
                    if len(hits):
                        _joined(inner, np.full(len(hits), one), hits)
                        yield int(which[one]), which[hits]
        _joined(label, which, which[inner])


def _similar(sets: list[np.ndarray], one: int, others: np.ndarray, percent: int) -> np.ndarray:
    mine = sets[one]
    every = np.concatenate([sets[k] for k in others])
    sizes = np.array([len(sets[k]) for k in others])
    at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
    overlap = np.add.reduceat((mine[at] == every).astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
    return can_link(np.int64(len(mine)), sizes, overlap, percent)


# roots


def _roots(percent: int, cell: int) -> Callable:
    """Roots of the shingles of a partition, sorted by shingle and size; members of large roots go out by shingle."""

    def out(root, token, classes, sizes):
        return pa.record_batch({"root": root, "token": token, "class": pa.array(classes), "n": pa.array(sizes)})

    def run(batches):
        held, hot = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = [np.asarray(column_of(batch, c)) for c in ("token", "class", "n")]
            if held is not None:
                here = [np.concatenate(x) for x in zip(held, here, strict=True)]
            token, classes, sizes = here
            starts = _starts(token, sizes)
            if len(token) - starts[-1] > cell:
                # The last run is large already, so it goes out as it comes.
                first = starts[-1]
                yield out(pa.nulls(len(token) - first, pa.int64()), pa.array(token[first:]), classes[first:], sizes[first:])
                yield from done(token[:first], classes[:first], sizes[:first], hot)
                hot = (token[-1], sizes[-1])
                held = None
            else:
                first = starts[-1]
                yield from done(token[:first], classes[:first], sizes[:first], hot)
                if first:
                    hot = None
                held = [x[first:] for x in here]
        if held is not None:
            yield from done(*held, hot)

    def done(token, classes, sizes, hot):
        if not len(token):
            return
        starts = _starts(token, sizes)
        lengths = np.diff(np.r_[starts, len(token)])
        large = lengths > cell
        if hot is not None and token[0] == hot[0] and 100 * hot[1] >= percent * sizes[0]:
            large[0] = True
        large, several = np.repeat(large, lengths), np.repeat(lengths > 1, lengths)
        if large.any():
            yield out(pa.nulls(int(large.sum()), pa.int64()), pa.array(token[large]), classes[large], sizes[large])
        # A root is named after its members, so that those of the same sets are one.
        names = np.add.reduceat(_mixed(classes.view(np.uint64)), starts)
        names = _mixed(names + lengths.astype(np.uint64)).view(np.int64)
        keep = several & ~large
        if keep.any():
            yield out(pa.array(np.repeat(names, lengths)[keep]), pa.nulls(int(keep.sum()), pa.int64()), classes[keep], sizes[keep])

    def _starts(token, sizes):
        return np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])])

    return run


def _postings(percent: int) -> Callable:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = column_of(part, "prefix").to_pylist()
                many = np.array([len(x) // 8 for x in found])
                yield pa.record_batch(
                    {
                        "token": pa.array(np.frombuffer(b"".join(found), np.int64)), "class": pa.array(np.repeat(np.asarray(column_of(part, "class")), many)),
                        "n": pa.array(np.repeat(np.asarray(column_of(part, "n")), many)),
                    }
                )

    return run


def _cells(hot: DataFrame, percent: int, cell: int) -> DataFrame:
    """root, class: members of large roots in cells of two parts of the same or the next band of sizes."""
    # Sizes of sets that link differ by at most one band; the bands are a little wider than they need to be.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * 1.001 + 1e-9)).cast("long")
    rows = hot.select("token", "class", band.alias("band"))
    dealt = rows.groupBy("token", "band").agg(F.ceil(F.count("*") * 2 / F.lit(cell)).cast("long").alias("parts"))
    near = dealt.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("other"), F.col("parts").alias("others"))
    mine = rows.join(dealt, ["token", "band"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))
    met = mine.join(near, ["token", "band"]).withColumn("other_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    ends = F.struct(F.col("band").alias("b"), F.col("part").alias("p")), F.struct(F.col("other").alias("b"), F.col("other_part").alias("p"))
    return met.select(F.xxhash64("token", F.least(*ends), F.greatest(*ends)).alias("root"), "class")


def _by_key(batches, keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Stretches of rows with the same keys; rows are sorted by them."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(column_of(batch, c)).astype(np.int64) for c in keys], axis=1)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
            if now is not None and tuple(key[s]) != now:
                yield held
                held = []
            now = tuple(key[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield held


def _link_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([x[k] for x in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
    return pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def _candidates(percent: int) -> Callable:
    def run(batches):
        out = []
        for rows in _by_key(batches, ["root"]):
            classes = np.concatenate([np.asarray(column_of(r, "class")) for r in rows])
            sizes = np.concatenate([np.asarray(column_of(r, "n")) for r in rows])
            maps = [np.frombuffer(m, "<u8") for r in rows for m in column_of(r, "bitmap").to_pylist()]
            label = candidate_labels(sizes, maps, percent)
            moved = label != np.arange(len(label))
            if moved.any():
                out.append((classes[moved], classes[label[moved]]))
            if len(out) > 1000:
                yield _link_batch(out)
                out = []
        yield _link_batch(out)

    return run


def _verified(percent: int) -> Callable:
    def run(batches):
        out = []
        for rows in _by_key(batches, ["cluster", "i", "j"]):
            classes = np.concatenate([np.asarray(column_of(r, "class")) for r in rows])
            sets = [np.frombuffer(x, np.uint64) for r in rows for x in column_of(r, "shingles").to_pylist()]
            for one, others in spanning_links(sets, percent):
                out.append((np.full(len(others), classes[one]), classes[others]))
            if len(out) > 1000:
                yield _link_batch(out)
                out = []
        yield _link_batch(out)

    return run


def class_links(classes: DataFrame, texts: DataFrame, size: int, percent: int, cell: int = CELL) -> DataFrame:
    """Links a, b between classes that connect whatever all links connect.

    ``classes`` has class, n, prefix, bitmap and text_key, ``texts`` text_key and text, rows of
    the same text included.
    """
    listed = classes.filter("n > 0").select("class", "n", "prefix").mapInArrow(_postings(percent), "token long, class long, n long")
    order = ["token", "n", "class"]
    rooted = cut(listed.repartition("token").sortWithinPartitions(*order).mapInArrow(_roots(percent, cell), "root long, token long, class long, n long"))
    members = rooted.filter("root is not null").select("root", "class").unionByName(_cells(rooted.filter("root is null"), percent, cell)).distinct()
    members = members.join(classes.select("class", "n", "bitmap"), "class")
    near = cut(members.repartition("root").sortWithinPartitions("root").mapInArrow(_candidates(percent), "a long, b long").distinct())
    clusters = components(near).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    clusters = cut(clusters.join(classes.select("class", "n", "text_key"), "class"))
    # One text of each class that is left; sets are made again, as stored ones would take more than the texts.
    wanted = texts.join(clusters.select("text_key", "class"), "text_key").dropDuplicates(["class"])
    sets = wanted.select("class", "text").mapInArrow(_set_rows(size), "class long, shingles binary")
    dealt = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") * 2 / F.lit(cell)), F.ceil(F.sum("n") / F.lit(PART_SHINGLES))).cast("long").alias("parts"))
    mine = clusters.join(dealt, "cluster").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = mine.select("class", "cluster", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    keys = ["cluster", "i", "j"]
    return cells.join(sets, "class").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verified(percent), "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of
    shingles of ``size`` words. A word is a run of bytes without ASCII white space, A-Z
    in lower case; a text with fewer words is one shingle, and null and empty texts
    have none and link with nothing. component_id is the smallest doc_id that links
    reach, the row's own included; null ids count for none, so a row without id has
    that of its group, or null. Repeated rows each get a row. An empty table gives an
    empty result. Other columns are not read. Shingles are told apart by 64-bit hashes.
    """
    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("text_key"))
    kinds = "doc_id long, text_key binary, n long, class long, check long, prefix binary, bitmap binary"
    rows = cut(texts.mapInArrow(_read(size, percent), kinds))
    found = cut(rows.groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), (F.min("check") == F.max("check")).alias("equal")))
    if not found.filter("not equal").isEmpty():
        raise RuntimeError("two sets share 64 bits of their digests")
    classes = cut(rows.filter("n > 0").select("class", "n", "prefix", "bitmap", "text_key").dropDuplicates(["class"]))
    nodes = components(class_links(classes, texts.select("text_key", "text"), size, percent, cell)).withColumnRenamed("node", "class")
    rooted = found.join(nodes, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = cut(rooted.join(least, "root").select("class", "copies", "component_id"))
    narrow = rows.select("doc_id", F.col("n").alias("n_shingles"), "class")
    joined = attach(narrow, table, ["class"], "copies", rows.count())
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", alone.alias("component_id"))
