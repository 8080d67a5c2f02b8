"""Near duplicates by SimHash fingerprints that meet at the anchors of a covering code.

Fingerprints that differ in at most k of 64 bits differ in at most one bit within
one of k // 2 + 1 blocks. Each block has a covering code of radius 1: a Hamming
code on its first 2^r - 1 bits, all values on the rest. A fingerprint is at home
at its nearest anchor (distance 0 or 1) and is also sent to every anchor within
1 + 1 bits, so two fingerprints that are close in a block always meet at the home
of either. Only distinct fingerprints travel, about 17 rows for each block.

At an anchor, fingerprints are compared with those at home there, and links that
span the group are returned instead of all pairs. An anchor with more members than
``CELL`` is compared in cells, pairs of hashed parts, each a bounded piece of work
of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.components import components
from linkloom.llm.shared import as_bytes, attach, column_of, parts, pick
from linkloom.sources.lineage import cut

#: Members of an anchor that one task compares at once; beyond it the anchor is cut into cells.
CELL = 4096
#: Bytes of text whose words are held at once.
_CHUNK = 1 << 20
_SPACE = b" \t\n\r\x0b\x0c"
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# fingerprints


def _words(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text in lists of bounded size."""
    at = 0
    while at < len(data):
        end = at + _CHUNK
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def _shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    ends = list(accumulate(map(len, words), lambda end, n: end + 1 + n))
    starts = [end - len(word) for end, word in zip(ends, words, strict=True)]
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    return np.array([h(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :], strict=False)], np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, from a histogram of their bytes."""
    pairs = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        return np.unpackbits(pairs, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(pairs[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])


def fingerprint(text: bytes, size: int) -> int:
    """64-bit majority fingerprint of a text's word shingles, as an unsigned number."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for words in _words(text.lower()):
        words = tail + words
        if len(words) >= size:
            hashes = _shingle_hashes(words, size)
            counts += _bit_counts(hashes)
            n += len(hashes)
        tail = words[len(words) - size + 1 :] if len(words) >= size else words
        if size == 1:
            tail = []
    if n == 0 and tail:
        counts, n = _bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(tail), 42)], np.uint64)), 1
    bits = np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(size: int) -> Callable:
    def run(batches):
        for batch in parts(batches):
            found = np.array([fingerprint(x, size) for x in as_bytes(column_of(batch, "text"))], np.uint64)
            kept = {c: column_of(batch, c) for c in batch.schema.names if c != "text"}
            yield pa.record_batch(kept | {"fp": pa.array(found.view(np.int64))})

    return run


# anchors


def blocks(max_bits: int) -> list[tuple[int, int, int]]:
    """First bit, width and number of Hamming parity bits of each block."""
    n = max_bits // 2 + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a, (b - a + 1).bit_length() - 1) for a, b in zip(edges, edges[1:], strict=False)]


def anchors(prints: np.ndarray, first: int, width: int, parity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and whether the row is at home there, for every anchor within two bits."""
    value = (prints >> np.uint64(first)) & np.uint64((1 << width) - 1)
    length = (1 << parity) - 1
    syndrome = np.zeros(len(value), np.int64)
    for k in range(parity):
        mask = sum(1 << (i - 1) for i in range(1, length + 1) if i >> k & 1)
        syndrome |= (np.bitwise_count(value & np.uint64(mask)) & 1).astype(np.int64) << k
    flip = np.array([0] + [1 << (i - 1) for i in range(1, length + 1)], np.uint64)
    nearest = value ^ flip[syndrome]
    free = [1 << k for k in range(length, width)]
    rows, found = [], []

    def add(which: np.ndarray, codes: np.ndarray) -> None:
        rows.append(which)
        found.append(codes)

    every = np.arange(len(value))
    add(every, nearest)
    for bit in free:
        add(every, nearest ^ np.uint64(bit))
    on_code = every[syndrome == 0]
    for i, a in enumerate(free):
        for b in free[i + 1 :]:
            add(on_code, value[on_code] ^ np.uint64(a | b))
    for s in range(1, length + 1):
        off = every[syndrome == s]
        for i in range(1, length + 1):
            if i < i ^ s:
                add(off, value[off] ^ flip[i] ^ flip[i ^ s])
    row = np.concatenate(rows)
    return row, np.concatenate(found), np.arange(len(row)) < len(value)


def _replicas(max_bits: int) -> Callable:
    layout = blocks(max_bits)

    def run(batches):
        for batch in batches:
            prints = np.asarray(column_of(batch, "fp")).view(np.uint64)
            for at in range(0, len(prints), 4096):
                part = prints[at : at + 4096]
                for k, block in enumerate(layout):
                    row, anchor, home = anchors(part, *block)
                    yield pa.record_batch(
                        {"block": pa.array(np.full(len(row), k, np.int32)), "anchor": pa.array(anchor.view(np.int64)), "home": pa.array(home), "fp": pa.array(part[row].view(np.int64))}
                    )

    return run


# comparison


def spanning_links(prints: np.ndarray, home: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever the close pairs with one side at home connect."""
    open_home, open_away = np.flatnonzero(home), np.flatnonzero(~home)
    while len(open_home):
        queue, open_home = [open_home[0]], open_home[1:]
        while queue:
            at = queue.pop()
            near = np.bitwise_count(prints[open_home] ^ prints[at]) <= max_bits
            hits, open_home = open_home[near], open_home[~near]
            if home[at]:
                near = np.bitwise_count(prints[open_away] ^ prints[at]) <= max_bits
                hits, open_away = np.concatenate([hits, open_away[near]]), open_away[~near]
            if len(hits):
                yield np.full(len(hits), prints[at]), prints[hits]
                queue += hits.tolist()


def _short_runs(prints: np.ndarray, home: np.ndarray, run: np.ndarray, longest: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs within runs of few members, all runs at once."""
    for lag in range(1, longest):
        a, b = prints[:-lag], prints[lag:]
        hit = (run[:-lag] == run[lag:]) & (home[:-lag] | home[lag:]) & (np.bitwise_count(a ^ b) <= max_bits)
        yield a[hit], b[hit]


_FEW = 16


def _meet(max_bits: int, cell: int) -> Callable:
    """Links at the anchors of one partition, sorted by anchor; members of hot anchors go out unchanged."""

    def links(pairs):
        a = np.concatenate([x for x, _ in pairs] or [np.zeros(0, np.uint64)])
        b = np.concatenate([x for _, x in pairs] or [np.zeros(0, np.uint64)])
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        nothing = pa.nulls(len(pair), pa.int64())
        return out(nothing, nothing, pa.nulls(len(pair), pa.bool_()), pair[:, 0], pair[:, 1])

    def out(block, anchor, home, a, b):
        ints = lambda x: x if isinstance(x, pa.Array) else pa.array(x.view(np.int64))
        return pa.record_batch({"block": block, "anchor": anchor, "home": home, "a": ints(a), "b": ints(b)})

    def run(batches):
        held: list[list[np.ndarray]] = []
        hot = None

        def overflow(part):
            return out(pa.array(part[0]), pa.array(part[1]), pa.array(part[2]), part[3], pa.nulls(len(part[3]), pa.int64()))

        def closed(part):
            """All runs of the columns, none of which goes on."""
            block, anchor, home, prints = part
            starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (anchor[1:] != anchor[:-1])])
            sizes = np.diff(np.r_[starts, len(prints)])
            pairs = []
            few = np.repeat((sizes > 1) & (sizes <= _FEW), sizes)
            label = np.repeat(np.arange(len(sizes)), sizes)
            pairs += _short_runs(prints[few], home[few], label[few], min(_FEW, int(sizes.max(initial=0))), max_bits)
            for k in np.flatnonzero(sizes > _FEW):
                at = slice(starts[k], starts[k] + sizes[k])
                if sizes[k] > cell:
                    yield overflow([c[at] for c in part])
                else:
                    pairs += spanning_links(prints[at], home[at], max_bits)
            yield links(pairs)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(column_of(batch, c).to_numpy(zero_copy_only=False)) for c in ("block", "anchor", "home", "fp")]
            columns[0], columns[3] = columns[0].astype(np.int64), columns[3].view(np.uint64)
            if held:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            at = len(last) - int(last.sum())
            done, held = [c[:at] for c in columns], [c[at:] for c in columns]
            if hot is not None and len(done[0]):
                same = (done[0] == hot[0]) & (done[1] == hot[1])
                if same.any():
                    yield overflow([c[same] for c in done])
                    done = [c[~same] for c in done]
            if len(done[0]):
                yield from closed(done)
            if len(held[0]) > cell or hot is not None and (held[0][0], held[1][0]) == hot:
                hot = (held[0][0], held[1][0])
                yield overflow(held)
                held = []
        if held:
            if hot is not None and (held[0][0], held[1][0]) == hot:
                yield overflow(held)
            else:
                yield from closed(held)

    return run


def _meet_cells(max_bits: int) -> Callable:
    """Links within each cell of a hot anchor; a partition's rows are sorted by cell."""

    def run(batches):
        held = []
        for batch in batches:
            if batch.num_rows:
                key = np.stack([np.asarray(column_of(batch, c)).astype(np.int64) for c in ("block", "anchor", "i", "j")], axis=1)
                here = [key, np.asarray(column_of(batch, "home").to_numpy(zero_copy_only=False)), np.asarray(column_of(batch, "fp")).view(np.uint64)]
                held = [np.concatenate(x) for x in zip(held, here, strict=True)] if held else here
                last = (held[0] == held[0][-1]).all(axis=1)
                at = len(last) - int(last.sum())
                yield cells([c[:at] for c in held])
                held = [c[at:] for c in held]
        if held:
            yield cells(held)

    def cells(part):
        key, home, prints = part
        starts = np.flatnonzero(np.r_[len(key) > 0, (key[1:] != key[:-1]).any(axis=1)])
        pairs = [x for s, e in zip(starts, [*starts[1:], len(key)], strict=True) for x in spanning_links(prints[s:e], home[s:e], max_bits)]
        a = np.concatenate([x for x, _ in pairs] or [np.zeros(0, np.uint64)])
        b = np.concatenate([x for _, x in pairs] or [np.zeros(0, np.uint64)])
        return pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return run


def close_links(prints: DataFrame, max_bits: int, cell: int = CELL) -> DataFrame:
    """Links a, b between the distinct fingerprints ``prints(fp)`` that connect all close pairs.

    Every returned pair is within ``max_bits``; pairs whose ends are connected by
    others may be left out. A cell compares two parts of an anchor's members, of
    about ``cell / 2`` each.
    """
    sent = prints.select("fp").mapInArrow(_replicas(max_bits), "block int, anchor long, home boolean, fp long")
    dealt = sent.repartition("block", "anchor").sortWithinPartitions("block", "anchor")
    met = cut(dealt.mapInArrow(_meet(max_bits, cell), "block long, anchor long, home boolean, a long, b long"))
    links = met.filter("b is not null").select("a", "b")
    hot = met.filter("b is null").select("block", "anchor", "home", F.col("a").alias("fp"))
    sizes = hot.groupBy("block", "anchor").agg(F.ceil(F.count("*") * 2 / F.lit(cell)).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = hot.join(sizes, ["block", "anchor"]).select("block", "anchor", "home", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = pairs.select("block", "anchor", "home", "fp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    keys = ["block", "anchor", "i", "j"]
    more = cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_meet_cells(max_bits), "a long, b long")
    return links.unionByName(more).distinct()


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row; null and empty texts have fingerprint 0."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _roots(classes: DataFrame, max_bits: int) -> DataFrame:
    """``classes``, one row per fingerprint fp, with the root of each one's group."""
    nodes = components(close_links(classes, max_bits))
    return cut(classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of ``docs``.

    A word is a run of bytes without ASCII white space, A-Z in lower case. A text
    with fewer than ``shingle`` words counts as one shingle; null and empty texts
    have fingerprint zero and are linked like others. A row without doc_id gets
    the smallest doc_id it is connected with, null if there is none. Repeated rows
    each get a row. An empty table gives an empty result. Other columns are not read.
    """
    rows = cut(fingerprints(docs, shingle, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    rooted = _roots(classes, max_bits)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = cut(rooted.join(least, "root").select("fp", "n", "component_id"))
    found = attach(rows, table, ["fp"], "n", rows.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group: that with the smallest doc_id.

    Rows are told apart by doc_id and text, so a doc_id with two texts stays with
    the one and goes with the other. Of texts that share the smallest doc_id of
    their group, the one with the smallest SHA-256 stays. Of the rows without
    doc_id of a group one stays besides, chosen alike. Of repeated rows that stay,
    one does.
    """
    sha = lambda text: F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", sha("text").alias("sha"))
    rows = cut(rows.mapInArrow(_fingerprints(shingle), "doc_id long, sha string, fp long"))
    named, unnamed = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "sha")), F.when(F.col("doc_id").isNull(), F.col("sha"))
    classes = cut(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(named).alias("named"), F.min(unnamed).alias("unnamed")))
    rooted = _roots(classes, max_bits)
    best = rooted.groupBy("root").agg(F.min("named").alias("named"), F.min("unnamed").alias("unnamed"))
    table = cut(rooted.select("fp", "n", "root").join(best, "root").select("fp", "n", "named", "unnamed"))
    stays = F.when(F.col("doc_id").isNull(), F.col("sha") == F.col("unnamed")).otherwise((F.col("doc_id") == F.col("named.doc_id")) & (F.col("sha") == F.col("named.sha")))
    found = attach(rows, table, ["fp"], "n", rows.count()).select("doc_id", "sha", stays.alias("stays"))
    found = found.groupBy("doc_id", "sha", "stays").agg(F.count("*").alias("copies")).filter("not stays or copies > 1")
    marks = cut(found.select(F.col("doc_id").alias("_doc"), F.col("sha").alias("_text"), F.col("stays").alias("_stays")))
    row = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), sha(f"`{text_col}`").alias("_sha"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_sha") == F.col("_text"))
    stay = row.join(marks, same, "left_anti").select("_row.*")
    twins = marks.filter("_stays")
    if twins.isEmpty():
        return stay
    one = row.join(twins, same, "left_semi").dropDuplicates(["_id", "_sha"]).select("_row.*")
    return stay.unionByName(one)
