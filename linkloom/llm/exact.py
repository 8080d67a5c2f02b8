"""Exact duplicates: Patricia tries own the texts of one length-and-hash partition.

A first pass gives every row its key: the length in bytes and the SHA-256 of the
text after lower-casing A-Z. Whole byte strings, combined within each map task,
are then dealt by that key, and each owner inserts them into a compressed radix
trie whose terminal nodes hold the identifier that stays and the number of rows.
A trie beyond its budget writes its largest subtree to a file as a sorted run;
runs are merged at the end. Owners return one narrow row for each text that
occurs more than once, and a balanced join brings it to the rows.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import as_bytes, attach, column_of, parts, pick
from linkloom.sources.lineage import cut

#: Bytes of text that a map task combines, or that a trie holds, before it lets go of some.
BUDGET = 32 << 20

_KEYS = "n_bytes long, text_sha256 string"
_TEXTS = pa.schema(
    [("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("data", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64()), ("twins", pa.int64())]
)
_CLASSES = pa.schema([("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64()), ("twins", pa.int64())])

#: (identifier that stays or None, number of rows, rows that have this identifier)
Entry = tuple[int | None, int, int]


def merged(a: Entry, b: Entry, largest: bool) -> Entry:
    """One entry for two sets of rows with the same text. A null identifier never wins over another."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2]
    first = b[0] is None or a[0] is not None and (a[0] > b[0]) == largest
    keep = a if first else b
    return keep[0], a[1] + b[1], keep[2]


class _Node:
    __slots__ = ("children", "entry", "label")

    def __init__(self, label: bytes, entry: Entry | None = None):
        self.label, self.entry, self.children = label, entry, {}


def _shared_prefix(label: bytes, data: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``data[at:]``, by halving."""
    low, high = 0, min(len(label), len(data) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if data.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Compressed radix trie over byte strings that spills by subtree."""

    def __init__(self, largest: bool, budget: int = BUDGET):
        self._largest, self._budget = largest, budget
        self._root = _Node(b"")
        self._held: dict[int, int] = {}
        self._runs: dict[int, list] = {}

    def insert(self, data: bytes, entry: Entry) -> None:
        node, at = self._root, 0
        while at < len(data):
            child = node.children.get(data[at])
            if child is None:
                node.children[data[at]] = _Node(data[at:], entry)
                self._grown(data[0], len(data) - at)
                return
            if data.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _shared_prefix(child.label, data, at)
            fork = _Node(child.label[:n])
            child.label = child.label[n:]
            fork.children[child.label[0]] = child
            node.children[data[at]] = fork
            node, at = fork, at + n
        node.entry = entry if node.entry is None else merged(node.entry, entry, self._largest)

    def items(self) -> Iterator[tuple[bytes, Entry]]:
        """Every string once, with its entry, those that were spilled included."""
        if self._root.entry is not None:
            yield b"", self._root.entry
        for first in sorted({*self._root.children, *self._runs}):
            child = self._root.children.get(first)
            runs = [_read(run) for run in self._runs.get(first, ())] + ([_walk(child)] if child else [])
            for data, same in itertools.groupby(heapq.merge(*runs, key=lambda x: x[0]), key=lambda x: x[0]):
                entry = next(same)[1]
                for _, other in same:
                    entry = merged(entry, other, self._largest)
                yield data, entry

    def _grown(self, first: int, size: int) -> None:
        self._held[first] = self._held.get(first, 0) + size
        if sum(self._held.values()) > self._budget:
            most = max(self._held, key=self._held.get)
            run = tempfile.TemporaryFile()
            for item in _walk(self._root.children.pop(most)):
                pickle.dump(item, run)
            self._runs.setdefault(most, []).append(run)
            del self._held[most]


def _walk(top: _Node) -> Iterator[tuple[bytes, Entry]]:
    """Strings below a node in byte order."""
    stack = [(top, top.label)]
    while stack:
        node, prefix = stack.pop()
        if node.entry is not None:
            yield prefix, node.entry
        stack += [(child, prefix + child.label) for _, child in sorted(node.children.items(), reverse=True)]


def _read(run) -> Iterator[tuple[bytes, Entry]]:
    run.seek(0)
    while True:
        try:
            yield pickle.load(run)
        except EOFError:
            return


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        texts = [x.lower() for x in as_bytes(column_of(batch, "text"))]
        yield pa.record_batch(
            {"doc_id": column_of(batch, "doc_id"), "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "text_sha256": pa.array([_digest(x) for x in texts], pa.string())}
        )


def _combiner(largest: bool, budget: int) -> Callable:
    """Per map task: one row per distinct text, as far as the budget reaches."""

    def combine(batches):
        seen: dict[bytes, Entry] = {}
        held = 0
        for batch in parts(batches):
            for doc, data in zip(column_of(batch, "doc_id").to_pylist(), as_bytes(column_of(batch, "text")), strict=True):
                data = data.lower()
                known = seen.get(data)
                seen[data] = (doc, 1, 1) if known is None else merged(known, (doc, 1, 1), largest)
                held += len(data) if known is None else 0
                if held > budget:
                    yield from texts(seen)
                    seen, held = {}, 0
        yield from texts(seen)

    def texts(seen):
        while seen:
            part = [seen.popitem() for _ in range(min(256, len(seen)))]
            rows = [(len(d), _digest(d), d, *e) for d, e in part]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TEXTS.types, strict=True)], schema=_TEXTS)

    return combine


def _owner(largest: bool, budget: int) -> Callable:
    def own(batches):
        trie = PatriciaTrie(largest, budget)
        for batch in parts(batches):
            columns = [column_of(batch, c).to_pylist() for c in ("data", "keep_id", "n", "twins")]
            for data, *entry in zip(*columns, strict=True):
                trie.insert(data, tuple(entry))
        rows = ((len(d), _digest(d), *e) for d, e in trie.items() if e[1] > 1)
        while part := list(itertools.islice(rows, 4096)):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _CLASSES.types, strict=True)], schema=_CLASSES)

    return own


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and text_sha256 of the text with A-Z in lower case; null counts as empty."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_keys, f"doc_id long, {_KEYS}")


def repeated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """One row per text that occurs more than once: its key, keep_id, n rows, twins (rows with keep_id)."""
    largest = {"largest": True, "smallest": False}[keep]
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = rows.mapInArrow(_combiner(largest, budget), f"{_KEYS}, data binary, keep_id long, n long, twins long")
    return texts.repartition("n_bytes", "text_sha256").mapInArrow(_owner(largest, budget), f"{_KEYS}, keep_id long, n long, twins long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, twins.

    Texts are equal when identical after lower-casing A-Z. A null text is an
    empty one, and all empty texts are equal. A null doc_id stays only where the
    group has no other. Repeated rows (same doc_id and text) each get a row and
    agree on ``kept``; ``twins`` says how many rows have the doc_id that stays. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = cut(text_keys(docs, id_col, text_col))
    classes = cut(repeated_texts(docs, id_col, text_col, keep, budget))
    found = attach(rows, classes, ["n_bytes", "text_sha256"], "n", rows.count())
    alone = F.col("n").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
        F.coalesce("twins", F.lit(1)).cast("long").alias("twins"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with all their columns.

    Rows are dropped by doc_id and text, so documents that share a doc_id but not
    a text are told apart. Of repeated rows that stay, one does.
    """
    groups = exact_groups(docs, id_col, text_col, keep)
    marks = cut(groups.filter("group_size > 1 and (not kept or twins > 1)").select("doc_id", "text_sha256", "kept").distinct())
    if marks.isEmpty():
        return docs
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    row = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.sha2(F.translate(text, upper, lower), 256).alias("_sha"))
    named = marks.select(F.col("doc_id").alias("_doc"), F.col("text_sha256").alias("_text"), "kept")
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_sha") == F.col("_text"))
    stay = row.join(named, same, "left_anti").select("_row.*")
    twins = named.filter("kept")
    if twins.isEmpty():
        return stay
    one = row.join(twins, same, "left_semi").dropDuplicates(["_id", "_sha"]).select("_row.*")
    return stay.unionByName(one)
