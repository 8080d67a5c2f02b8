"""Token sequences in training order, as shards of fixed-stride binary records.

Every document is cut into sequences of ``length`` tokens, the last one padded. A
sequence has a number made of a hash of its document's id and text and of its place in
the document, so the number does not depend on how the table is split, and a lost task
makes the same rows again. A keyed Feistel network permutes the numbers; results beyond
the domain are walked along their cycle until they fall into it. Positions are spread
evenly, so shards are equal ranges of them and need no sampling, and rows that share an
id, or have none, are spread like others. Rows equal in id and text share a number;
where they are a notable part of the table each gets one of its own.

Each shard is sorted and written by one task, first under a name of its own; a
sequence's global slot is the rank of its position over all shards. (To make the
position itself the slot, all sequences would have to be counted before the first one is
placed, by a second run of the tokenizer or a stored copy of all ids.) Slots, shards and
byte offsets follow from the manifest, so a reader can go on from any slot with
sequential reads.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.bpe import encoder
from linkloom.llm.shared import HOT_SHARE, as_texts, column_of
from linkloom.sources.lineage import cut

#: Bytes of a shard, about, for texts of two bytes a token.
SHARD_BYTES = 64 << 20
#: Sequences that a reader fetches with one request.
READ_TOGETHER = 4096
#: Rows equal in id and text that may share a number.
MOST_EQUAL = 64
_ROUNDS = 6
_PLACED = "doc_id long, seq int, shard int, place long, n_tokens int, ids_crc32 long"


# the permutation


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; every step wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, domain: int, key: int) -> np.ndarray:
    """Where a keyed permutation of 0 .. domain - 1 takes each number, by cycle-walking a Feistel network.

    The network works on a x b cells, as many as the domain or a few more, so that
    hardly any number needs a second walk.
    """
    a = max(1, math.isqrt(max(0, domain - 1)) + 1)
    b = max(1, -(-domain // a))
    keys = _mixed(np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))
    a, b = np.uint64(a), np.uint64(b)
    out = numbers.astype(np.uint64)
    going = np.arange(len(out))
    while len(going):
        left, right = out[going] // b, out[going] % b
        for k, one in enumerate(keys):
            if k % 2:
                right = (right + _mixed(left ^ one) % b) % b
            else:
                left = (left + _mixed(right ^ one) % a) % a
        out[going] = left * b + right
        going = going[out[going] >= np.uint64(domain)]
    return out


@dataclass(frozen=True)
class Order:
    """What every task needs to know: domain and shards of the positions, and keys of many equal rows."""

    per_document: int
    shards: int
    key: int
    hot: frozenset[int] = frozenset()

    @property
    def documents(self) -> int:
        return (1 << 61) // self.per_document

    @property
    def domain(self) -> int:
        return self.documents * self.per_document

    def positions(self, rows: np.ndarray, counts: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """Positions of the first ``counts`` sequences of documents with these row keys."""
        document = _mixed(rows.view(np.uint64) ^ _mixed(salts.astype(np.uint64))) % np.uint64(self.documents)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return permuted(np.repeat(document, counts) * np.uint64(self.per_document) + place.astype(np.uint64), self.domain, self.key)

    def shard(self, position: np.ndarray) -> np.ndarray:
        return (position // np.uint64(-(-self.domain // self.shards))).astype(np.int32)


def row_key(id_col: str, text_col: str) -> Column:
    """Hash of id and text of a row."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def order_of(docs: DataFrame, length: int, key: int, width: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Order:
    """Domain for all documents: a text of n bytes has at most n tokens and the end id."""
    size = F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long")
    keys = docs.select(row_key(id_col, text_col).alias("row"), size.alias("size")).groupBy("row").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    rows, longest, total, most = keys.agg(F.sum("n"), F.max("size"), F.sum(F.col("n") * F.col("size")), F.max("n")).first()
    shards = max(1, -(-((total or 0) // 2 * width) // shard_bytes))
    limit = max(MOST_EQUAL, (rows or 0) // HOT_SHARE)
    hot = frozenset(r.row for r in keys.filter(F.col("n") > limit).select("row").collect()) if (most or 0) > limit else frozenset()
    return Order((longest or 0) // length + 1, shards, key, hot)


# files


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path)


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def _sequences(tokenizer_path: str, end_id: int, length: int, order: Order) -> Callable:
    def run(batches):
        vocabulary = encoder(tokenizer_path)
        seen: Counter[int] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, data, lengths = column_of(part, "row").to_pylist(), [], []
                for text in as_texts(column_of(part, "text")):
                    ids = np.append(vocabulary.ids(text), np.uint32(end_id)).astype(vocabulary.dtype)
                    lengths.append(len(ids))
                    data += [ids, np.full(-len(ids) % length, end_id, vocabulary.dtype)]
                sizes = np.array(lengths)
                counts = -(-sizes // length)
                position = order.positions(np.array(keys, np.int64), counts, _salts(keys, order.hot, seen))
                seq = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                stride = length * vocabulary.dtype.itemsize
                flat = memoryview(np.concatenate(data).tobytes())
                records = [flat[k : k + stride] for k in range(0, len(flat), stride)]
                yield pa.record_batch(
                    {
                        "doc_id": column_of(part, "doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), counts))), "seq": pa.array(seq.astype(np.int32)),
                        "shard": pa.array(order.shard(position)), "position": pa.array(position.view(np.int64)),
                        "n_tokens": pa.array(np.minimum(length, np.repeat(sizes, counts) - seq * length).astype(np.int32)),
                        "ids_crc32": pa.array([zlib.crc32(r) for r in records], pa.int64()),
                        "record": pa.Array.from_buffers(pa.binary(), len(records), [None, pa.py_buffer(np.arange(0, len(flat) + 1, stride, dtype=np.int32)), pa.py_buffer(flat)]),
                    }
                )

    return run


def _salts(keys: list[int], hot: frozenset[int], seen: Counter[int]) -> np.ndarray:
    """0, but for a row of many equal ones a number of its own: its task's, and how many came before.

    Equal rows are interchangeable, so a task that runs again places the same records.
    """
    if not hot:
        return np.zeros(len(keys), np.uint64)
    task = TaskContext.get().partitionId() + 1
    salts = []
    for key in keys:
        if key in hot:
            seen[key] += 1
        salts.append(task << 40 | seen[key] if key in hot else 0)
    return np.array(salts, np.uint64)


def _writer(path: str) -> Callable:
    """Writes each shard of a partition, whose rows are sorted by shard and position, and returns where rows are."""

    def run(batches):
        store, folder = _store(path)
        shard, file, place, temporary = None, None, 0, ""

        def close() -> None:
            if file is not None:
                file.close()
                store.move(temporary, f"{folder}/{shard_name(shard)}")

        for batch in batches:
            shards = np.asarray(column_of(batch, "shard"))
            starts = np.flatnonzero(np.r_[len(shards) > 0, shards[1:] != shards[:-1]])
            for start, end in zip(starts, [*starts[1:], len(shards)], strict=True):
                if shards[start] != shard:
                    close()
                    shard, place = int(shards[start]), 0
                    temporary = f"{folder}/.{shard_name(shard)}-{uuid.uuid4().hex}"
                    file = store.open_output_stream(temporary)
                part = batch.slice(start, end - start)
                file.write(b"".join(column_of(part, "record").to_pylist()))
                kept = {c: column_of(part, c) for c in ("doc_id", "seq", "shard", "n_tokens", "ids_crc32")}
                places = pa.array(np.arange(place, place + end - start))
                yield pa.record_batch([kept["doc_id"], kept["seq"], kept["shard"], places, kept["n_tokens"], kept["ids_crc32"]], names=["doc_id", "seq", "shard", "place", "n_tokens", "ids_crc32"])
                place += end - start
        close()

    return run


def write_order(docs: DataFrame, path: str, tokenizer_path: str, length: int = 512, key: int = 0, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all sequences in training order to ``path``; doc_id, seq, slot, shard, place, n_tokens, ids_crc32 of each.

    ``path`` is a folder that all executors reach. Ids follow each other as 16-bit
    little-endian numbers, or 32-bit ones for vocabularies beyond 65,536; a record
    has ``length`` of them, end ids after the document's own. ``ids_crc32`` covers
    the record. The folder ``manifest`` beside the shards tells each one's first
    slot and number of records. A null text is an empty one, of one sequence. Null
    and repeated ids are permuted like others; equal positions are ordered by doc_id,
    place and content. An empty table writes an empty manifest.
    """
    vocabulary = encoder(tokenizer_path)
    spark = docs.sparkSession
    order = order_of(docs, length, key, vocabulary.dtype.itemsize, id_col, text_col, shard_bytes)
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), row_key(id_col, text_col).alias("row"))
    made = rows.mapInArrow(_sequences(tokenizer_path, end_id, length, order), "doc_id long, seq int, shard int, position long, n_tokens int, ids_crc32 long, record binary")
    dealt = made.repartitionById(order.shards, "shard").sortWithinPartitions("shard", "position", "doc_id", "seq", "ids_crc32", "record")
    placed = cut(dealt.mapInArrow(_writer(path), _PLACED))
    manifest, first = [], 0
    for shard, n in sorted(tuple(r) for r in placed.groupBy("shard").count().collect()):
        manifest.append((shard, first, n, length, vocabulary.dtype.itemsize))
        first += n
    manifest = spark.createDataFrame(manifest, "shard int, first_slot long, records long, length int, width int").coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    found = placed.join(F.broadcast(manifest.select("shard", "first_slot")), "shard")
    return found.select("doc_id", "seq", (F.col("first_slot") + F.col("place")).alias("slot"), "shard", "place", "n_tokens", "ids_crc32")


def read_order(spark: SparkSession, path: str, first_slot: int = 0, count: int | None = None) -> DataFrame:
    """slot, ids of ``count`` records from ``first_slot`` on, each stretch of a shard read sequentially."""
    end = F.lit(None).cast("long") if count is None else F.lit(first_slot + count)
    shards = spark.read.parquet(f"{path}/manifest").withColumn("end", F.least(F.col("first_slot") + F.col("records"), end))
    shards = shards.withColumn("begin", F.greatest("first_slot", F.lit(first_slot))).filter("begin < end")
    steps = F.explode(F.sequence("begin", F.col("end") - 1, F.lit(READ_TOGETHER)))
    asked = shards.select("shard", "first_slot", "length", "width", "end", steps.alias("slot")).repartition("shard", "slot")
    return asked.mapInArrow(_reader(path), "slot long, ids array<int>")


def _reader(path: str) -> Callable:
    def run(batches) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        for batch in batches:
            for row in batch.to_pylist():
                n, stride = min(READ_TOGETHER, row["end"] - row["slot"]), row["length"] * row["width"]
                with store.open_input_file(f"{folder}/{shard_name(row['shard'])}") as file:
                    data = file.read_at(n * stride, (row["slot"] - row["first_slot"]) * stride)
                ids = np.frombuffer(data, f"<u{row['width']}").reshape(n, row["length"]).astype(np.int32)
                yield pa.record_batch({"slot": pa.array(np.arange(row["slot"], row["slot"] + n)), "ids": pa.array(list(ids), pa.list_(pa.int32()))})

    return run
