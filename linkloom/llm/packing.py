"""Best-fit packing of token sequences in bulk-synchronous supersteps.

Every document becomes pieces of at most ``capacity`` tokens. Pieces are
range-sorted by length, longest first, and ranked within their length from the
row counts of the range partitions, so that no task sees a whole length. There
are at most ``capacity`` lengths and gaps: a superstep sweeps the lengths from
the longest, each length finds its successor among the gaps (the smallest that
is large enough), and pieces that want the same gaps are resolved by rank. Then
gaps are updated and the next superstep follows. Lengths and gaps are runs of
ranks and of sequence numbers, so the sweeps work on a table that the capacity
bounds; its moves are joined to the ranked pieces in one pass at the end.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.bpe import encoder
from linkloom.llm.shared import as_texts, column_of, parts, pick
from linkloom.sources.lineage import cut

#: (length, first rank, number of pieces, first sequence, place in the sequence)
Move = tuple[int, int, int, int, int]


def piece_spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but the first."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _tokenizer(path: str, end_id: int, capacity: int) -> Callable:
    def run(batches):
        encode = encoder(path).ids
        for batch in parts(batches):
            rows = []
            for doc, text in zip(column_of(batch, "doc_id").to_pylist(), as_texts(column_of(batch, "text")), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(piece_spans(len(ids), capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every row; a null text is the end id alone."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(_tokenizer(tokenizer_path, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Gaps:
    """Open sequences by the room they have: runs of sequence numbers."""

    def __init__(self) -> None:
        self._sizes: list[int] = []
        self._runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in self._runs:
                insort(self._sizes, gap)
                self._runs[gap] = []
            self._runs[gap].append((first, n))

    def take(self, size: int, n: int) -> tuple[int, int, int] | None:
        """Up to n sequences of the smallest gap that holds ``size``: (gap, first, number)."""
        at = bisect_left(self._sizes, size)
        if at == len(self._sizes):
            return None
        gap = self._sizes[at]
        first, have = self._runs[gap].pop()
        if have > n:
            self._runs[gap].append((first + n, have - n))
        elif not self._runs[gap]:
            del self._runs[gap], self._sizes[at]
        return gap, first, min(n, have)


def supersteps(counts: Iterable[tuple[int, int]], capacity: int) -> list[Move]:
    """Moves that place all pieces, given how many there are of each length.

    A superstep takes the longest length with pieces left: its pieces in rank
    order go to their successor gaps, one to a gap, until none fits; the rest
    open sequences. Gaps that took a piece are updated for the next superstep.
    """
    gaps, moves, opened = _Gaps(), [], 0
    for size, n in sorted(counts, reverse=True):
        rank = 0
        while rank < n:
            updated = []
            while rank < n and (found := gaps.take(size, n - rank)):
                gap, first, took = found
                moves.append((size, rank, took, first, capacity - gap))
                updated.append((gap - size, first, took))
                rank += took
            if not updated:
                new = -(-(n - rank) // (capacity // size))
                moves.append((size, rank, new, opened, 0))
                updated.append((capacity - size, opened, new))
                rank, opened = rank + new, opened + new
            for gap in updated:
                gaps.add(*gap)
    return moves


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (length and any other columns) with sequence_id and offset.

    Lengths lie between 1 and ``capacity``. Sequences are numbered from 0 and
    filled from offset 0 without gaps. Equal rows are placed side by side; an
    empty table gives an empty result.
    """
    spark = pieces.sparkSession
    others = [F.col(f"`{c}`") for c in pieces.columns if c != "length"]
    order = [F.desc("length"), *others]
    dealt = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranked = cut(dealt.withColumns({"_part": F.spark_partition_id(), "_local": local}))
    sizes = [tuple(r) for r in ranked.groupBy("_part", "length").count().groupBy("length").agg(F.sum("count")).collect()]
    splits = sorted(tuple(r) for r in ranked.groupBy("_part").count().collect())
    before = np.cumsum([0] + [n for _, n in splits])
    ahead = np.cumsum([0] + [n for _, n in sorted(sizes, reverse=True)])
    starts = [(part, int(n)) for (part, _), n in zip(splits, before, strict=False)]
    firsts = [(size, int(n)) for (size, _), n in zip(sorted(sizes, reverse=True), ahead, strict=False)]
    moves = spark.createDataFrame(supersteps(sizes, capacity), "_length long, _rank long, _n long, _sequence long, offset long")
    starts = spark.createDataFrame(starts, "_part int, _before long")
    firsts = spark.createDataFrame(firsts, "length long, _ahead long")
    rows = ranked.join(F.broadcast(starts), "_part").join(F.broadcast(firsts), "length")
    rank = F.col("_local") + F.col("_before") - F.col("_ahead")
    mine = (F.col("length") == F.col("_length")) & rank.between(F.col("_rank"), F.col("_rank") + F.col("_n") - 1)
    placed = rows.join(F.broadcast(moves), mine)
    return placed.select(*[F.col(f"`{c}`") for c in pieces.columns], (rank - F.col("_rank") + F.col("_sequence")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A null text is an empty one and gives a piece with the end id alone. Repeated
    rows and rows without doc_id are packed like others. Other columns are not read.
    """
    return place(cut(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col)), capacity)
