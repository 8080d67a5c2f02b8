"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many rows, so there are at most that many hot keys.
HOT_SHARE = 2048


#: Rows of an Arrow batch, in a session that works on documents.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Make the session's Arrow batches short, as documents are long.

    The default of 10,000 rows is made for narrow tables. With documents a batch
    reaches its limit of 64 MB, several times over in a task's off-heap buffers.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is an empty one."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Each text; a null text is an empty one."""
    return [x or "" for x in column.to_pylist()]


def pick(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under names of our own, so that others cannot clash."""
    return frame.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in short stretches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def attach(rows: DataFrame, table: DataFrame, on: Sequence[str], counted: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``table``, balanced when one key holds most rows.

    ``table`` has one row per key, and ``counted`` holds at least the number of
    ``rows`` of the key. Keys with more than ``total / HOT_SHARE`` rows number
    fewer than ``HOT_SHARE``: only these are broadcast. ``rows`` is read twice,
    so it should be a narrow, materialized table.
    """
    limit = max(1, total // HOT_SHARE)
    hot = table.filter(F.col(counted) > limit)
    rest = table.filter(F.col(counted) <= limit)
    keys = list(on)
    joined = rows.join(F.broadcast(hot), keys, "inner")
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, "left")
    return joined.unionByName(cold)
