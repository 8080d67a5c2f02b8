"""Running totals over sorted rows, whatever number of partitions one key spans.

Rows are sorted over all partitions. Each partition folds the rows of its last key
into a small state; the states, one for each partition, are put together in order,
and every partition then starts with the state that its first key brings along. A
state must be a monoid: what two stretches of rows give can be combined.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from linkloom.llm.shared import column_of
from linkloom.sources.lineage import cut


def sorted_rows(frame: DataFrame, *order: Column) -> DataFrame:
    """The rows sorted within and across the partitions of a written table."""
    return cut(frame.repartitionByRange(*order).sortWithinPartitions(*order))


def scan(rows: DataFrame, key: str, start: Callable[[], Any], fold: Callable[..., Any], combine: Callable[[Any, Any], Any], columns: Sequence[str], emit: Callable[..., tuple], schema: str) -> DataFrame:
    """What ``emit(state after the row, key, *columns)`` makes of each row of ``sorted_rows``.

    ``fold(state, *columns)`` returns the state after one more row of a key,
    ``combine`` that of two stretches, the earlier one first. A row for which
    ``emit`` returns None gives none.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[column_of(batch, c).to_pylist() for c in (key, *columns)], strict=True)

    def last(batches):
        first, now, state, any_row = None, None, None, False
        for here, *values in runs(batches):
            if not any_row or here != now:
                first, now, state, any_row = here if not any_row else first, here, start(), True
            state = fold(state, *values)
        if any_row:
            yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "whole": pa.array([first == now]), "state": pa.array([pickle.dumps((now, state))], pa.binary())})

    carried, before = {}, None
    for part in sorted(rows.select(key, *columns).mapInArrow(last, "part int, whole boolean, state binary").collect(), key=lambda r: r.part):
        carried[part.part] = before
        now, state = pickle.loads(part.state)
        before = (now, combine(before[1], state)) if before and part.whole and before[0] == now else (now, state)

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        now, state, any_row = None, None, False
        if carried.get(TaskContext.get().partitionId()):
            (now, state), any_row = carried[TaskContext.get().partitionId()], True
        for batch in batches:
            out = []
            for here, *values in runs([batch]):
                if not any_row or here != now:
                    now, state, any_row = here, start(), True
                state = fold(state, *values)
                row = emit(state, here, *values)
                if row is not None:
                    out.append(row)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)), schema=kinds)

    kinds = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in schema.split(", ")])
    return rows.select(key, *columns).mapInArrow(run, schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
