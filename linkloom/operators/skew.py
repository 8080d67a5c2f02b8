"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.sources.lineage import cut

HOT_ROWS = 1_000_000
SALTS = 64
#: Most hot keys, which bounds what is broadcast whatever the data.
MOST_HOT = 10_000


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose hot keys, and null keys, are spread over ``salts`` partitions.

    A key is hot when ``left`` has more than ``hot_rows`` rows of it, and more than
    one in ``MOST_HOT`` of all rows. Only the hot rows of ``right`` are replicated.
    ``spread_by`` names left columns that differ within a key; hashing them keeps
    the salt stable across retries. ``left`` is needed twice, so it goes through
    the checkpoint folder and is evaluated once; it should be narrow.
    """
    keys = list(on)
    left = cut(left)
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    limit = max(hot_rows, left.count() // MOST_HOT)
    hot = cut(counts.filter(F.col("_n") > limit).select(*keys, F.lit(True).alias("_hot")))
    without = reduce(or_, (F.col(k).isNull() for k in keys))
    salted_left = left.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(F.col("_hot") | without, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")).otherwise(0),
    )
    salted_right = right.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    return salted_left.drop("_hot").join(salted_right.drop("_hot"), [*keys, "_salt"], how).drop("_salt")
