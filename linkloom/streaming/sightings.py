"""What a stream remembers of each URL: keyed state with an expiry, and a notice of silence.

State is kept per canonical URL in RocksDB, so it may be larger than memory; a batch
touches the URLs it brings. URLs that are not seen for a while are forgotten, or
reported when they fall silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkloom.functions.urls import canonical_url

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SIGHTINGS = "url string, event string, first_seen timestamp, last_fetch timestamp, n_fetches long, n_late long"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


class _Sightings(StatefulProcessor):
    """First and last fetch of each URL: a row per batch that brings it, and one when it falls silent."""

    def __init__(self, keep_ms: int | None, quiet_ms: int | None):
        self._keep, self._quiet = keep_ms, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", "first_ms long, last_ms long", self._keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._seen.get() if self._seen.exists() else None
        first, last = known or (None, None)
        n, late = 0, 0
        for part in rows:
            # A row is late if a newer one came in an earlier batch, whatever the order within this one.
            at = part["at_ms"]
            low, high = int(at.min()), int(at.max())
            first, last = (low, high) if first is None else (min(first, low), max(last, high))
            n += len(at)
            late += int((at < known[1]).sum()) if known else 0
        self._seen.update((first, last))
        if self._quiet is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self._quiet)
        yield _row(key[0], "known" if known else "new", first, last, n, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last = self._seen.get()
        self._seen.clear()
        yield _row(key[0], "silent", first, last, 0, 0)

    def close(self) -> None:
        pass


def _row(url: str, event: str, first: int, last: int, n: int, late: int) -> pd.DataFrame:
    at = lambda ms: pd.to_datetime([ms], unit="ms")
    return pd.DataFrame({"url": [url], "event": [event], "first_seen": at(first), "last_fetch": at(last), "n_fetches": [n], "n_late": [late]})


def url_sightings(fetches: DataFrame, keep: timedelta | None = None, quiet: timedelta | None = None, lateness: str = "1 hour") -> DataFrame:
    """One row per URL and micro-batch of a fetch stream: what is known of the URL after it.

    ``event`` is new for a URL that is not remembered, known for others; ``n_late`` counts
    fetches older than the newest one of earlier batches. Unusable URLs are dropped, and
    fetches without a time. With ``keep``, a URL is forgotten when no fetch of it came for
    so long in processing time; without, never. (A stream with ``keep`` runs batches to
    look for expired URLs as long as it lives, so it does not end by itself.) With
    ``quiet`` instead, time is that of the fetches: once the watermark, ``lateness`` behind the newest fetch, is so far
    past a URL's last fetch, a row with event silent tells so, and the URL is forgotten.
    """
    use_rocksdb(fetches.sparkSession)
    timed = fetches.select(canonical_url("url").alias("url"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    timed = timed.filter("url is not null and fetched_at is not null")
    if quiet is not None:
        timed = timed.withWatermark("fetched_at", lateness)
    rows = timed.withColumn("at_ms", F.unix_millis("fetched_at"))
    milliseconds = lambda t: None if t is None else int(t.total_seconds() * 1000)
    processor = _Sightings(milliseconds(keep) if quiet is None else None, milliseconds(quiet))
    mode = "EventTime" if quiet is not None else "ProcessingTime" if keep is not None else "None"
    return rows.groupBy("url").transformWithStateInPandas(processor, SIGHTINGS, "Append", mode)
