"""Streaming ingest of a fetch log into the page, version, link and index tables.

State is a folder with one sub-folder per table and micro-batch. A batch writes
only what it changes; readers take the newest row of each key. Contents are stored
once, by their hash, as the parse stage gives them; pages and versions are narrow rows
that name a hash, so upserts never move HTML. Edges whose target is not stored yet
wait in a table by target: a batch resolves its own edges against the pages, and
waiting ones against its new pages only.

Rows lie in buckets of their keys, and a batch reads the buckets it touches. How many
there are follows from the size of the store when it is begun or compacted, and is
part of each commit. A batch counts once its commit is written, and a replayed batch
overwrites its own folders, so the result is the same after any restart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions.urls import canonical_url
from linkloom.operators.fetches import MAX_BYTES, kept_fetches, parse_fetches, window_counts
from linkloom.operators.index import Index
from linkloom.operators.skew import skew_join
from linkloom.operators.store import (
    HEAD_COLUMNS,
    LINK_COLUMNS,
    PAGE_COLUMNS,
    VERSION_COLUMNS,
    fold_links,
    head_changes,
    link_sightings,
    version_keys,
)
from linkloom.sources.index_store import IndexStore, missing_path
from linkloom.sources.lineage import Scratch
from linkloom.sources.tables import SCHEMAS

#: URLs of a bucket, about, when a store is begun or compacted; a store may grow fourfold between.
BUCKET_URLS = 100_000
FEWEST_BUCKETS, MOST_BUCKETS = 16, 65_536
#: Rows of a batch that are broadcast to its contents; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

#: Key of the buckets of each table.
_KEYS = {"heads": "url", "page_versions": "page_id", "content_keys": "content_hash", "links": "from_page_id", "pending": "to_url"}
_TABLES = {
    "heads": ", ".join(c for c in SCHEMAS["pages"].split(", ") if c.split()[0] in HEAD_COLUMNS),
    "page_versions": "page_id long, content_hash string, status_code int, fetched_at timestamp_ntz",
    "contents": "content_hash string, title string, html string, text string",
    "content_keys": "content_hash string",
    "links": SCHEMAS["links"],
    "pending": "to_url string, from_page_id long, resolved boolean",
}


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_for(urls: int) -> int:
    """Buckets of a store of so many URLs, with room to grow."""
    return max(FEWEST_BUCKETS, min(MOST_BUCKETS, -(-4 * urls // BUCKET_URLS)))


@dataclass(frozen=True)
class State:
    """Tables under ``folder`` as of the last committed micro-batch."""

    spark: SparkSession
    folder: str

    def _last_commit(self) -> tuple[int, int | None]:
        """Number of the last committed batch and the buckets, -1 and None before the first."""
        try:
            commits = self.spark.read.schema("batch long, buckets int").parquet(f"{self.folder}/commits")
        except AnalysisException as error:
            if not missing_path(error):
                raise
            return -1, None
        last = commits.agg(F.max(F.struct("batch", "buckets")).alias("last")).first().last
        return (last.batch, last.buckets) if last else (-1, None)

    def last_batch(self) -> int:
        """Number of the last committed batch, -1 before the first."""
        return self._last_commit()[0]

    def buckets(self) -> int | None:
        """Buckets of the tables, None before the first batch."""
        return self._last_commit()[1]

    # reading

    def deltas(self, table: str, last: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows of a table up to a batch, with the batch they were written in; of some buckets if named."""
        last = self.last_batch() if last is None else last
        schema = _TABLES[table] + ", batch long" + (", bucket int" if table in _KEYS else "")
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        except AnalysisException as error:
            if not missing_path(error):
                raise
            return self.spark.createDataFrame([], schema).drop("bucket")
        rows = rows.filter(F.col("batch") <= last)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(*buckets) if buckets else F.lit(False))
        return rows.drop("bucket")

    def heads(self, last: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Pages without content: the newest row of each URL, combined before the shuffle."""
        rows = self.deltas("heads", last, buckets)
        newest = F.max(F.struct("batch", *[c for c in HEAD_COLUMNS if c != "url"])).alias("newest")
        return rows.groupBy("url").agg(newest).select("url", "newest.*").select(*HEAD_COLUMNS)

    def with_content(self, rows: DataFrame, last: int | None = None) -> DataFrame:
        """Rows with title, html and text of their content_hash."""
        return rows.join(self.deltas("contents", last).drop("batch"), "content_hash")

    def pages(self, last: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        return self.with_content(self.heads(last, buckets), last).select(*PAGE_COLUMNS)

    def versions(self, last: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        return self.with_content(self.deltas("page_versions", last, buckets), last).select(*VERSION_COLUMNS)

    def links(self, last: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Edges folded over all batches; their targets were filled in when either end came."""
        return fold_links(self.deltas("links", last, buckets).select(*LINK_COLUMNS))

    def pending(self, last: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """to_url, from_page_id of the edges whose target is not stored."""
        rows = self.deltas("pending", last, buckets)
        open_edges = rows.filter("not resolved").select("to_url", "from_page_id").distinct()
        return open_edges.join(rows.filter("resolved").select("to_url"), "to_url", "left_anti")

    def index(self) -> Index:
        """Index of the current pages, with the analyzer it was begun with."""
        return self._index_store().read()

    def _index_store(self) -> IndexStore:
        return IndexStore(self.spark, f"{self.folder}/index")

    # writing

    def apply(self, fetches: DataFrame, batch: int, max_bytes: int = MAX_BYTES, stem: bool = True) -> None:
        """Apply one batch of raw fetches: pages, versions, links, index, commit.

        ``stem`` counts for the first batch; the index keeps its analyzer.
        """
        last, buckets = self._last_commit()
        if batch <= last:
            return

        def touched(rows: DataFrame, key: str) -> list[int]:
            """Buckets of the keys, of which there are ``buckets`` at most."""
            return sorted(r.bucket for r in rows.select(_bucket(key, buckets).alias("bucket")).distinct().collect())

        with Scratch(self.spark) as scratch:
            parsed = scratch.keep(parse_fetches(fetches, max_bytes).withColumn("row", F.monotonically_increasing_id()))
            if buckets is None:
                buckets = buckets_for(parsed.select("url").distinct().count())
            write = lambda frame, table: self._write(frame, table, self.folder, batch, buckets)
            changes = scratch.keep(head_changes(self.heads(batch - 1, touched(parsed, "url")), parsed.drop("html", "title", "text")))
            write(changes.drop("change"), "heads")
            # every URL of the batch is among its changes, so their ids are all it takes
            known = self.deltas("page_versions", batch - 1, touched(changes, "page_id"))
            write(version_keys(known, parsed, changes), "page_versions")
            of_hash = scratch.keep(parsed.groupBy("content_hash").agg(F.min("row").alias("row")))
            stored = self.deltas("content_keys", batch - 1, touched(of_hash, "content_hash"))
            fresh = scratch.keep(of_hash.join(stored.select("content_hash"), "content_hash", "left_anti"))
            write(self._of_rows(parsed.select("row", "content_hash", "title", "html", "text"), fresh.select("row")).drop("row"), "contents")
            write(fresh.select("content_hash"), "content_keys")
            self._write_links(scratch, parsed, changes, touched, write, batch)
            # A refresh without new content leaves the index alone.
            renewed = changes.filter(F.col("change").isin("new", "changed")).join(of_hash, "content_hash").select("row", "page_id", "url")
            self._index_store().sync(self._of_rows(parsed.select("row", "title", "text"), scratch.keep(renewed)), segment=batch, stem=stem)
        self._commit(self.folder, batch, buckets)

    @staticmethod
    def _of_rows(wide: DataFrame, wanted: DataFrame) -> DataFrame:
        """Wide rows of a batch by their number; they stay where they are unless very many are wanted."""
        return wide.join(F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted, "row")

    def _write_links(self, scratch: Scratch, parsed: DataFrame, changes: DataFrame, touched, write, batch: int) -> None:
        """Edges of a batch with the targets that are stored, and those that waited for its new pages."""
        seen = scratch.keep(link_sightings(parsed.select("url", "fetched_at", "out_links"), changes).drop("to_page_id"))
        ids = self.heads(batch - 1, touched(seen, "to_url")).select("url", "page_id").unionByName(changes.filter("change = 'new'").select("url", "page_id"))
        targets = ids.select(F.col("url").alias("to_url"), F.col("page_id").alias("to_page_id"))
        edges = scratch.keep(skew_join(seen, targets, ["to_url"], ["from_page_id"]).select(*LINK_COLUMNS))
        new = changes.filter("change = 'new'").select(F.col("url").alias("to_url"), F.col("page_id").alias("to_page_id"))
        waiting = self.pending(batch - 1, touched(new, "to_url"))
        no_time = F.lit(None).cast("timestamp_ntz")
        filled = skew_join(waiting, new, ["to_url"], ["from_page_id"], "inner").withColumns({"first_seen_at": no_time, "last_seen_at": no_time})
        write(edges.unionByName(filled.select(*LINK_COLUMNS)), "links")
        still_open = edges.filter("to_page_id is null").select("to_url", "from_page_id", F.lit(False).alias("resolved"))
        resolved = new.select("to_url", F.lit(None).cast("long").alias("from_page_id"), F.lit(True).alias("resolved"))
        write(still_open.unionByName(resolved), "pending")

    @staticmethod
    def _write(frame: DataFrame, table: str, folder: str, batch: int, buckets: int) -> None:
        path, key = f"{folder}/{table}/batch={batch}", _KEYS.get(table)
        if key:
            frame = frame.withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
            frame.write.mode("overwrite").partitionBy("bucket").parquet(path)
        else:
            frame.write.mode("overwrite").parquet(path)

    def _commit(self, folder: str, batch: int, buckets: int) -> None:
        row = self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(buckets).alias("buckets"))
        row.write.mode("overwrite").parquet(f"{folder}/commits/part={batch}")

    def compact(self, target: str) -> State:
        """The same tables written to a new folder as one batch, in as many buckets as they need now.

        Ingest may go on there.
        """
        last = self.last_batch()
        buckets = buckets_for(self.heads(last).count())
        tables = {
            "heads": self.heads(last), "page_versions": self.deltas("page_versions", last).drop("batch"), "links": self.links(last),
            "contents": self.deltas("contents", last).drop("batch"), "content_keys": self.deltas("content_keys", last).drop("batch"),
            "pending": self.pending(last).withColumn("resolved", F.lit(False)),
        }
        for table, frame in tables.items():
            self._write(frame, table, target, last, buckets)
        index = self.index()
        compacted = State(self.spark, target)
        compacted._index_store().adopt(index, last)
        self._commit(target, last, buckets)
        return compacted


def start_ingest(
    stream: DataFrame, folder: str, checkpoint: str, max_bytes: int = MAX_BYTES, stem: bool = True,
    once: bool = False, compact_every: int = 0,
) -> StreamingQuery:
    """Run a fetch stream into the tables under ``folder``.

    ``once`` stops after the data that is there now, file group by file group. With
    ``compact_every`` the state is folded after every so many batches: generation
    g lives in ``folder/g<g>`` and ``current_state`` finds the newest.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not compact_every:
            State(spark, folder).apply(batch, number, max_bytes, stem)
            return
        state, generation = _generation(spark, folder)
        state.apply(batch, number, max_bytes, stem)
        if (number + 1) % compact_every == 0:
            state.compact(f"{folder}/g{generation + 1}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _generation(spark: SparkSession, folder: str) -> tuple[State, int]:
    """Newest generation with a commit, and its number."""
    generation = 0
    while State(spark, f"{folder}/g{generation + 1}").last_batch() >= 0:
        generation += 1
    return State(spark, f"{folder}/g{generation}"), generation


def current_state(spark: SparkSession, folder: str) -> State:
    """State of an ingest with ``compact_every``."""
    return _generation(spark, folder)[0]


def first_seen(stream: DataFrame, lateness: str | None = "7 days") -> DataFrame:
    """First fetch of each canonical URL; unusable URLs are dropped. With a lateness the
    remembered URLs expire; without one every URL is remembered, as a crawl does."""
    stream = stream.withColumn("url", canonical_url("url")).filter(F.col("url").isNotNull())
    if lateness is None:
        return stream.dropDuplicates(["url"])
    timed = stream.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    return timed.withWatermark("fetched_at", lateness).dropDuplicatesWithinWatermark(["url"])


def stream_throughput(stream: DataFrame, seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """Kept fetches per closed window."""
    timed = kept_fetches(stream).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    return window_counts(timed.withWatermark("fetched_at", lateness), seconds)
