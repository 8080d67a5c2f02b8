"""The stored full-text index: bucketed segments, tombstones, commits.

    postings/segment=n/bucket=b   files sorted by token, block, page and column
    bounds/segment=n/bucket=b     bounds of words by block of pages, if asked for
    vocabulary/segment=n/range=r  token, df: stretches of the sorted words
    word_ranges/segment=n         first and last word of each stretch
    doc_stats/segment=n           one row per page
    checksums/segment=n           checksums of the pages a segment adds, less those it replaces
    removed/segment=n             pages whose entries in earlier segments are dead
    commits/segment=n             one row: base or delta, buckets, analyzer, corpus totals

A search filters ``bucket`` to those of its words, so it reads the same few folders
for three words or three thousand. A full build goes to a segment of its own and
counts once its commit is there; readers and failed jobs never see half an index.
A change writes its own pages only. Writing a segment again replaces it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.blocks import block_bounds, block_of, spread_of
from linkloom.operators.index import (
    Bounds,
    Index,
    WordRanges,
    add_checksums,
    bucket_of,
    check_part,
    checksums,
    corpus_stats,
    entry_postings,
    entry_stats,
    page_digest,
    page_entries,
    verify_index,
)
from linkloom.operators.store import repeated_page_ids
from linkloom.sources.lineage import Scratch, freed_shuffles

#: Postings of a bucket, about, and the most that one task sorts and writes as a file.
BUCKET_ROWS, PART_ROWS = 2_000_000, 1_000_000
#: Most folders of a segment; a bucket has as many files as its postings need.
MOST_BUCKETS = 16_384
#: Words of a stretch of the vocabulary.
RANGE_WORDS = 100_000
#: Fewest postings that are worth a task of their own.
LEAST_ROWS = 50_000
#: Postings that are shuffled at a time; more are placed in parts, at most so many.
SHUFFLED_ROWS, MOST_PARTS = 4_000_000, 8
#: Files of grouped tokens: small row groups, so that a part of them still has work for all cores.
_ENTRY_FILES = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
#: Tombstones that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_POSTINGS = "token string, page_id long, col tinyint, tf int, doc_len int, positions array<int>, block int, segment long, bucket int"
_SCHEMAS = {
    "postings": _POSTINGS,
    "vocabulary": "token string, df long, segment long, range int",
    "word_ranges": "range int, low string, high string, segment long",
    "checksums": "part int, n long, total decimal(38,0), mix long, segment long",
    "doc_stats": "page_id long, digest long, len_title int, len_text int, len_url int, doc_len int, segment long",
    "removed": "page_id long, segment long",
    "bounds": "token string, block int, max_tf long, min_len int, n_rows long, n_pages array<long>, segment long, bucket int",
    "commits": "base boolean, buckets int, stemmed boolean, n_docs long, total_len long, spread int, segment long",
}


def missing_path(error: AnalysisException) -> bool:
    """Whether an analysis failed as there is no such folder, and for no other reason."""
    return error.getCondition() == "PATH_NOT_FOUND"


def _parts(rows: DataFrame, key: Column, postings: Column) -> list[tuple[DataFrame, int]]:
    """Stored rows by stretches of ``key``, a file or folder of them, with their numbers of postings.

    One part for up to ``SHUFFLED_ROWS`` postings; of many, none has much more than its share.
    """
    sizes = sorted((r.key, r.n) for r in rows.groupBy(key.alias("key")).agg(postings.alias("n")).collect())
    total = sum(n for _, n in sizes)
    most = min(MOST_PARTS, -(-total // SHUFFLED_ROWS))
    if most <= 1:
        return [(rows, total)]
    parts: dict[int, dict] = {}
    seen = 0
    for name, n in sizes:
        parts.setdefault(min(most - 1, seen * most // total), {})[name] = n
        seen += n
    return [(rows.filter(key.isin(*names)), sum(names.values())) for names in parts.values()]


def _packed(postings: DataFrame) -> DataFrame:
    """Postings as they are shuffled: length of the page, column and first place in one number
    (31, 2 and 31 bits), which orders the columns of a page, and further places if there are any."""
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(0)).cast("long")
    number = F.shiftleft(F.col("doc_len").cast("long"), 33).bitwiseOR(F.shiftleft(F.col("col").cast("long"), 31)).bitwiseOR(first)
    further = F.when(F.size("positions") != 1, F.slice("positions", 2, 2**31 - 1))
    return postings.select("token", "page_id", number.alias("packed"), further.alias("further"))


def _packed_len() -> Column:
    """Length of the page of a packed posting."""
    return F.shiftrightunsigned("packed", 33).cast("int")


def _unpacked(rows: DataFrame) -> DataFrame:
    """The stored columns of packed postings with bucket and block."""
    first = F.array(F.col("packed").bitwiseAND(F.lit(2**31 - 1)).cast("int"))
    positions = F.when(F.col("further").isNull(), first).otherwise(F.concat(first, "further"))
    column = F.shiftright("packed", 31).bitwiseAND(F.lit(3)).cast("tinyint")
    tf = F.coalesce(F.size("further"), F.lit(0)) + 1
    return rows.select(
        "token", "page_id", column.alias("col"), tf.alias("tf"), _packed_len().alias("doc_len"), positions.alias("positions"), "block", "bucket"
    )


@dataclass(frozen=True)
class IndexStore:
    """An index under ``folder``, as of its last commit."""

    spark: SparkSession
    folder: str

    def _read(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema(_SCHEMAS[table]).parquet(f"{self.folder}/{table}")
        except AnalysisException as error:
            if not missing_path(error):
                raise
            return self.spark.createDataFrame([], _SCHEMAS[table])

    def _commits(self) -> list:
        """Commits from the last full build on, oldest first."""
        rows = sorted(self._read("commits").collect(), key=lambda r: r.segment)
        bases = [k for k, r in enumerate(rows) if r.base]
        return rows[bases[-1] :] if bases else rows

    def last_segment(self) -> int:
        """Number of the last committed segment, -1 before the first."""
        return max((r.segment for r in self._commits()), default=-1)

    # reading

    def read(self) -> Index:
        """The index without what later segments replaced."""
        commits = self._commits()
        live = [r.segment for r in commits]
        here = F.col("segment").isin(*live) if live else F.lit(False)
        postings, stats, words = (self._read(t).filter(here) for t in ("postings", "doc_stats", "vocabulary"))
        ranges = WordRanges(self._read("word_ranges").filter(here), words.select("token", "segment", "range"))
        if len(live) > 1:
            dead = self._read("removed").filter(here).groupBy("page_id").agg(F.max("segment").alias("dead_before"))
            dead = dead.cache()
            dead = F.broadcast(dead) if dead.count() <= MOST_BROADCAST else dead
            postings, stats = (self._alive(rows, dead) for rows in (postings, stats))
            words = words.groupBy("token").agg(F.sum("df").alias("df"))
        last = commits[-1] if commits else None
        bounds = self._bounds(live[0], postings) if len(live) == 1 else None
        totals = [(last.n_docs, last.total_len)] if last else [(0, 0)]
        corpus = self.spark.createDataFrame(totals, "n_docs long, total_len long")
        corpus = corpus.withColumn("avg_len", F.try_divide(F.col("total_len").cast("double"), F.col("n_docs")))
        return Index(
            postings.drop("segment", "block"), stats.drop("segment"), corpus, last.stemmed if last else True, words.select("token", "df"), last.buckets if last else 1, bounds, ranges
        )

    def _bounds(self, segment: int, postings: DataFrame) -> Bounds | None:
        """Bounds of a full build; they say nothing once pages of it are replaced."""
        rows = self._read("bounds").filter(F.col("segment") == segment).drop("segment")
        return None if rows.isEmpty() else Bounds(rows, postings.drop("segment"))

    def add_bounds(self) -> None:
        """Write bounds by block for the last full build, for faster top results (``operators.blocks``).

        Segments added later turn them off; ``compact`` and this turn them on again.
        """
        commits = self._commits()
        if not commits:
            raise ValueError("there is no index yet")
        segment = commits[0].segment
        postings = self._read("postings").filter(F.col("segment") == segment)
        rows = block_bounds(postings, self._tasks(postings.count())).sortWithinPartitions("bucket", "token", "block")
        with freed_shuffles(self.spark):
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/bounds/segment={segment}")

    @staticmethod
    def _alive(rows: DataFrame, dead: DataFrame) -> DataFrame:
        marked = rows.join(dead, "page_id", "left")
        return marked.filter(F.col("dead_before").isNull() | (F.col("segment") >= F.col("dead_before"))).drop("dead_before")

    def differing(self, pages: DataFrame) -> DataFrame:
        """page_id and problem of what differs from the pages: not indexed, page missing, or stale content.

        The pages are hashed where they are and added up by part; the statistics of the
        index are opened only for parts whose checksums differ.
        """
        live = [r.segment for r in self._commits()]
        known = self._read("checksums").filter(F.col("segment").isin(*live) if live else F.lit(False)).drop("segment")
        now = pages.select("page_id", page_digest().alias("digest"))
        left = add_checksums(known.unionByName(checksums(now, -1))).filter("n <> 0 or total <> 0 or mix <> 0")
        parts = sorted(r.part for r in left.select("part").collect())  # CHECK_PARTS at most
        here = check_part("page_id").isin(*parts) if parts else F.lit(False)
        indexed = self.read().doc_stats.filter(here).select("page_id", F.col("digest").alias("indexed"), F.lit(True).alias("known"))
        both = now.filter(here).withColumn("stored", F.lit(True)).join(indexed, "page_id", "full")
        problem = (
            F.when(F.col("known").isNull(), "not indexed").when(F.col("stored").isNull(), "page missing").when(~F.col("digest").eqNullSafe(F.col("indexed")), "stale")
        )
        return both.select("page_id", problem.alias("problem")).filter("problem is not null")

    # writing

    def build(self, pages: DataFrame, stem: bool = True, segment: int | None = None) -> bool:
        """Index all pages anew, check the result against them, then switch readers to it.

        False, and nothing written, without pages. An index that fails the check is not
        committed; pages that share an id are an error.
        """
        if pages.isEmpty():
            return False
        if shared := repeated_page_ids(pages).limit(5).collect():
            raise ValueError(f"pages share an id: {sorted(r.page_id for r in shared)}")
        segment = self.last_segment() + 1 if segment is None else segment
        with Scratch(self.spark, **_ENTRY_FILES) as scratch:
            entries = scratch.keep(page_entries(pages, stem))
            spread = spread_of(entries.count())
            buckets = self._write_segment(segment, entries, None, spread)
            stats = self._read("doc_stats").filter(F.col("segment") == segment).drop("segment")
            self._write("checksums", segment, checksums(stats))
            totals = corpus_stats(stats).first()
            report = verify_index(Index(entry_postings(entries), stats, corpus_stats(stats)), pages).first()
        if not report.ok:
            raise ValueError(f"index differs from its pages: {report.asDict()}")
        self._commit(segment, True, buckets, stem, totals.n_docs, totals.total_len, spread)
        return True

    def sync(self, changed: DataFrame, removed_ids: DataFrame | None = None, segment: int | None = None, stem: bool = True) -> None:
        """Add a segment for new and modified pages, and for pages that went away.

        Only these pages are analyzed; of the others nothing is read but the
        statistics rows that are replaced. Without an earlier commit the changed
        pages are the whole index, analyzed as ``stem`` says; later it is ignored.
        """
        commits = self._commits()
        segment = self.last_segment() + 1 if segment is None else segment
        commits = [r for r in commits if r.segment < segment]
        last = commits[-1] if commits else None
        stem = last.stemmed if last else stem
        with Scratch(self.spark, **_ENTRY_FILES) as scratch:
            entries = scratch.keep(page_entries(changed, stem))
            gone = entries.select("page_id")
            if removed_ids is not None:
                gone = gone.unionByName(removed_ids.select(F.col("page_id").cast("long")))
            gone = scratch.keep(gone.distinct())
            replaced = scratch.keep(self._before(commits).join(gone, "page_id", "left_semi"))
            old = replaced.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
            self._write("checksums", segment, add_checksums(checksums(entries).unionByName(checksums(replaced, -1))))
            new = entries.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
            spread = last.spread if last else spread_of(new[0])
            buckets = self._write_segment(segment, entries, last.buckets if last else None, spread)
            self._write("removed", segment, gone)
        n, total = (last.n_docs, last.total_len) if last else (0, 0)
        self._commit(segment, last is None, buckets, stem, n - old[0] + new[0], total - old[1] + new[1], spread)

    def delete(self, page_ids: DataFrame, pages: DataFrame) -> None:
        """Drop the entries of pages; ``pages`` gives the columns of a page table."""
        self.sync(pages.limit(0), page_ids)

    def adopt(self, index: Index, segment: int) -> None:
        """Write another index as a full build, without analyzing a page again."""
        with Scratch(self.spark) as scratch:
            postings = scratch.keep(index.postings.drop("bucket"))
            self._write_index(index, segment, _parts(postings, F.col("_metadata.file_name"), F.count("*")))

    def compact(self) -> None:
        """Fold all segments into one full build.

        A segment of its own is written, so that postings are read where they are, some buckets at a time.
        """
        index = self.read()
        self._write_index(index, self.last_segment() + 1, _parts(index.postings, F.col("bucket"), F.count("*")))

    def _write_index(self, index: Index, segment: int, parts: list[tuple[DataFrame, int]]) -> None:
        """Write an index, whose postings come in these parts, as a full build."""
        totals = index.corpus_stats.first()
        with Scratch(self.spark) as scratch:
            stats = scratch.keep(index.doc_stats)
            spread = spread_of(totals.n_docs)
            buckets = self._write_postings(segment, parts, None, spread)
            self._write("doc_stats", segment, stats)
            self._write("checksums", segment, checksums(stats))
        self._commit(segment, True, buckets, index.stemmed, totals.n_docs, totals.total_len, spread)

    def _before(self, commits: list) -> DataFrame:
        """Statistics rows that are alive after these commits."""
        live = [r.segment for r in commits]
        here = F.col("segment").isin(*live) if live else F.lit(False)
        rows = self._read("doc_stats").filter(here)
        dead = self._read("removed").filter(here).groupBy("page_id").agg(F.max("segment").alias("dead_before"))
        return self._alive(rows, dead) if len(live) > 1 else rows

    def _write_segment(self, segment: int, entries: DataFrame, buckets: int | None, spread: int) -> int:
        self._write("doc_stats", segment, entry_stats(entries))
        parts = _parts(entries, F.col("_metadata.file_name"), F.sum("n_postings"))
        return self._write_postings(segment, [(entry_postings(rows), n) for rows, n in parts], buckets, spread)

    def _write_postings(self, segment: int, parts: list[tuple[DataFrame, int]], buckets: int | None, spread: int) -> int:
        """Postings and vocabulary of a segment; the number of buckets follows from the rows if it is open.

        Postings come in parts with their number, which are placed one after the other, so that
        the disk holds the shuffle of one part at a time. They are dealt by range of (bucket, token,
        block, page), so a frequent word, or a bucket of many rows, takes as many tasks as its rows
        need, and each file of a bucket holds a stretch of its words. Words are counted in these
        files, where a task meets few of them.
        """
        total = sum(n for _, n in parts)
        buckets = buckets or max(1, min(MOST_BUCKETS, -(-total // BUCKET_ROWS)))
        path = f"{self.folder}/postings/segment={segment}"
        for k, (rows, n) in enumerate(parts):
            bucket, block = bucket_of("token", buckets), block_of("page_id", _packed_len(), spread)
            placed = _packed(rows).repartitionByRange(self._tasks(n), bucket, "token", block, "page_id", "packed")
            placed = placed.withColumns({"bucket": bucket, "block": block}).sortWithinPartitions("bucket", "token", "block", "page_id", "packed")
            with freed_shuffles(self.spark):
                files = _unpacked(placed).write.mode("append" if k else "overwrite").option("compression", "zstd")
                files.partitionBy("bucket").parquet(path)
        with Scratch(self.spark) as scratch:
            here = self.spark.read.schema("token string").option("recursiveFileLookup", "true").parquet(path)
            words = scratch.keep(here.groupBy("token").agg(F.count("*").alias("df")))
            self._write_words(segment, words, words.count())
        return buckets

    def _write_words(self, segment: int, words: DataFrame, n_words: int) -> None:
        """Words in sorted stretches, one for each task, and the bounds of these."""
        dealt = words.repartitionByRange(max(1, -(-n_words // RANGE_WORDS)), "token").sortWithinPartitions("token")
        dealt = dealt.withColumn("range", F.spark_partition_id())
        with freed_shuffles(self.spark):
            dealt.write.mode("overwrite").partitionBy("range").parquet(f"{self.folder}/vocabulary/segment={segment}")
        here = self._read("vocabulary").filter(F.col("segment") == segment)
        self._write("word_ranges", segment, here.groupBy("range").agg(F.min("token").alias("low"), F.max("token").alias("high")).coalesce(1))

    def _tasks(self, total: int) -> int:
        """Tasks for so many postings: twice as many as their sizes need, as ranges are found from a
        sample, and at least enough for the cores if there is work for them."""
        cores = self.spark.sparkContext.defaultParallelism
        return max(1, -(-2 * total // PART_ROWS), min(2 * cores, total // LEAST_ROWS))

    def _write(self, table: str, segment: int, rows: DataFrame) -> None:
        with freed_shuffles(self.spark):
            rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/segment={segment}")

    def _commit(self, segment: int, base: bool, buckets: int, stem: bool, n_docs: int, total_len: int, spread: int) -> None:
        kinds = "base boolean, buckets int, stemmed boolean, n_docs long, total_len long, spread int"
        row = self.spark.createDataFrame([(base, buckets, stem, n_docs, total_len, spread)], kinds)
        self._write("commits", segment, row.coalesce(1))
