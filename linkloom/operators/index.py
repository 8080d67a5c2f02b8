"""Inverted index as ordinary tables: build, keep in step, verify.

``postings`` has one row per (token, page, column) with the positions of the
token. Term frequency and page length are stored in the row, so that scoring
needs neither the positions nor a join with the page statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.analysis import (
    group_stems,
    group_tokens,
    stem_column,
    stem_tokens,
    tokenize,
)

COLUMNS = ("title", "text", "url")


@dataclass(frozen=True)
class Bounds:
    """Bounds of words by block of pages (see ``operators.blocks``)."""

    table: DataFrame  # bucket, token, block, max_tf, min_len, n_rows, n_pages
    postings: DataFrame  # those of the index with their bucket and block


@dataclass(frozen=True)
class WordRanges:
    """The vocabulary in stretches of sorted words, and the first and last word of each."""

    ranges: DataFrame  # segment, range, low, high
    words: DataFrame  # token, segment, range

    def starting_with(self, heads: DataFrame) -> DataFrame:
        """Words of the stretches that hold any word that starts with a ``head``.

        A prefix is the interval of words from itself on, so it meets few stretches; at
        most all of them are fetched here, and the scan reads no other folders.
        """
        overlap = (F.col("high") >= F.col("head")) & ((F.col("low") <= F.col("head")) | F.startswith("low", "head"))
        met = self.ranges.join(F.broadcast(heads.distinct()), overlap).select("segment", "range").distinct().collect()
        by_segment: dict[int, list[int]] = {}
        for r in met:
            by_segment.setdefault(r.segment, []).append(r.range)
        here = F.lit(False)
        for segment, ranges in sorted(by_segment.items()):
            here = here | ((F.col("segment") == segment) & F.col("range").isin(*sorted(ranges)))
        return self.words.filter(here).select("token").distinct()


@dataclass(frozen=True)
class Index:
    """The tables of a full-text index over (title, text, url).

    A stored index also has its vocabulary, and its postings a column ``bucket``,
    ``bucket_of(token, buckets)``, by which the scan skips folders.
    """

    postings: DataFrame  # token, page_id, col, tf, doc_len, positions
    doc_stats: DataFrame  # page_id, digest, len_title, len_text, len_url, doc_len
    corpus_stats: DataFrame  # n_docs, total_len, avg_len
    stemmed: bool = True
    vocabulary: DataFrame | None = None  # token, df
    buckets: int | None = None
    bounds: Bounds | None = None
    words: WordRanges | None = None


def bucket_of(token: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def page_digest() -> Column:
    """Hash of what a page is indexed by; a column that is null counts as empty."""
    return F.xxhash64(*(F.coalesce(F.col(c), F.lit("")) for c in COLUMNS))


#: Parts of the pages, by a hash of their id, that have a checksum each.
CHECK_PARTS = 4096


def check_part(page_id: Column | str) -> Column:
    return F.pmod(F.xxhash64(page_id), F.lit(CHECK_PARTS)).cast("int")


def checksums(rows: DataFrame, sign: int = 1) -> DataFrame:
    """part, n, total, mix of rows (page_id, digest): number, sum and xor of their hashes, in any order.

    Those of rows that go, with sign -1, are added like others.
    """
    one = F.xxhash64("page_id", "digest")
    return rows.groupBy(check_part("page_id").alias("part")).agg(
        (F.count("*") * sign).alias("n"), (F.sum(one.cast("decimal(38,0)")) * sign).cast("decimal(38,0)").alias("total"), F.bit_xor(one).alias("mix")
    )


def add_checksums(sums: DataFrame) -> DataFrame:
    """One row per part of several lists of checksums."""
    return sums.groupBy("part").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mix").alias("mix"))


def analyzed(pages: DataFrame, stem: bool = True) -> DataFrame:
    """One row per page with its digest and the token list of each column."""
    lists = pages.select("page_id", page_digest().alias("digest"), *(tokenize(c).alias(c) for c in COLUMNS))
    if stem:
        lists = lists.select("page_id", "digest", *(stem_tokens(F.col(c)).alias(c) for c in COLUMNS))
    return lists


def _by_column(lists: DataFrame) -> DataFrame:
    """One row per page column: page_id, doc_len, col, tokens."""
    columns = F.array(
        *(
            F.struct(F.lit(i).cast("tinyint").alias("col"), F.col(c).alias("tokens"))
            for i, c in enumerate(COLUMNS)
        )
    )
    doc_len = sum((F.size(c) for c in COLUMNS), F.lit(0))
    exploded = lists.select("page_id", doc_len.alias("doc_len"), F.explode(columns).alias("c"))
    return exploded.select("page_id", "doc_len", "c.*")


def _entries(stem: bool) -> Column:
    """Grouped tokens of each column of a page: array of (col, g).

    All columns go through one call, which passes a batch of pages in slices.
    """
    groups = (group_stems if stem else group_tokens)(F.array(*COLUMNS))
    return F.transform(groups, lambda g, i: F.struct(i.cast("tinyint").alias("col"), g.alias("g")))


def tokens(pages: DataFrame, stem: bool = True) -> DataFrame:
    """One row per token occurrence: token, page_id, col (0 title, 1 text, 2 url), pos."""
    by_column = _by_column(analyzed(pages, stem))
    return by_column.select("page_id", "col", F.posexplode("tokens").alias("pos", "token"))


def stem_vocabulary(occurrences: DataFrame) -> DataFrame:
    """Distinct tokens with their stems and number of occurrences."""
    counted = occurrences.groupBy("token").agg(F.count("*").alias("n"))
    return counted.select("token", stem_column(F.col("token")).alias("stem"), "n")


def corpus_stats(doc_stats: DataFrame) -> DataFrame:
    return doc_stats.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("total_len"),
    ).withColumn("avg_len", F.try_divide(F.col("total_len").cast("double"), F.col("n_docs")))


def page_entries(pages: DataFrame, stem: bool = True) -> DataFrame:
    """One row per page: page_id, column lengths, doc_len, ``entries``, its grouped tokens, and their number.

    A page is one row, so its tokens are grouped where they are, without a shuffle.
    """
    lists = analyzed(pages, stem=False)
    lengths = [F.size(c).alias(f"len_{c}") for c in COLUMNS]
    doc_len = sum((F.size(c) for c in COLUMNS), F.lit(0)).alias("doc_len")
    entries = lists.select("page_id", "digest", *lengths, doc_len, _entries(stem).alias("entries"))
    return entries.withColumn("n_postings", F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + F.size(e["g"])))


def entry_stats(entries: DataFrame) -> DataFrame:
    return entries.select("page_id", "digest", *(f"len_{c}" for c in COLUMNS), "doc_len")


def entry_postings(entries: DataFrame) -> DataFrame:
    # Each page has an entry per column. For explode() Spark adds a filter on the size of the
    # array, which would call the grouping function a second time.
    columns = entries.select("page_id", "doc_len", F.explode_outer("entries").alias("e"))
    return _postings(columns.select("page_id", "doc_len", "e.*"))


def _postings(grouped: DataFrame) -> DataFrame:
    """One row per token of a page column, from page_id, doc_len, col and its groups g."""
    return grouped.select("page_id", "doc_len", "col", F.explode("g").alias("g")).select(
        "g.token",
        "page_id",
        "col",
        F.size("g.positions").alias("tf"),
        "doc_len",
        "g.positions",
    )


def build_index(pages: DataFrame, stem: bool = True) -> Index:
    """Index of a page table with columns page_id, title, text and url.

    Nothing is stored; ``sources.index_store`` analyzes pages once for all tables.
    """
    lists = analyzed(pages, stem=False)
    stats = lists.select("page_id", "digest", *(F.size(c).alias(f"len_{c}") for c in COLUMNS))
    stats = stats.withColumn("doc_len", sum((F.col(f"len_{c}") for c in COLUMNS), F.lit(0)))
    return Index(entry_postings(page_entries(pages, stem)), stats, corpus_stats(stats), stem)


def sync_index(index: Index, changed: DataFrame, removed_ids: DataFrame | None = None) -> Index:
    """Index after pages changed or went away; the other pages are not analyzed again.

    ``changed`` holds new and modified pages, ``removed_ids`` a page_id column. The
    result is a view; ``sources.index_store`` keeps such changes as small segments.
    """
    fresh = build_index(changed, index.stemmed)
    gone = changed.select("page_id")
    if removed_ids is not None:
        gone = gone.unionByName(removed_ids.select("page_id")).distinct()
    old = index.postings.drop("bucket").join(gone, "page_id", "left_anti")
    stats = index.doc_stats.join(gone, "page_id", "left_anti").unionByName(fresh.doc_stats)
    return Index(old.unionByName(fresh.postings), stats, corpus_stats(stats), index.stemmed)


def verify_index(index: Index, pages: DataFrame) -> DataFrame:
    """One row: pages, indexed documents, ids on one side only, and whether all agree.

    Pages without any token count as indexed: they have a statistics row.
    """
    sides = (
        pages.select("page_id", F.lit(1).alias("in_pages"), F.lit(0).alias("in_index"))
        .unionByName(
            index.doc_stats.select("page_id", F.lit(0).alias("in_pages"), F.lit(1).alias("in_index"))
        )
        .groupBy("page_id")
        .agg(F.sum("in_pages").alias("in_pages"), F.sum("in_index").alias("in_index"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return sides.agg(
        total("in_pages").alias("n_pages"),
        total("in_index").alias("n_indexed"),
        F.count_if(F.col("in_index") == 0).alias("n_missing"),
        F.count_if(F.col("in_pages") == 0).alias("n_orphaned"),
        F.count_if(F.col("in_pages") != F.col("in_index")).alias("n_different"),
    ).withColumn("ok", F.col("n_different") == 0)


def missing_ids(index: Index, pages: DataFrame) -> DataFrame:
    """Pages without an index entry and index entries without a page."""
    ids, docs = pages.select("page_id"), index.doc_stats.select("page_id")
    return (
        ids.join(docs, "page_id", "left_anti")
        .withColumn("problem", F.lit("not indexed"))
        .unionByName(
            docs.join(ids, "page_id", "left_anti").withColumn("problem", F.lit("page missing"))
        )
    )
