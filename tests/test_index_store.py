"""The stored index: pruned scans, segments, failed builds, compaction."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from linkloom.operators import blocks
from linkloom.operators import match as matching
from linkloom.operators.index import build_index
from linkloom.operators.match import CLAUSE_SCHEMA, located, match, prepare
from linkloom.operators.rank import top_per_query
from linkloom.plans.search import ranked
from linkloom.sources import index_store
from linkloom.sources.index_store import IndexStore
from linkloom.sources.lineage import Scratch, freed_shuffles
from suite.search_queries import document_texts
from tests.test_tables import rows


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return document_texts(spark, sf_dir).cache()


@pytest.fixture
def store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_store, "BUCKET_ROWS", 200)
    monkeypatch.setattr(index_store, "PART_ROWS", 2_000)
    return IndexStore(spark, f"{tmp_path}/index")


def same(index, want):
    assert rows(index.postings.drop("bucket")) == rows(want.postings)
    assert rows(index.doc_stats) == rows(want.doc_stats)
    assert index.corpus_stats.first() == want.corpus_stats.first()


def clauses(spark, words, kind="term"):
    return spark.createDataFrame([(q, 0, 0, "must", kind, 7, 0, 0, w) for q, w in enumerate(words)], CLAUSE_SCHEMA)


def test_build_and_prune(spark, store, docs):
    assert store.build(docs, stem=False)
    index = store.read()
    want = build_index(docs, stem=False)
    same(index, want)
    assert index.buckets > 50 and not index.stemmed
    words = [r.token for r in want.postings.select("token").distinct().orderBy("token").limit(1500).collect()]
    for some, share in ((words[:3], 0.1), (words[:30], 0.5), (words, 1.0)):
        terms = located(index, prepare(clauses(spark, some), stem=False))
        assert len(terms.buckets) <= min(len(some), index.buckets)
        found = match(index, terms)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
        read = index.postings.filter(F.col("bucket").isin(*terms.buckets)).count()
        assert read <= share * index.postings.count() + 600
        got = sorted((r.query_id, r.page_id, round(r.score, 9)) for r in found.collect())
        plain = match(want, prepare(clauses(spark, some), stem=False)).collect()
        assert got == sorted((r.query_id, r.page_id, round(r.score, 9)) for r in plain)
    heads = [w[:2] for w in words[::100]]
    got, plain = (match(i, prepare(clauses(spark, heads, "prefix"), stem=False)).count() for i in (index, want))
    assert got == plain > 0


def test_prefixes_meet_few_ranges(spark, store, docs, monkeypatch):
    """A prefix reads the stretches of the vocabulary it can meet, in every segment; the words are all that fit."""
    monkeypatch.setattr(index_store, "RANGE_WORDS", 100)
    store.build(docs.filter("page_id % 2 = 0"), stem=False)
    store.sync(docs.filter("page_id % 2 = 1"))
    index = store.read()
    words = [r.token for r in index.vocabulary.collect()]
    n_ranges = index.words.ranges.count()
    assert n_ranges > 20 and index.words.ranges.filter("low > high").count() == 0
    for heads in (["a"], ["the", "über", "zz"], [words[0], max(words)], ["\U0010ffff"], [""]):
        found = index.words.starting_with(spark.createDataFrame([(h,) for h in heads], "head string"))
        got = {r.token for r in found.collect()}
        want = {w for w in words if any(w.startswith(h) for h in heads)}
        assert want <= got and (heads == [""] or len(got) <= len(want) + 4 * 2 * 150 * len(heads))
    plan = index.words.starting_with(spark.createDataFrame([("the",)], "head string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*range", plan)


def test_files_are_bounded(spark, tmp_path, monkeypatch):
    """Many words, a word on most places and long pages: no task writes more than it may."""
    monkeypatch.setattr(index_store, "PART_ROWS", 4_000)
    rare = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("w"), (F.col("page_id") * 20 + i).cast("string")))
    text = F.concat(F.lit("hot "), F.array_join(rare, " "))
    pages = spark.range(3_000).withColumnRenamed("id", "page_id").select("page_id", F.lit("hot").alias("title"), text.alias("text"), F.lit("").alias("url"))
    store = IndexStore(spark, f"{tmp_path}/index")
    store.build(pages, stem=False)
    files = spark.read.parquet(f"{tmp_path}/index/postings").groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("task"))
    sizes = [r["count"] for r in files.count().collect()]
    assert sum(sizes) == 3_000 * 22 and max(sizes) <= 4_000 and len(sizes) >= 30
    assert spark.read.parquet(f"{tmp_path}/index/postings").filter("token = 'hot'").select(F.input_file_name()).distinct().count() > 1


@pytest.mark.parametrize("pages_of_block", [2, 30])
def test_best_blocks(spark, store, docs, monkeypatch, pages_of_block):
    """The same results as from all matches, with fewer blocks scored."""
    monkeypatch.setattr(blocks, "BLOCK_PAGES", pages_of_block)
    store.build(docs, stem=False)
    assert store.read().bounds is None
    store.add_bounds()
    index = store.read()
    counts = index.vocabulary.orderBy(F.desc("df"), "token").limit(60).collect()
    words = [r.token for r in counts]
    rare = [r.token for r in index.vocabulary.filter("df between 2 and 6").orderBy("token").limit(20).collect()]
    rows = []
    for q in range(20):
        rows += [(4 * q, 0, 0, "must", "term", 7, 0, 0, words[q])]
        rows += [(4 * q + 1, c, c, "must", "term", 7, 0, 0, w) for c, w in enumerate((words[q], rare[q]))]
        rows += [(4 * q + 2, c, 0, "should", "term", 1 + q % 7, 0, 0, w) for c, w in enumerate((words[q], words[q + 20], rare[q]))]
        rows += [(4 * q + 3, 0, 0, "must", "term", 7, 0, 0, words[q + 1]), (4 * q + 3, 1, 1, "not", "term", 7, 0, 0, words[q + 30])]
    terms = prepare(spark.createDataFrame(rows, CLAUSE_SCHEMA), stem=False)
    assert blocks.can_bound(index, terms) and not blocks.can_bound(build_index(docs, stem=False), terms)
    for weights, limit, offset in (((1.0, 1.0, 1.0), 10, 0), ((3.0, 1.0, 0.5), 5, 5)):
        shown = lambda top: sorted((r.query_id, r.place, r.page_id, round(r.score, 9)) for r in top.collect())
        want = shown(top_per_query(match(index, terms, weights), limit, offset))
        assert shown(ranked(index, terms, limit, offset, weights)) == want
    every = blocks.query_blocks(index, located(index, terms), (1.0, 1.0, 1.0))[0]
    kept = blocks.best(index, located(index, terms), 3, 0)[1]
    total = index.bounds.table.select("block").distinct().count()
    assert kept.count() < 0.9 * every.count() and every.filter("query_id % 4 = 1").count() < 20 * total / 2
    store.sync(docs.limit(3))
    assert store.read().bounds is None
    store.compact()
    store.add_bounds()
    assert store.read().bounds is not None


def test_segments(spark, store, docs):
    assert store.last_segment() == -1 and store.read().postings.count() == 0
    assert not store.build(docs.limit(0))
    before = docs.filter("page_id % 5 <> 2").withColumn("text", F.when(F.col("page_id") % 5 == 1, "old").otherwise(F.col("text")))
    store.build(before, stem=False)
    store.sync(docs.filter("page_id % 5 = 1"))
    store.sync(docs.filter("page_id % 5 = 2"), docs.filter("page_id % 5 = 4").select("page_id"))
    want = build_index(docs.filter("page_id % 5 <> 4"), stem=False)
    same(store.read(), want)
    store.sync(docs.filter("page_id % 5 = 2"), docs.filter("page_id % 5 = 4").select("page_id"), segment=2)  # replayed
    same(store.read(), want)
    store.delete(docs.filter("page_id % 5 = 3").select("page_id"), docs)
    want = build_index(docs.filter("page_id % 5 < 3"), stem=False)
    same(store.read(), want)
    assert store.differing(docs.filter("page_id % 5 < 3")).count() == 0
    store.compact()
    same(store.read(), want)
    assert store.last_segment() == 4
    now = docs.filter("page_id % 5 < 3 and page_id <> 5").withColumn("title", F.when(F.col("page_id") == 6, "new").otherwise(F.col("title")))
    now = now.unionByName(docs.filter("page_id = 3"))
    found = store.differing(now)
    assert {(r.page_id, r.problem) for r in found.collect()} == {(5, "page missing"), (6, "stale"), (3, "not indexed")}
    assert store.differing(docs.limit(0)).count() == want.doc_stats.count()


def test_failed_build_changes_nothing(spark, store, docs, monkeypatch):
    store.build(docs, stem=False)
    monkeypatch.setattr(index_store, "entry_stats", lambda e: e.limit(3).select("page_id", "len_title", "len_text", "len_url", "doc_len"))
    with pytest.raises(ValueError, match="differs"):
        store.build(docs.filter("page_id < 50"), stem=False)
    monkeypatch.undo()
    same(store.read(), build_index(docs, stem=False))


def test_shared_ids_are_an_error(store, docs):
    with pytest.raises(ValueError, match="share an id"):
        store.build(docs.unionByName(docs.filter("page_id = 3").withColumn("url", F.lit("other"))))


def test_clauses_are_checked(spark):
    good = (0, 0, 0, "must", "term", 7, 0, 0, "x")
    for place, wrong in ((3, "shuold"), (4, "trem"), (5, 0), (3, "not"), (4, None)):
        row = [*good]
        row[place] = wrong
        with pytest.raises(ValueError, match="invalid"):
            prepare(spark.createDataFrame([tuple(row)], CLAUSE_SCHEMA))


def small_pages(spark, n=40):
    """Words on every page, on some and on one; some in two columns of a page."""
    text = F.concat_ws(" ", F.lit("hot"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")), F.concat(F.lit("own"), F.col("id").cast("string")))
    title = F.when(F.col("id") % 3 == 0, "hot").otherwise("w1 w1")
    return spark.range(n).select(F.col("id").alias("page_id"), title.alias("title"), text.alias("text"), F.lit("en").alias("url")).coalesce(2)


def test_large_batch_of_words(spark, store, monkeypatch):
    """A large batch gives the rows of a small one, from postings without positions and fewer shuffles."""
    store.build(small_pages(spark), stem=False)
    index = store.read()
    rows = [(1, 0, 0, "must", "term", 7, 0, 0, "hot"), (2, 0, 0, "should", "term", 1, 0, 0, "w1"), (2, 1, 0, "should", "term", 6, 0, 0, "w2"),
            (3, 0, 0, "must", "term", 7, 0, 0, "hot"), (3, 1, 1, "not", "term", 2, 0, 0, "w3"), (4, 0, 0, "must", "term", 7, 0, 0, "none")]
    shared = [*rows, (5, 0, 0, "must", "term", 7, 0, 0, "w1"), (5, 0, 0, "must", "term", 7, 0, 0, "own3")]
    weights = (3.0, 1.0, 0.0)
    for some in (rows, shared):
        batch = spark.createDataFrame(some, CLAUSE_SCHEMA)
        shown = lambda found: sorted((r.query_id, r.page_id, round(r.score, 9)) for r in found.collect())
        want = shown(match(index, prepare(batch, stem=False), weights))
        with monkeypatch.context() as small:
            small.setattr(matching, "SMALL_BATCH", 2)
            terms = prepare(batch, stem=False)
            assert not terms.small and not terms.positional and not terms.near
            found = match(index, terms, weights)
            assert shown(found) == want and len(want) > 40
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "positions" not in plan
        assert matching._plain_words(located(index, terms)) == (some is rows)


def test_words_are_counted_in_stored_postings(spark, store, monkeypatch):
    """The vocabulary is that of the postings, and the tokens of pages are unfolded for the postings alone."""
    calls = []
    postings_of = index_store.entry_postings
    monkeypatch.setattr(index_store, "entry_postings", lambda entries: calls.append(entries.columns) or postings_of(entries))
    written = []
    write_words = IndexStore._write_words
    monkeypatch.setattr(IndexStore, "_write_words", lambda self, segment, *rest: written.append(self._read("postings").count()) or write_words(self, segment, *rest))
    store.build(small_pages(spark), stem=False)
    assert "n_postings" in calls[0] and written == [store.read().postings.count()]
    want = {r.token: r["count"] for r in build_index(small_pages(spark), stem=False).postings.groupBy("token").count().collect()}
    assert {r.token: r.df for r in store.read().vocabulary.collect()} == want


def test_bounds_take_one_shuffle(spark, store):
    """Bounds by block are dealt once, also for writing by bucket."""
    store.build(small_pages(spark), stem=False)
    rows = blocks.block_bounds(store._read("postings"), 4)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    keys = rows.select("bucket", "token", "block")
    assert keys.count() == keys.distinct().count() > 0
    hot = rows.filter("token = 'hot'").agg(F.sum("n_rows").alias("n"), F.sum(F.get("n_pages", F.lit(6))).alias("pages"), F.max("max_tf").alias("tf")).first()
    assert (hot.n, hot.pages, hot.tf) == (54, 40, 2)


def test_postings_are_placed_in_parts(spark, store, docs, monkeypatch):
    """A part of the postings is shuffled at a time, its files go at once, and folding copies no postings."""
    for name, n in (("SHUFFLED_ROWS", 3_000), ("BUCKET_ROWS", 5_000), ("PART_ROWS", 20_000)):
        monkeypatch.setattr(index_store, name, n)
    kept, written = [], []
    keep, tasks = Scratch.keep, IndexStore._tasks
    monkeypatch.setattr(Scratch, "keep", lambda self, frame: (kept.append(frame.columns), keep(self, frame))[1])
    monkeypatch.setattr(IndexStore, "_tasks", lambda self, n: (written.append(n), tasks(self, n))[1])
    want = build_index(docs, stem=False)
    total = want.postings.count()
    assert total > 3_000 * index_store.MOST_PARTS
    store.build(docs, stem=False)
    assert len(written) > index_store.MOST_PARTS / 2 and sum(written) == total and max(written) < total / 3
    same(store.read(), want)
    store.sync(docs.filter("page_id % 9 = 1"), docs.filter("page_id % 9 = 2").select("page_id"))
    del kept[:], written[:]
    store.compact()
    left = build_index(docs.filter("page_id % 9 <> 2"), stem=False)
    assert not [c for c in kept if "positions" in c] and len(written) > index_store.MOST_PARTS / 2
    assert sum(written) == left.postings.count() and max(written) < sum(written) / 3
    same(store.read(), left)
    assert rows(store.read().vocabulary) == rows(left.postings.groupBy("token").agg(F.count("*").alias("df")))
    store.adopt(build_index(docs, stem=False), store.last_segment() + 1)
    same(store.read(), want)


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    """Shuffle files of what is written go with the job, not with the driver's garbage."""
    files = lambda: {str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList().mkString("\n").split("\n") if f.endswith(".data")}
    dealt = spark.range(50_000).withColumn("x", F.xxhash64("id")).repartition(4, "x")
    before = files()
    dealt.write.parquet(f"{tmp_path}/plain")
    assert files() - before
    seen = files()
    with Scratch(spark) as scratch:
        assert scratch.keep(dealt).count() == 50_000
    with freed_shuffles(spark):
        dealt.write.parquet(f"{tmp_path}/freed")
    for _ in range(50):
        if left := {f for f in files() - seen if os.path.getsize(f) > 50_000}:
            time.sleep(0.2)
    assert not left and spark.read.parquet(f"{tmp_path}/freed").count() == 50_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_postings_are_packed_for_the_shuffle(spark):
    """Large and small numbers, one place and many, come back as they were."""
    made = [("a", 1, 0, 1, 1, [0]), ("a", -5, 2, 3, 2**31 - 1, [0, 7, 2**31 - 2]), ("ü", 2**62, 1, 1, 2**31 - 1, [2**31 - 2]), ("", 0, 1, 2, 2**30, [5, 6])]
    postings = spark.createDataFrame(made, "token string, page_id long, col tinyint, tf int, doc_len int, positions array<int>")
    packed = index_store._packed(postings)
    assert packed.columns == ["token", "page_id", "packed", "further"]
    got = index_store._unpacked(packed.withColumns({"block": F.lit(1), "bucket": F.lit(2)}))
    assert got.drop("block", "bucket").schema.simpleString() == postings.schema.simpleString() and rows(got.drop("block", "bucket")) == rows(postings)
    order = [(r.page_id, r.col) for r in spark.createDataFrame([("a", p, c, 1, 9, [8 - c]) for p in (1, 2) for c in (2, 0, 1)], postings.schema)
             .transform(index_store._packed).withColumns({"block": F.lit(1), "bucket": F.lit(2)}).orderBy("page_id", "packed").transform(index_store._unpacked).collect()]
    assert order == [(p, c) for p in (1, 2) for c in range(3)]
