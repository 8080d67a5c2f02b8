"""Registered queries on the full-text index and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions.html import page_text, page_title, strip_ignored
from linkloom.functions.urls import canonical_url
from linkloom.operators import store as st
from linkloom.operators.fetches import parse_fetches
from linkloom.operators.index import (
    Index,
    build_index,
    missing_ids,
    stem_vocabulary,
    sync_index,
    tokens,
    verify_index,
)
from linkloom.operators.match import CLAUSE_SCHEMA, hit_counts, match, plain_clauses, prepare
from linkloom.operators.rank import (
    inbound_counts,
    integer_rank,
    page_info,
    shown_title,
    title_or_number,
    top_per_query,
)
from linkloom.plans.search import ranked, search
from linkloom.sources.index_store import IndexStore
from linkloom.sources.lineage import cut, shared_folder
from linkloom.sources.tables import empty
from suite import fixtures as fixture
from suite import sql


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given pages with title, text and canonical URL."""
    s = strip_ignored("html")
    pages = fixture.spread_table(spark, sf_dir, "pages", "page_id")
    return pages.select(
        "page_id", canonical_url("url").alias("url"), page_title(s).alias("title"), page_text(s).alias("text")
    )


def page_index(spark: SparkSession, sf_dir: str, stem: bool = False) -> Index:
    return build_index(cut(page_texts(spark, sf_dir)), stem)


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table seen as pages: source as title, language as URL."""
    return fixture.spread_table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("title"), "text", F.col("lang").alias("url")
    )


DOCUMENTS = "docs AS (SELECT doc_id AS page_id, source AS title, text, lang AS url FROM documents)"
PAGE_TOKENS = f"{sql.PAGE_TEXTS}, {sql.TOKENS}"
DOCUMENT_TOKENS = f"{DOCUMENTS}, {sql.TOKENS}"

# Query batches: clause rows (query, clause, group, op, kind, col_mask, slop, phrase, text)
# and the same phrases for the SQL side (query, group, op, hits).
BATCHES = {
    "search_terms": (
        [(1, 0, 0, "must", "term", 7, 0, 0, "from"), (2, 0, 0, "must", "term", 7, 0, 0, "Was"),
         (12, 0, 0, "must", "term", 7, 0, 0, "zzunknown")],
        [(1, 0, "must", sql.term("from")), (2, 0, "must", sql.term("was")), (12, 0, "must", sql.term("zzunknown"))],
    ),
    "search_boolean": (
        [(3, 0, 0, "must", "term", 7, 0, 0, "from"), (3, 1, 1, "must", "term", 7, 0, 0, "with"),
         (4, 0, 0, "should", "term", 7, 0, 0, "des"), (4, 1, 0, "should", "term", 7, 0, 0, "auf"),
         (5, 0, 0, "must", "term", 7, 0, 0, "with"), (5, 1, 1, "not", "term", 7, 0, 0, "from"),
         (6, 0, 0, "should", "term", 7, 0, 0, "from"), (6, 1, 0, "should", "term", 7, 0, 0, "des"),
         (6, 2, 1, "should", "term", 7, 0, 0, "with"), (6, 3, 1, "should", "term", 7, 0, 0, "auf")],
        [(3, 0, "must", sql.term("from")), (3, 1, "must", sql.term("with")),
         (4, 0, "should", sql.term("des")), (4, 0, "should", sql.term("auf")),
         (5, 0, "must", sql.term("with")), (5, 1, "not", sql.term("from")),
         (6, 0, "should", sql.term("from")), (6, 0, "should", sql.term("des")),
         (6, 1, "should", sql.term("with")), (6, 1, "should", sql.term("auf"))],
    ),
    "search_phrases": (
        [(1, 0, 0, "must", "phrase", 7, 0, 0, "of the"), (2, 0, 0, "must", "phrase", 4, 0, 0, "example.com")],
        [(1, 0, "must", sql.phrase("of", "the")), (2, 0, "must", sql.phrase("example", "com", "a.col = 2"))],
    ),
    "search_columns": (
        [(7, 0, 0, "must", "term", 1, 0, 0, "des"), (8, 0, 0, "must", "term", 6, 0, 0, "en")],
        [(7, 0, "must", sql.term("des", "col = 0")), (8, 0, "must", sql.term("en", "col > 0"))],
    ),
    "search_prefixes": (
        [(9, 0, 0, "must", "prefix", 7, 0, 0, "han"), (9, 1, 1, "must", "prefix", 7, 0, 0, "wi")],
        [(9, 0, "must", sql.prefix("han")), (9, 1, "must", sql.prefix("wi"))],
    ),
    "search_near": (
        [(10, 0, 0, "must", "near", 7, 10, 0, "from"), (10, 0, 0, "must", "near", 7, 10, 1, "with")],
        [(10, 0, "must", sql.near("from", "with", 10)), (10, 1, "must", sql.near("with", "from", 10))],
    ),
    "search_initial": (
        [(11, 0, 0, "must", "initial", 7, 0, 0, "the"), (13, 0, 0, "must", "initial", 1, 0, 0, "der")],
        [(11, 0, "must", sql.term("the", "pos = 0")), (13, 0, "must", sql.term("der", "pos = 0 AND col = 0"))],
    ),
}


def clauses(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([row for name in names for row in BATCHES[name][0]], CLAUSE_SCHEMA)


def shown(top: DataFrame) -> DataFrame:
    return top.select("query_id", F.col("place").cast("long").alias("place"), "page_id", F.round("score", 4).alias("score"))


def batch_query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = page_index(spark, sf_dir)
        return shown(ranked(index, prepare(clauses(spark, name), stem=False)))

    text = f"WITH {PAGE_TOKENS}, {sql.scores(BATCHES[name][1])} {sql.TOP}"
    return query, text


def document_search(spark, sf_dir):
    index = build_index(document_texts(spark, sf_dir), stem=False)
    batch = clauses(spark, "search_terms", "search_boolean")
    return shown(ranked(index, prepare(batch, stem=False), limit=20))


DOCUMENT_SEARCH_SQL = f"""
WITH {DOCUMENT_TOKENS}, {sql.scores([p for n in ("search_terms", "search_boolean") for p in BATCHES[n][1]])}
{sql.TOP.replace("<= 10", "<= 20")}"""


def weighted_search(spark, sf_dir):
    terms = prepare(clauses(spark, "search_boolean"), stem=False)
    return shown(ranked(page_index(spark, sf_dir), terms, weights=(10.0, 1.0, 0.5)))


def _weighted(hits: str) -> str:
    weights = "sum(CASE col WHEN 0 THEN 10 WHEN 1 THEN 1 ELSE 0.5 END)"
    return hits.replace("count(*)", f"CAST({weights} AS DOUBLE)")


WEIGHTED_SQL = f"""
WITH {PAGE_TOKENS}, {sql.scores([(q, g, op, _weighted(h)) for q, g, op, h in BATCHES["search_boolean"][1]])}
{sql.TOP}"""


def stored_tables(spark, sf_dir):
    parsed = cut(parse_fetches(fixture.fetch_log(spark, sf_dir)))
    pages = cut(st.upsert_pages(empty(spark, "pages"), parsed))
    return pages, st.upsert_links(empty(spark, "links"), parsed, pages)


def boosted_search(spark, sf_dir):
    pages, links = stored_tables(spark, sf_dir)
    terms = prepare(clauses(spark, "search_boolean"), stem=False)
    return shown(ranked(build_index(pages, stem=False), terms, inbound=cut(inbound_counts(links))))


BOOSTED_SQL = f"""
WITH {sql.LINKS}, docs AS (SELECT * FROM stored), {sql.TOKENS},
inbound AS (SELECT to_page_id AS page_id, count(DISTINCT from_page_id) AS inbound FROM links
            WHERE to_page_id IS NOT NULL GROUP BY 1),
{sql.scores(BATCHES["search_boolean"][1]).replace("scored AS", "unboosted AS")},
scored AS (SELECT query_id, page_id, score * (1 + 0.05 * least(coalesce(inbound, 0), 20)) AS score
           FROM unboosted LEFT JOIN inbound USING (page_id))
{sql.TOP}"""

_ALL = ("search_terms", "search_boolean")
_ALL_PHRASES = [p for n in _ALL for p in BATCHES[n][1]]


def totals(spark, sf_dir):
    batch = clauses(spark, *_ALL)
    counts = hit_counts(match(page_index(spark, sf_dir), prepare(batch, stem=False)), batch)
    return page_info(counts, 10, 10)


TOTALS_SQL = f"""
WITH {PAGE_TOKENS}, {sql.scores(_ALL_PHRASES)},
t AS (SELECT query_id, count(page_id) AS total FROM need LEFT JOIN scored USING (query_id) GROUP BY 1)
SELECT query_id, total, CAST(2 AS BIGINT) AS page, CAST(1 + total // 10 AS BIGINT) AS pages, 0 AS prev_offset,
  CASE WHEN total > 20 THEN 20 END AS next_offset FROM t"""


def second_page(spark, sf_dir):
    terms = prepare(clauses(spark, "search_terms"), stem=False)
    return shown(ranked(page_index(spark, sf_dir), terms, limit=7, offset=7))


def plain_search(spark, sf_dir):
    """Queries as users type them: words and quoted phrases, all required."""
    queries = spark.createDataFrame([(1, ' from  "of the" '), (2, "   "), (3, "with that")], "query_id int, q string")
    terms = prepare(plain_clauses(queries), stem=False)
    return shown(ranked(page_index(spark, sf_dir), terms))


PLAIN_SQL = f"""
WITH {PAGE_TOKENS}, {sql.scores([(1, 0, "must", sql.term("from")), (1, 1, "must", sql.phrase("of", "the")),
                                 (3, 0, "must", sql.term("with")), (3, 1, "must", sql.term("that"))])} {sql.TOP}"""


def result_rows(spark, sf_dir):
    """Dead pages, missing titles and display ranks of one query over the fetch log's pages."""
    pages, _ = stored_tables(spark, sf_dir)
    status = F.when(F.col("page_id") % 7 == 1, 404).otherwise(F.col("status_code"))
    title = F.when(F.col("page_id") % 5 > 1, F.col("title")).when(F.col("page_id") % 5 == 1, "")
    pages = pages.select("page_id", "url", title.alias("title"), status.alias("status_code"), "text")
    scored = match(build_index(pages, stem=False), prepare(clauses(spark, "search_terms"), stem=False))
    shown_as = title_or_number(shown_title("title", "url", "status_code"), "page_id")
    return pages.join(top_per_query(scored, 50), "page_id").select(
        "query_id", "page_id", shown_as.alias("title"), integer_rank("score").alias("rank"))


RESULT_SQL = f"""
WITH {sql.STORED}, docs AS (
  SELECT page_id, url, text, CASE WHEN page_id % 5 > 1 THEN title WHEN page_id % 5 = 1 THEN '' END AS title,
         CASE WHEN page_id % 7 = 1 THEN 404 ELSE status_code END AS status_code FROM stored),
{sql.TOKENS}, {sql.scores(BATCHES["search_terms"][1])},
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, page_id) AS place FROM scored)
SELECT query_id, page_id, coalesce(nullif(CASE WHEN status_code = 404 THEN concat_ws(' / ', url, title) ELSE title END, ''),
  concat('Page #', page_id)) AS title, CAST(floor(-10 * score) AS BIGINT) AS rank
FROM top JOIN docs USING (page_id) WHERE place <= 50"""


def token_positions(spark, sf_dir):
    return tokens(page_texts(spark, sf_dir), stem=False).select(
        "page_id", F.col("col").cast("int").alias("col"), F.col("pos").cast("long").alias("pos"), "token")


def postings(spark, sf_dir):
    rows = build_index(document_texts(spark, sf_dir), stem=False).postings
    return rows.select("token", "page_id", F.col("col").cast("int").alias("col"), "tf",
                       F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


POSTINGS_SQL = f"""
WITH {DOCUMENT_TOKENS}
SELECT token, page_id, col, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions
FROM tok GROUP BY token, page_id, col"""


def doc_stats(spark, sf_dir):
    return build_index(document_texts(spark, sf_dir), stem=False).doc_stats.drop("digest")


DOC_STATS_SQL = f"""
WITH {DOCUMENT_TOKENS}
SELECT page_id, CAST(max(len(l)) FILTER (col = 0) AS INTEGER) AS len_title,
  CAST(max(len(l)) FILTER (col = 1) AS INTEGER) AS len_text, CAST(max(len(l)) FILTER (col = 2) AS INTEGER) AS len_url,
  CAST(sum(len(l)) AS INTEGER) AS doc_len FROM lists GROUP BY page_id"""


def corpus(spark, sf_dir):
    stats = build_index(document_texts(spark, sf_dir), stem=False).corpus_stats
    return stats.select("n_docs", "total_len", F.round("avg_len", 4).alias("avg_len"))


def vocabulary_stems(spark, sf_dir):
    return stem_vocabulary(tokens(document_texts(spark, sf_dir), stem=False))


def _split_index(spark, sf_dir):
    """Index of an older corpus brought up to date with changed, new and removed documents."""
    docs = document_texts(spark, sf_dir)
    old = docs.filter("page_id % 5 <> 2").withColumn(
        "text", F.when(F.col("page_id") % 5 == 1, "old text").otherwise(F.col("text"))
    )
    changed = docs.filter("page_id % 5 in (1, 2)")
    gone = docs.filter("page_id % 5 = 4").select("page_id")
    return sync_index(build_index(old, stem=False), changed, gone)


def index_sync(spark, sf_dir):
    rows = _split_index(spark, sf_dir).postings
    return rows.groupBy("token").agg(
        F.count("*").alias("n"), F.sum("tf").alias("tf"), F.sum("page_id").alias("ids"),
        F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p)).alias("places"))


INDEX_SYNC_SQL = f"""
WITH {DOCUMENTS.replace("FROM documents", "FROM documents WHERE doc_id % 5 <> 4")}, {sql.TOKENS},
p AS (SELECT token, page_id, col, count(*) AS tf, sum(pos) AS places FROM tok GROUP BY ALL)
SELECT token, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tf, CAST(sum(page_id) AS BIGINT) AS ids,
  CAST(sum(places) AS BIGINT) AS places FROM p GROUP BY token"""


def index_verification(spark, sf_dir):
    return verify_index(_split_index(spark, sf_dir), document_texts(spark, sf_dir))


def index_gaps(spark, sf_dir):
    return missing_ids(_split_index(spark, sf_dir), document_texts(spark, sf_dir))


def _store(spark, name: str) -> IndexStore:
    return IndexStore(spark, shared_folder(spark, name))


def search_stored(spark, sf_dir):
    """All batches at once, over ten words, on an index that was written and read back."""
    store = _store(spark, "index")
    store.build(page_texts(spark, sf_dir), stem=False)
    rows = [(100 * k + row[0], *row[1:]) for k, name in enumerate(BATCHES) for row in BATCHES[name][0]]
    return shown(ranked(store.read(), prepare(spark.createDataFrame(rows, CLAUSE_SCHEMA), stem=False)))


_WORD_BATCHES = ("search_terms", "search_boolean", "search_columns")


def search_best_blocks(spark, sf_dir):
    """Single words on a stored index with bounds by block; other blocks are not scored."""
    store = _store(spark, "blocks")
    store.build(document_texts(spark, sf_dir), stem=False)
    store.add_bounds()
    rows = [(100 * k + row[0], *row[1:]) for k, name in enumerate(_WORD_BATCHES) for row in BATCHES[name][0]]
    return shown(ranked(store.read(), prepare(spark.createDataFrame(rows, CLAUSE_SCHEMA), stem=False)))


BEST_BLOCKS_SQL = f"""
WITH {DOCUMENT_TOKENS}, {sql.scores([(100 * k + p[0], *p[1:]) for k, n in enumerate(_WORD_BATCHES) for p in BATCHES[n][1]])} {sql.TOP}"""


def _renumbered() -> list:
    """Phrases of all batches, with query numbers of their own for each batch."""
    return [(100 * k + p[0], *p[1:]) for k, name in enumerate(BATCHES) for p in BATCHES[name][1]]


def search_many_words(spark, sf_dir):
    """Hits of every word of the documents, a query each, on a stored index."""
    docs = document_texts(spark, sf_dir)
    store = _store(spark, "index")
    store.build(docs, stem=False)
    index = store.read()
    part = F.pmod(F.xxhash64("token"), F.lit(1024)).cast("int")
    number = F.row_number().over(Window.partitionBy(part).orderBy("token")) * 1024 + part
    words = cut(index.vocabulary.select(number.alias("query_id"), "token"))
    zero = lambda name, kind: F.lit(0).cast(kind).alias(name)
    batch = words.select(
        "query_id", zero("clause_id", "int"), zero("group_id", "int"), F.lit("must").alias("op"), F.lit("term").alias("kind"),
        F.lit(7).alias("col_mask"), zero("slop", "int"), zero("phrase_no", "int"), F.col("token").alias("text"))
    found = match(index, prepare(batch, stem=False)).groupBy("query_id").agg(F.count("*").alias("hits"))
    return found.agg(F.count("*").alias("n_words"), F.sum("hits").alias("hits"), F.max("hits").alias("most"))


SEARCH_MANY_SQL = f"""
WITH {DOCUMENT_TOKENS}, w AS (SELECT token, count(DISTINCT page_id) AS hits FROM tok GROUP BY token)
SELECT count(*) AS n_words, CAST(sum(hits) AS BIGINT) AS hits, max(hits) AS most FROM w"""


def search_limits(spark, sf_dir):
    """A limit beyond the largest and an offset below zero."""
    terms = prepare(clauses(spark, "search_terms"), stem=False)
    return shown(ranked(page_index(spark, sf_dir), terms, limit=99, offset=-5))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("token").agg(
        F.count("*").alias("n"), F.sum("tf").alias("tf"), F.sum("page_id").alias("ids"),
        F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, p: a + p)).alias("places"))


def index_segments(spark, sf_dir):
    """An older index brought up to date by segments of changed, new and deleted documents."""
    docs = document_texts(spark, sf_dir)
    store = _store(spark, "segments")
    store.build(docs.filter("page_id % 5 <> 2").withColumn("text", F.when(F.col("page_id") % 5 == 1, "old text").otherwise(F.col("text"))), stem=False)
    store.sync(docs.filter("page_id % 5 in (1, 2)"))
    store.delete(docs.filter("page_id % 5 = 4").select("page_id"), docs)
    return _summed(store.read().postings)


def index_differences(spark, sf_dir):
    """An index of two segments against documents that came, went and changed since."""
    docs = document_texts(spark, sf_dir)
    store = _store(spark, "differences")
    store.build(docs.filter("page_id % 3 <> 0"), stem=False)
    store.sync(docs.filter("page_id % 3 = 0 and page_id % 50 <> 0"))
    now = docs.filter("page_id % 70 <> 1").withColumn("text", F.when(F.col("page_id") % 90 == 2, "changed since").otherwise(F.col("text")))
    return store.differing(now)


DIFFERENCES_SQL = """
SELECT doc_id AS page_id, CASE WHEN doc_id % 70 = 1 THEN 'page missing' WHEN doc_id % 150 = 0 THEN 'not indexed' ELSE 'stale' END AS problem
FROM documents WHERE doc_id % 70 = 1 AND doc_id % 150 <> 0 OR doc_id % 70 <> 1 AND (doc_id % 150 = 0 OR doc_id % 90 = 2)"""


def reindexed(spark, sf_dir):
    """A full build over an older one, then all segments folded."""
    docs = document_texts(spark, sf_dir).filter("page_id % 5 <> 4")
    store = _store(spark, "reindex")
    store.build(docs.filter("page_id % 5 = 0"), stem=False)
    store.build(docs, stem=False)
    store.compact()
    return _summed(store.read().postings)


def search_results(spark, sf_dir):
    """Complete stemmed search with snippets and paging facts in each row."""
    pages, _ = stored_tables(spark, sf_dir)
    batch = clauses(spark, *BATCHES)
    found = search(build_index(pages), pages, batch)
    return found.results.join(found.totals, "query_id").withColumn("score", F.round("score", 4))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_texts(spark, sf_dir)
    batch = spark.createDataFrame([(1, "from")], "query_id int, q string")
    top = ranked(build_index(pages), prepare(plain_clauses(batch)))
    return pages.select("page_id", "url", "title").join(top, "page_id").select(
        "place", "page_id", "url", "title", F.round("score", 4).alias("score")
    )


QUERIES = {
    **{name: batch_query(name) for name in BATCHES},
    "search_documents": (document_search, DOCUMENT_SEARCH_SQL),
    "search_weighted": (weighted_search, WEIGHTED_SQL),
    "search_boosted": (boosted_search, BOOSTED_SQL),
    "search_second_page": (second_page, f"WITH {PAGE_TOKENS}, {sql.scores(BATCHES['search_terms'][1])} "
                           + sql.TOP.replace("place <= 10", "place BETWEEN 8 AND 14")),
    "search_plain": (plain_search, PLAIN_SQL),
    "search_totals": (totals, TOTALS_SQL),
    "search_result_rows": (result_rows, RESULT_SQL),
    "search_results": (search_results, None),
    "token_positions": (token_positions, f"WITH {PAGE_TOKENS} SELECT page_id, col, pos, token FROM tok"),
    "postings": (postings, POSTINGS_SQL),
    "doc_stats": (doc_stats, DOC_STATS_SQL),
    "corpus_stats": (corpus, f"""WITH {DOCUMENT_TOKENS}
        SELECT n_docs, CAST(total_len AS BIGINT) AS total_len, round(avg_len, 4) AS avg_len FROM corpus"""),
    "vocabulary_stems": (vocabulary_stems, None),
    "index_sync": (index_sync, INDEX_SYNC_SQL),
    "search_stored": (search_stored, f"WITH {PAGE_TOKENS}, {sql.scores(_renumbered())} {sql.TOP}"),
    "search_best_blocks": (search_best_blocks, BEST_BLOCKS_SQL),
    "search_many_words": (search_many_words, SEARCH_MANY_SQL),
    "search_limits": (search_limits, f"WITH {PAGE_TOKENS}, {sql.scores(BATCHES['search_terms'][1])} " + sql.TOP.replace("<= 10", "<= 50")),
    "index_segments": (index_segments, INDEX_SYNC_SQL),
    "reindexed": (reindexed, INDEX_SYNC_SQL),
    "index_verification": (index_verification, """
        SELECT count(*) AS n_pages, count(*) FILTER (doc_id % 5 <> 4) AS n_indexed, count(*) FILTER (doc_id % 5 = 4) AS n_missing,
          CAST(0 AS BIGINT) AS n_orphaned, count(*) FILTER (doc_id % 5 = 4) AS n_different,
          count(*) FILTER (doc_id % 5 = 4) = 0 AS ok FROM documents"""),
    "index_differences": (index_differences, DIFFERENCES_SQL),
    "index_gaps": (index_gaps, "SELECT doc_id AS page_id, 'not indexed' AS problem FROM documents WHERE doc_id % 5 = 4"),
}
