"""Top results by block bounds: blocks of pages that cannot reach the first k are not scored.

Pages fall into blocks by the band of their length and a hash of their id. For each
word and block the index may keep the largest frequency, the shortest page and how
many pages have the word in which columns. From these follow the exact document
frequencies and an upper bound of the score of any page of the block. A first pass
scores the few best blocks of each query; the k-th score found there is a threshold,
and a second pass scores the blocks whose bound reaches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.index import Bounds, Index
from linkloom.operators.match import B, K1, MASKS, PHRASE, SMALL_BATCH, Terms, _idf, scored, term_hits
from linkloom.operators.rank import top_per_query
from linkloom.sources.lineage import cut

#: Pages of a block, about, if lengths were spread over ``_BANDS`` bands.
BLOCK_PAGES = 1024
_BANDS = 8
#: Blocks of each query that the first pass scores.
FIRST_BLOCKS = 4
#: Parts that the words and blocks of a bucket are dealt to.
BUCKET_PARTS = 8


def block_of(page_id: Column | str, doc_len: Column | str, spread: int) -> Column:
    """Block of a page: four bands of length to each doubling, times ``spread`` parts."""
    band = F.floor(F.log2((F.col(doc_len) if isinstance(doc_len, str) else doc_len) + F.lit(1.0)) * 4).cast("int")
    return band * spread + F.pmod(F.xxhash64(page_id), F.lit(spread)).cast("int")


def spread_of(n_docs: int) -> int:
    """Parts of each band of lengths."""
    return max(1, -(-n_docs // (BLOCK_PAGES * _BANDS)))


def block_bounds(postings: DataFrame, tasks: int) -> DataFrame:
    """bucket, token, block, max_tf, min_len, n_rows, n_pages (by column mask) of ``postings``.

    One shuffle of the narrow columns, by bucket and part of its words and blocks, serves both
    steps and the writing by bucket.
    """
    keys = ["bucket", "part", "token", "block"]
    part = F.pmod(F.xxhash64("token", "block"), F.lit(BUCKET_PARTS))
    narrow = postings.select("bucket", part.alias("part"), "token", "block", "page_id", "col", "tf", "doc_len").repartition(tasks, "bucket", "part")
    pages = narrow.groupBy(*keys, "page_id").agg(
        F.sum("tf").alias("tf"), F.max("doc_len").alias("doc_len"), F.count("*").alias("n_rows"),
        F.bit_or(F.expr("shiftleft(1, cast(col AS int))")).alias("columns"),
    )
    counts = [F.count_if(F.col("columns").bitwiseAND(F.lit(m)) != 0) for m in MASKS]
    return pages.groupBy(*keys).agg(
        F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"), F.sum("n_rows").alias("n_rows"), F.array(*counts).alias("n_pages")
    ).drop("part")


def can_bound(index: Index, terms: Terms) -> bool:
    """Whether bounds decide this batch: the index has them, and all its phrases are single words."""
    return index.bounds is not None and not terms.positional and not terms.prefixes


def _sized(terms: Terms, rows: DataFrame, most: int) -> DataFrame:
    """Rows of which a small batch has at most ``most``; broadcast if these are few enough."""
    return F.broadcast(rows) if terms.small and most <= 10 * SMALL_BATCH else rows


def query_blocks(index: Index, terms: Terms, weights: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Blocks where a query may match, with the bound of their scores, and the document frequencies."""
    bounds: Bounds = index.bounds
    table = bounds.table.filter(F.col("bucket").isin(*terms.buckets) if terms.buckets else F.lit(False))
    wanted = terms.rows.select(*PHRASE, "group_id", "op", "n_groups", "col_mask", "token")
    found = table.join(F.broadcast(wanted) if terms.small else wanted, "token")
    found = found.withColumn("n", F.get("n_pages", F.col("col_mask") - 1)).filter("n > 0")
    found = cut(found.select(*PHRASE, "group_id", "op", "n_groups", "block", "max_tf", "min_len", "n"))
    frequency = cut(found.groupBy(*PHRASE).agg(F.sum("n").alias("n")))
    corpus = index.corpus_stats.first()
    most = F.col("max_tf") * float(max(weights))
    norm = K1 * (1 - B + B * F.col("min_len") / F.lit(corpus.avg_len or 1.0))
    part = _idf(F.lit(corpus.n_docs), F.col("n_all")) * most * (K1 + 1) / (most + norm)
    per_phrase = found.filter("op <> 'not'").join(_sized(terms, frequency.withColumnRenamed("n", "n_all"), SMALL_BATCH), list(PHRASE))
    blocks = per_phrase.groupBy("query_id", "block").agg(
        F.sum(part).alias("bound"), F.size(F.collect_set("group_id")).alias("groups"), F.max("n_groups").alias("n_groups")
    )
    return cut(blocks.filter(F.col("groups") == F.col("n_groups")).select("query_id", "block", "bound")), frequency


def _scored_blocks(index: Index, terms: Terms, frequency: DataFrame, blocks: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """query_id, page_id, score of all matches within some blocks of each query."""
    pairs = cut(terms.rows.join(blocks.select("query_id", "block"), "query_id"))
    few = pairs.count() <= 10 * SMALL_BATCH
    postings = index.bounds.postings.filter(F.col("bucket").isin(*terms.buckets) if terms.buckets else F.lit(False))
    hits = postings.drop("positions", "bucket").join(F.broadcast(pairs) if few else pairs, ["token", "block"])
    return scored(index, terms, term_hits(hits.filter(F.getbit("col_mask", F.col("col").cast("int")) == 1), weights), frequency)


def best(index: Index, terms: Terms, limit: int, offset: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """One page of results per query as ``top_per_query`` gives it, and the blocks that were scored.

    For batches for which ``can_bound`` holds; ``terms`` are located. The results are those
    of scoring every match.
    """
    last = offset + limit
    blocks, frequency = query_blocks(index, terms, weights)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = blocks.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= FIRST_BLOCKS).drop("i")
    found = top_per_query(_scored_blocks(index, terms, frequency, first, weights), last)
    reached = found.groupBy("query_id").agg(F.max("score").alias("score"), F.count("*").alias("n")).filter(F.col("n") >= last)
    kept = blocks.join(reached.select("query_id", F.col("score").alias("least")), "query_id", "left")
    # Sums may differ in the last digits by their order.
    kept = cut(kept.filter(F.col("least").isNull() | (F.col("bound") >= -F.col("least") * (1 - 1e-9))).drop("least"))
    return top_per_query(_scored_blocks(index, terms, frequency, kept, weights), limit, offset), kept
