"""Batch search: many queries in, ranked result pages with snippets out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.dates import display_date
from linkloom.operators.blocks import best, can_bound
from linkloom.operators.index import Index
from linkloom.operators.match import Terms, hit_counts, instances, located, match, prepare
from linkloom.operators.rank import (
    BOOST_CAP,
    BOOST_WEIGHT,
    PAGE_SIZE,
    boost,
    clamp,
    integer_rank,
    page_info,
    shown_title,
    title_or_number,
    top_per_query,
)
from linkloom.operators.snippet import snippets
from linkloom.sources.lineage import cut


@dataclass(frozen=True)
class SearchResult:
    """results: one row per shown page; totals: paging facts of every query."""

    results: DataFrame
    totals: DataFrame


def _sized(terms: Terms, top: DataFrame) -> DataFrame:
    """Result rows of a small batch: at most 50 per query, so they may be broadcast."""
    return F.broadcast(top) if terms.small else top


def ranked(
    index: Index,
    terms: Terms,
    limit: int = PAGE_SIZE,
    offset: int = 0,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    inbound: DataFrame | None = None,
    boost_weight: float = BOOST_WEIGHT,
    boost_cap: int = BOOST_CAP,
) -> DataFrame:
    """Page ids and scores of one result page per query. Inbound counts turn on the boost.

    Blocks of pages that cannot reach the result page are left out where the index
    has bounds for them; the results are the same.
    """
    if inbound is None and can_bound(index, terms):
        terms = located(index, terms) if terms.buckets is None else terms
        return best(index, terms, *clamp(limit, offset), weights)[0]
    scored = match(index, terms, weights)
    if inbound is not None:
        scored = boost(scored, inbound, boost_weight, boost_cap)
    return top_per_query(scored, *clamp(limit, offset))


def search(
    index: Index,
    pages: DataFrame,
    clauses: DataFrame,
    limit: int = PAGE_SIZE,
    offset: int = 0,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    inbound: DataFrame | None = None,
) -> SearchResult:
    """Run a batch of structured queries (see ``operators.match``).

    The matches serve both the totals and the ranking. Wide page columns are
    fetched for the shown rows only, after ranking. The few rows of each step go
    through the checkpoint folder, which keeps the plans short.
    """
    limit, offset = clamp(limit, offset)
    terms = located(index, prepare(clauses, index.stemmed))
    matched = match(index, terms, weights).persist()
    totals = cut(page_info(hit_counts(matched, clauses), limit, offset))
    scored = matched if inbound is None else boost(matched, inbound)
    top = cut(top_per_query(scored, limit, offset))
    matched.unpersist()
    wide = cut(
        pages.select("page_id", "url", "title", "text", "status_code", "post_date_iso").join(
            _sized(terms, top), "page_id"
        )
    )
    found = cut(instances(index, terms, _sized(terms, top)))
    shown = snippets(wide, found)
    results = wide.join(shown, ["query_id", "page_id"]).select(
        "query_id",
        "place",
        "page_id",
        "url",
        title_or_number(shown_title("title", "url", "status_code"), "page_id").alias("title"),
        F.coalesce("snippet", F.lit("")).alias("snippet"),
        "score",
        integer_rank("score").alias("rank"),
        "status_code",
        "post_date_iso",
        display_date("post_date_iso").alias("shown_date"),
    )
    return SearchResult(results, totals)
