"""Ranking: inbound-link boost, top results per query, result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.columns import as_column

BOOST_WEIGHT = 0.05
BOOST_CAP = 20
PAGE_SIZE = 10
MOST_RESULTS = 50
# Up to this rank Spark keeps only the leading rows before it shuffles a window.
_GROUP_LIMIT = 1_000
_PARTS = 256


def inbound_counts(links: DataFrame) -> DataFrame:
    """Number of distinct pages linking to each page."""
    resolved = links.filter(F.col("to_page_id").isNotNull())
    return resolved.groupBy(F.col("to_page_id").alias("page_id")).agg(
        F.countDistinct("from_page_id").alias("inbound")
    )


def boost(
    scored: DataFrame, inbound: DataFrame, weight: float = BOOST_WEIGHT, cap: int = BOOST_CAP
) -> DataFrame:
    """Scores multiplied by 1 + weight * min(inbound links, cap)."""
    links = F.least(F.coalesce("inbound", F.lit(0)), F.lit(cap))
    return (
        scored.join(inbound, "page_id", "left")
        .withColumn("score", F.col("score") * (1.0 + weight * links))
        .drop("inbound")
    )


def clamp(limit: int = PAGE_SIZE, offset: int = 0) -> tuple[int, int]:
    """Result limit within 0 to 50, offset not negative."""
    return max(0, min(limit, MOST_RESULTS)), max(offset, 0)


def top_per_query(scored: DataFrame, limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """One page of results per query, numbered from 1 by (score, page_id).

    Only the leading rows of each partition are shuffled. Beyond the rank where
    Spark does that by itself, each query is first cut in ``_PARTS`` parts.
    """
    last = offset + limit
    order = ["score", "page_id"]
    if last >= _GROUP_LIMIT:
        part = F.pmod(F.xxhash64("page_id"), F.lit(_PARTS))
        in_part = Window.partitionBy("query_id", "part").orderBy(*order)
        scored = (
            scored.withColumn("part", part)
            .withColumn("place", F.row_number().over(in_part))
            .filter(F.col("place") <= last)
            .drop("part", "place")
        )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("place", place).filter(
        (F.col("place") <= last) & (F.col("place") > offset)
    )


def integer_rank(score: Column | str) -> Column:
    """Rank shown to users: floor of ten times the negated score."""
    return F.floor(-10 * as_column(score))


def shown_title(title: Column | str, url: Column | str, status: Column | str) -> Column:
    """Title of a result; dead pages (404) get their URL in front."""
    title, url = as_column(title), as_column(url)
    return F.when(as_column(status) == 404, F.concat_ws(" / ", url, title)).otherwise(title)


def title_or_number(title: Column | str, page_id: Column | str) -> Column:
    """``Page #<id>`` when there is no title."""
    return F.coalesce(F.nullif(as_column(title), F.lit("")), F.concat(F.lit("Page #"), as_column(page_id)))


def page_info(totals: DataFrame, limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """Paging of each query: current and last page, previous and next offset.

    Page numbers count in tens whatever the limit is, and a total that is a
    multiple of ten shows one page too many; users are used to both.
    """
    number = lambda c: F.floor(c / PAGE_SIZE) + 1
    return totals.select(
        "query_id",
        "total",
        number(F.lit(offset)).alias("page"),
        number(F.col("total")).alias("pages"),
        F.lit(max(offset - limit, 0) if offset > 0 else None).cast("int").alias("prev_offset"),
        F.when(F.col("total") > offset + limit, F.lit(offset + limit)).alias("next_offset"),
    )
