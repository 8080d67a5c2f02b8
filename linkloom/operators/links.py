"""Link graph: edges, degrees, targets not yet stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.skew import skew_join


def link_edges(features: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per page and link, in page order, with the target's id when stored."""
    edges = features.select(
        F.col("page_id").alias("from_page_id"), F.posexplode("out_links").alias("position", "to_url")
    )
    targets = pages.select(F.col("url").alias("to_url"), F.col("page_id").alias("to_page_id"))
    return skew_join(edges, targets, ["to_url"], ["from_page_id", "position"]).select(
        "from_page_id", "position", "to_url", "to_page_id"
    )


def outbound_top(links: DataFrame, pages: DataFrame, k: int = 20) -> DataFrame:
    """The k pages with most out-links; their URLs are fetched after the cut."""
    top = (
        links.groupBy(F.col("from_page_id").alias("page_id"))
        .agg(F.count("*").alias("outbound"))
        .orderBy(F.desc("outbound"), "page_id")
        .limit(k)
    )
    return pages.select("page_id", "url").join(top, "page_id").select("page_id", "url", "outbound")


def unresolved(links: DataFrame) -> DataFrame:
    """Link targets that are not stored, with the number of links to each."""
    missing = links.filter(F.col("to_page_id").isNull())
    return missing.groupBy("to_url").agg(F.count("*").alias("n_links"))
