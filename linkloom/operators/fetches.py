"""Cleaning a fetch log and turning kept fetches into page features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.dates import normalize_post_date
from linkloom.functions.html import (
    page_links,
    page_text,
    page_title,
    raw_post_date,
    strip_ignored,
)
from linkloom.functions.urls import canonical_url, netloc

MAX_BYTES = 2_000_000
UNSTORED_STATUS = (404, 302)
SLOW_BELOW_PERCENT = 80


def clean_fetches(fetch_log: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The log with canonical URLs and a ``drop_reason``, null for fetches to store.

    Dead and redirecting fetches go first, whatever else is wrong with them.
    Other error statuses are kept when they came with HTML. A missing content
    type passes. Dropped rows lose their HTML.
    """
    canonical = canonical_url("url")
    status, kind = F.col("status"), F.coalesce("content_type", F.lit(""))
    reason = (
        F.when(F.col("url").isNull(), "bad-url")
        .when(status.isin(*UNSTORED_STATUS), F.concat(F.lit("status-"), status.cast("string")))
        .when((kind != "") & ~F.lower(kind).contains("html"), "non-html")
        .when(F.col("html").isNull(), F.coalesce("error", F.lit("no-html")))
        .when(F.octet_length("html") > max_bytes, "too-large")
    )
    return (
        fetch_log.withColumn("url", canonical)
        .withColumn("drop_reason", reason)
        .withColumn("html", F.when(F.col("drop_reason").isNull(), F.col("html")))
    )


def kept_fetches(fetch_log: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Only the fetches to store. Status and type filters reach the scan."""
    cleaned = clean_fetches(fetch_log, max_bytes)
    return cleaned.filter(F.col("drop_reason").isNull()).drop("drop_reason", "error", "content_type")


def extract_features(fetches: DataFrame) -> DataFrame:
    """Adds title, text, out_links, post_date, post_date_iso and content_hash.

    One pass without a shuffle; unused features are pruned by the optimizer.
    """
    stripped = F.col("stripped")
    return (
        fetches.withColumn("stripped", strip_ignored("html"))
        .withColumns(
            {
                "title": page_title(stripped),
                "text": page_text(stripped),
                "out_links": page_links(stripped, "url"),
                "dated": normalize_post_date(raw_post_date(stripped)),
                "content_hash": F.sha2("html", 256),
            }
        )
        .withColumns(
            {
                "post_date": F.col("dated")["post_date"],
                "post_date_iso": F.col("dated")["post_date_iso"],
            }
        )
        .drop("stripped", "dated")
    )


def parse_fetches(fetch_log: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Fetch log to page features: the row-wise part of an ingest, batch or stream."""
    return extract_features(kept_fetches(fetch_log, max_bytes))


def missing_dates(features: DataFrame) -> DataFrame:
    """Fetches without a usable post date, counted by host."""
    return (
        features.filter(F.col("post_date").isNull())
        .groupBy(netloc("url").alias("host"))
        .agg(F.count("*").alias("n"))
    )


def fetch_counters(fetch_log: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row: distinct URLs seen, fetches, fetches to store, pages stored."""
    cleaned = clean_fetches(fetch_log, max_bytes)
    kept = F.col("drop_reason").isNull()
    per_url = cleaned.groupBy("url").agg(
        F.count("*").alias("fetched"), F.count_if(kept).alias("kept")
    )
    return per_url.agg(
        F.count("url").alias("seen"),
        F.sum("fetched").alias("fetched"),
        F.sum("kept").alias("to_store"),
        F.count_if(F.col("kept") > 0).alias("pages"),
    )


def drop_reasons(fetch_log: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Fetches by outcome; ``stored`` for those without a drop reason."""
    reason = F.coalesce("drop_reason", F.lit("stored"))
    return (
        clean_fetches(fetch_log, max_bytes)
        .groupBy(reason.alias("outcome"))
        .agg(F.count("*").alias("n"))
    )


def window_counts(fetches: DataFrame, seconds: int = 60) -> DataFrame:
    """Kept fetches per tumbling window; also works on a stream with a watermark."""
    return (
        fetches.groupBy(F.window("fetched_at", f"{seconds} seconds").alias("w"))
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "n")
    )


def fetch_throughput(fetches: DataFrame, delay: float, seconds: int = 60) -> DataFrame:
    """Rate per window and since the start, as a share of the 1 / delay limit.

    ``slow`` marks windows whose running rate is under 80 % of the limit. The
    running total is summed by day first, so that no task sees all windows.
    """
    windows = window_counts(fetches, seconds).withColumn("day", F.to_date("window_start"))
    days = windows.groupBy("day").agg(F.sum("n").alias("day_n"), F.min("window_start").alias("first"))
    # One row per day of the log: small whatever the volume of fetches.
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    ever = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = days.select(
        "day",
        F.coalesce(F.sum("day_n").over(earlier), F.lit(0)).alias("before"),
        F.min("first").over(ever).alias("started"),
    )
    in_day = Window.partitionBy("day").orderBy("window_start")
    elapsed = F.timestamp_diff("SECOND", F.col("started"), F.col("window_start")) + seconds
    limit = F.lit(float(delay))
    return (
        windows.withColumn(
            "in_day", F.sum("n").over(in_day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        )
        .join(days, "day")
        .select(
            "window_start",
            "n",
            (F.col("n") / seconds).alias("pages_per_s"),
            (F.col("before") + F.col("in_day")).alias("running_n"),
            ((F.col("before") + F.col("in_day")) / elapsed).alias("running_pages_per_s"),
        )
        .withColumn(
            "percent_of_limit", F.when(limit > 0, 100 * F.col("running_pages_per_s") * limit)
        )
        .withColumn("slow", F.col("percent_of_limit") < SLOW_BELOW_PERCENT)
    )
