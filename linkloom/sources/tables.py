"""Schemas, scans and sinks of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "fetch_log": (
        "url string, status int, content_type string, html string, error string, "
        "fetched_at timestamp_ntz"
    ),
    "pages": (
        "page_id long, url string, title string, html string, text string, content_hash string, "
        "status_code int, fetched_at timestamp_ntz, post_date timestamp_ntz, "
        "post_date_iso string, post_date_seen_at timestamp_ntz"
    ),
    "page_versions": (
        "page_id long, content_hash string, title string, html string, text string, "
        "status_code int, fetched_at timestamp_ntz"
    ),
    "links": (
        "from_page_id long, to_url string, to_page_id long, first_seen_at timestamp_ntz, "
        "last_seen_at timestamp_ntz"
    ),
    "robots": "origin string, status int, body string",
    "seeds": "url string",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def read_table(spark: SparkSession, table: str, path: str, file_format: str = "parquet") -> DataFrame:
    """Scan with the declared schema; nothing is inferred."""
    return spark.read.schema(SCHEMAS[table]).format(file_format).load(path)


def spread(scan: DataFrame, *by: str) -> DataFrame:
    """A scan with too few splits for the cluster, spread over its cores by columns.

    Parsing and tokenizing are costly per row, so a small input in one file would
    keep one core busy. Inputs with a split per core, as large ones have, stay
    as they are and are not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *by)


def write_table(frame: DataFrame, path: str, sorted_by: str | None = None) -> None:
    """Write a new snapshot folder. ``sorted_by`` clusters rows so that lookups by
    that column skip most row groups."""
    if sorted_by:
        frame = frame.repartitionByRange(sorted_by).sortWithinPartitions(sorted_by)
    frame.write.mode("overwrite").parquet(path)


def stream_fetches(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Fetch log as a stream of Parquet files."""
    reader = spark.readStream.schema(SCHEMAS["fetch_log"])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
