"""Page, version and link tables kept up to date by batches of fetches.

Pages and edges are folds that do not depend on the order of arrival: the latest
fetch of a URL wins, the latest known date stays, an edge spans its first to last
sighting. A content becomes a version once, stamped by the first batch that
brings it. So replaying a batch changes nothing, and late rows never overwrite
newer ones.

HTML and text stay out of the folds. Those work on narrow columns, and the
content of the few winning rows is joined back at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical_url
from linkloom.operators.skew import skew_join
from linkloom.sources.lineage import cut

PAGE_COLUMNS = (
    "page_id", "url", "title", "html", "text", "content_hash", "status_code",
    "fetched_at", "post_date", "post_date_iso", "post_date_seen_at",
)
#: A page without its content, which its hash stands for.
HEAD_COLUMNS = tuple(c for c in PAGE_COLUMNS if c not in ("title", "html", "text"))
VERSION_COLUMNS = ("page_id", "content_hash", "title", "html", "text", "status_code", "fetched_at")
LINK_COLUMNS = ("from_page_id", "to_url", "to_page_id", "first_seen_at", "last_seen_at")
_CONTENT = ("title", "html", "text")


def _with_ids(batch: DataFrame) -> DataFrame:
    """Batches may bring their own page ids; otherwise the id is a hash of the URL."""
    return batch if "page_id" in batch.columns else batch.withColumn("page_id", F.xxhash64("url"))


def _fold_batch(batch: DataFrame) -> DataFrame:
    """Narrow latest state per URL of a batch, combined before the shuffle."""
    when = F.struct("fetched_at", "content_hash", F.col("status").alias("status_code"))
    dated = F.struct("fetched_at", "post_date", "post_date_iso")
    return (
        _with_ids(batch)
        .groupBy("url")
        .agg(
            F.min("page_id").alias("batch_page_id"),
            F.max(when).alias("last"),
            F.max(F.when(F.col("post_date").isNotNull(), dated)).alias("dated"),
        )
    )


def _attach_content(narrow: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Adds title, html and text of one batch row per row of ``narrow``.

    Rows equal in ``keys`` have equal content, as the keys include its hash.
    """
    wide = batch.select(*keys, *_CONTENT).join(narrow.select(*keys), keys, "left_semi")
    one = wide.groupBy(*keys).agg(*(F.first(c).alias(c) for c in _CONTENT))
    return narrow.join(one, keys)


def head_changes(known: DataFrame, batch: DataFrame) -> DataFrame:
    """New state of the pages touched by a batch of parsed fetches, without their content.

    ``change`` tells what happened: new, changed, refreshed (same content) or
    late (older than the stored fetch, whose hash stays).
    """
    known = known.select(
        "url",
        "page_id",
        F.struct("fetched_at", "content_hash", "status_code").alias("known"),
        F.struct(
            F.col("post_date_seen_at").alias("fetched_at"), "post_date", "post_date_iso"
        ).alias("known_dated"),
    )
    has_known_date = F.col("known_dated.fetched_at").isNotNull()
    folded = (
        _fold_batch(batch)
        .join(known, "url", "left")
        .withColumn("dated", F.greatest("dated", F.when(has_known_date, F.col("known_dated"))))
        .withColumn("wins", F.col("known").isNull() | (F.col("last") >= F.col("known")))
        .withColumn("now", F.when(F.col("wins"), F.col("last")).otherwise(F.col("known")))
        .select(
            F.coalesce("page_id", "batch_page_id").alias("page_id"),
            "url",
            "now.*",
            "dated.post_date",
            "dated.post_date_iso",
            F.col("dated.fetched_at").alias("post_date_seen_at"),
            F.when(F.col("known").isNull(), "new")
            .when(~F.col("wins"), "late")
            .when(F.col("known.content_hash") == F.col("content_hash"), "refreshed")
            .otherwise("changed")
            .alias("change"),
        )
    )
    return folded.select(*HEAD_COLUMNS, "change")


def page_changes(current: DataFrame, batch: DataFrame) -> DataFrame:
    """``head_changes`` with the content of each page, for tables that hold whole pages."""
    folded = head_changes(current, batch)
    late = F.col("change") == "late"
    fresh = _attach_content(folded.filter(~late), batch, ["url", "fetched_at", "content_hash"])
    kept = folded.filter(late).join(current.select("url", *_CONTENT), "url")
    return fresh.unionByName(kept).select(*PAGE_COLUMNS, "change")


def upsert_pages(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Page table after a batch: one row per URL."""
    changed = page_changes(current, batch).drop("change")
    untouched = current.join(batch.select("url").distinct(), "url", "left_anti")
    return untouched.select(*PAGE_COLUMNS).unionByName(changed)


def upsert_report(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Touched pages by kind of change."""
    return head_changes(current, batch).groupBy("change").agg(F.count("*").alias("n"))


def version_keys(current: DataFrame, batch: DataFrame, pages: DataFrame) -> DataFrame:
    """Versions a batch adds, without content: the first fetch of each content not seen before."""
    firsts = (
        batch.groupBy("url", "content_hash")
        .agg(F.min(F.struct("fetched_at", F.col("status").alias("status_code"))).alias("f"))
        .select("url", "content_hash", "f.*")
    )
    return skew_join(firsts, pages.select("url", "page_id"), ["url"], ["content_hash"], "inner").join(
        current.select("page_id", "content_hash"), ["page_id", "content_hash"], "left_anti"
    )


def new_versions(current: DataFrame, batch: DataFrame, pages: DataFrame) -> DataFrame:
    """``version_keys`` with the content of each."""
    unseen = version_keys(current, batch, pages)
    return _attach_content(unseen, batch, ["url", "content_hash", "fetched_at"]).select(*VERSION_COLUMNS)


def append_versions(current: DataFrame, batch: DataFrame, pages: DataFrame) -> DataFrame:
    """Version table after a batch; ``pages`` is the page table after it."""
    added = new_versions(current, batch, pages)
    return current.select(*VERSION_COLUMNS).unionByName(added)


def link_sightings(batch: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges seen in a batch with their first and last sighting."""
    seen = (
        batch.select("url", "fetched_at", F.explode("out_links").alias("to_url"))
        .groupBy("url", "to_url")
        .agg(F.min("fetched_at").alias("first_seen_at"), F.max("fetched_at").alias("last_seen_at"))
    )
    ids = pages.select("url", F.col("page_id").alias("from_page_id"))
    return skew_join(seen, ids, ["url"], ["to_url"], "inner").select(
        "from_page_id",
        "to_url",
        F.lit(None).cast("long").alias("to_page_id"),
        "first_seen_at",
        "last_seen_at",
    )


def fold_links(sightings: DataFrame) -> DataFrame:
    """One row per edge: earliest and latest sighting, known target kept."""
    return (
        sightings.groupBy("from_page_id", "to_url")
        .agg(
            F.min("first_seen_at").alias("first_seen_at"),
            F.max("last_seen_at").alias("last_seen_at"),
            F.max("to_page_id").alias("to_page_id"),
        )
        .select(*LINK_COLUMNS)
    )


def backfill(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Fill missing targets whose URL is stored by now. Popular targets are spread."""
    targets = pages.select(F.col("url").alias("to_url"), F.col("page_id").alias("found_id"))
    return skew_join(links, targets, ["to_url"], ["from_page_id"]).select(
        "from_page_id",
        "to_url",
        F.coalesce("to_page_id", "found_id").alias("to_page_id"),
        "first_seen_at",
        "last_seen_at",
    )


def upsert_links(current: DataFrame, batch: DataFrame, pages: DataFrame) -> DataFrame:
    """Link table after a batch; ``pages`` is the page table after it.

    Only edges whose target is still open are looked up.
    """
    sightings = current.select(*LINK_COLUMNS).unionByName(link_sightings(batch, pages))
    folded = cut(fold_links(sightings))
    open_edges = F.col("to_page_id").isNull()
    return folded.filter(~open_edges).unionByName(backfill(folded.filter(open_edges), pages))


def live_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges seen in the latest fetch of their page; older ones are kept but not live."""
    latest = pages.select(
        F.col("page_id").alias("from_page_id"), F.col("fetched_at").alias("last_seen_at")
    )
    return links.join(latest, ["from_page_id", "last_seen_at"], "left_semi")


def delete_pages(
    pages: DataFrame, versions: DataFrame, links: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without some pages: their versions and out-links go, links to them stay
    but lose the target."""
    gone = ids.select("page_id").distinct()
    source = gone.withColumnRenamed("page_id", "from_page_id")
    target = gone.select(F.col("page_id").alias("to_page_id"), F.lit(True).alias("gone"))
    kept = links.join(source, "from_page_id", "left_anti")
    kept = skew_join(kept, target, ["to_page_id"], ["from_page_id"]).withColumn(
        "to_page_id", F.when(F.col("gone").isNull(), F.col("to_page_id"))
    )
    return (
        pages.join(gone, "page_id", "left_anti"),
        versions.join(gone, "page_id", "left_anti"),
        kept.select(*LINK_COLUMNS),
    )


def repeated_page_ids(pages: DataFrame) -> DataFrame:
    """Ids that several pages share, as hashed ids may at very many URLs; versions, links and
    index entries of such pages could not be told apart."""
    return pages.groupBy("page_id").agg(F.count("*").alias("n"), F.min("url").alias("first_url")).filter("n > 1")


def page_by_id(pages: DataFrame, page_id: int) -> DataFrame:
    """The stored copy of one page; empty when there is none."""
    return pages.filter(F.col("page_id") == page_id).select("page_id", "url", "title", "html")


def version_history(versions: DataFrame, page_ids: DataFrame | None = None) -> DataFrame:
    """Versions numbered by time within their page, optionally of some pages only.

    Numbers come in two steps, by month and then within it, so that a page with
    very many versions is not one task.
    """
    narrow = versions.select("page_id", "content_hash", "status_code", "fetched_at")
    if page_ids is not None:
        narrow = narrow.join(page_ids.select("page_id"), "page_id", "left_semi")
    narrow = narrow.withColumn("month", F.date_trunc("month", "fetched_at"))
    earlier = Window.partitionBy("page_id").orderBy("month").rowsBetween(
        Window.unboundedPreceding, -1
    )
    months = narrow.groupBy("page_id", "month").agg(F.count("*").alias("n"))
    months = months.select(
        "page_id", "month", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    in_month = Window.partitionBy("page_id", "month").orderBy("fetched_at", "content_hash")
    return (
        narrow.withColumn("number", F.row_number().over(in_month))
        .join(months, ["page_id", "month"])
        .withColumn("number", F.col("number") + F.col("before"))
        .select("page_id", "number", "content_hash", "status_code", "fetched_at")
    )


def content_changes(fetches: DataFrame, bucket: str = "day") -> DataFrame:
    """Each fetch with a flag: content differs from the previous fetch of its URL.

    The previous fetch is looked up within a time bucket; only the first fetch of
    a bucket looks at the bucket before. A URL with very many fetches is thus
    spread over its buckets. Null for the first fetch of a URL.
    """
    order = ["fetched_at", "content_hash"]
    rows = fetches.select("url", *order).withColumn("bucket", F.date_trunc(bucket, "fetched_at"))
    in_bucket = Window.partitionBy("url", "bucket").orderBy(*order)
    buckets = rows.groupBy("url", "bucket").agg(
        F.max_by("content_hash", F.struct(*order)).alias("final_hash")
    )
    by_bucket = Window.partitionBy("url").orderBy("bucket")
    buckets = buckets.select(
        "url", "bucket", F.lag("final_hash").over(by_bucket).alias("bucket_before")
    )
    return (
        rows.withColumn("before", F.lag("content_hash").over(in_bucket))
        .join(buckets, ["url", "bucket"])
        .select(
            "url",
            "fetched_at",
            "content_hash",
            (F.col("content_hash") != F.coalesce("before", "bucket_before")).alias("changed"),
        )
    )


def duplicate_groups(pages: DataFrame) -> DataFrame:
    """Contents stored under several URLs: number of pages and the one to keep."""
    return (
        pages.groupBy("content_hash")
        .agg(F.count("*").alias("n_pages"), F.min("page_id").alias("keeper"))
        .filter("n_pages > 1")
    )


def duplicate_pages(pages: DataFrame) -> DataFrame:
    """Every page of a duplicate group with the page to keep. Large groups are spread."""
    narrow = pages.select("page_id", "content_hash")
    return skew_join(narrow, duplicate_groups(pages), ["content_hash"], ["page_id"], "inner").select(
        "page_id", "content_hash", "n_pages", "keeper"
    )


def group_canonical(urls: DataFrame) -> DataFrame:
    """URL variants per canonical URL (input column ``url``): rows, spellings, first one."""
    spellings = (
        urls.select(canonical_url("url").alias("canonical"), F.col("url").alias("raw"))
        .filter(F.col("canonical").isNotNull())
        .groupBy("canonical", "raw")
        .agg(F.count("*").alias("n"))
    )
    return spellings.groupBy("canonical").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings"), F.min("raw").alias("first_spelling")
    )
