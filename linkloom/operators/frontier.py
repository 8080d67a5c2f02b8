"""Seeds, host limits and reachability over the stored link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical_url, netloc
from linkloom.operators.robots import robots_allowed
from linkloom.operators.skew import skew_join
from linkloom.sources.lineage import cut

MAX_PAGES = 4_000
#: Hosts of the seeds that are broadcast.
MOST_BROADCAST = 1_000_000
_FOLD_LEVELS = 10  # levels after which the list of visited pages is written as one


def normalize_seeds(seeds: DataFrame) -> DataFrame:
    """Canonical distinct seed URLs; it is an error when none is usable."""
    usable = seeds.select(canonical_url("url").alias("url")).filter(F.col("url").isNotNull()).distinct()
    if usable.isEmpty():
        raise ValueError("no usable seed URL")
    return usable


def allowed_hosts(urls: DataFrame, seeds: DataFrame, same_host: bool = True) -> DataFrame:
    """URLs that may be visited: on a host of the seeds, unless that limit is off."""
    urls = urls.filter(F.col("url") != "")
    if not same_host:
        return urls
    hosts = cut(seeds.select(netloc("url").alias("host")).distinct())
    if hosts.count() <= MOST_BROADCAST:
        return urls.join(F.broadcast(hosts), netloc("url") == F.col("host"), "left_semi")
    # A host may have most of the URLs.
    found = skew_join(urls.withColumn("_host", netloc("url")), hosts.withColumnRenamed("host", "_host"), ["_host"], ["url"], "inner")
    return found.select(*urls.columns)


def unseen(candidates: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Candidates that were never queued before."""
    return candidates.join(seen.select(key), key, "left_anti")


def _leading(level: DataFrame, room: int) -> DataFrame:
    """First ``room`` rows by ``order``, however large ``room`` is.

    An id is a partition number and a row number in it, so the rows before a
    partition follow from the partition sizes: one small row per partition.
    """
    placed = level.withColumn("part", F.shiftrightunsigned("order", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    in_part = F.col("order") - F.shiftleft("part", 33)
    kept = placed.join(F.broadcast(sizes), "part").filter(F.col("skipped") + in_part < room)
    return cut(kept.select(*level.columns))


def reachable(
    links: DataFrame,
    pages: DataFrame,
    seeds: DataFrame,
    bound_rules: DataFrame | None = None,
    max_pages: int = MAX_PAGES,
    same_host: bool = True,
) -> DataFrame:
    """Pages a crawl from the seeds would store, with depth and discovery order.

    Breadth first: a page comes after its parent, siblings in the order of the
    parent and then of their URL. Only stored pages that the host limit and the
    robots rules allow count towards ``max_pages``, which cuts the last level.

    Hosts and rules do not change on the way, so they are applied once and the
    walk runs over the edges between open pages. Those lie by source page, so a
    level moves its own rows only. Each level goes to the checkpoint folder.
    """
    seeds = normalize_seeds(seeds)
    open_pages = allowed_hosts(pages.select("url", "page_id"), seeds, same_host)
    if bound_rules is not None:
        open_pages = robots_allowed(open_pages, bound_rules).filter("allowed").drop("allowed")
    open_pages = cut(open_pages)
    hrefs = links.select("from_page_id", F.col("to_url").alias("url")).distinct()
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = cut(
        skew_join(hrefs, open_pages, ["url"], ["from_page_id"], "inner").repartition(
            parts, "from_page_id"
        )
    )

    def ordered(queued: DataFrame, depth: int) -> DataFrame:
        # Ids follow the sorted rows; the checkpoint then fixes them.
        order = F.monotonically_increasing_id()
        level = queued.orderBy("parent", "url")
        return cut(level.select("url", "page_id", F.lit(depth).alias("depth"), order.alias("order")))

    first = open_pages.join(seeds, "url", "left_semi").withColumn("parent", F.lit(0))
    level, seen, found, depth = ordered(first, 0), None, 0, 0
    while True:
        size = level.count()
        if size > max_pages - found:
            level = _leading(level, max_pages - found)
        reached = level if depth == 0 else reached.unionByName(level)
        found += min(size, max_pages - found)
        if size == 0 or found >= max_pages:
            return reached
        visited = level.select("page_id")
        seen = visited if seen is None else seen.unionByName(visited)
        if depth % _FOLD_LEVELS == _FOLD_LEVELS - 1:
            seen, reached = cut(seen.coalesce(parts)), cut(reached.coalesce(parts))
        parents = level.select(F.col("page_id").alias("from_page_id"), F.col("order").alias("parent"))
        queued = (
            edges.join(parents, "from_page_id")
            .groupBy("url", "page_id")
            .agg(F.min("parent").alias("parent"))
        )
        depth += 1
        level = ordered(unseen(queued, seen, "page_id"), depth)
