"""Inputs derived from the given tables, for the registered queries and the tests.

``FETCH_LOG`` and the other SQL texts are the same derivations for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.sources.tables import spread

DATE_BLOCKS = {
    1: '<div class="post_meta"><span class="post_date">2023-08-30</span></div>',
    2: '<div class="post_meta"><span class="post_date">Posted on: Aug 30th, 2023</span></div>',
    3: '<div class="post_meta"><time class="post_date" datetime="2023-08-30T10:00:00+02:00">x</time></div>',
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A given table for jobs that work hard on each row."""
    return spread(table(spark, sf_dir, name), key)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of fetches per page with links between pages, dates and errors."""
    pages = table(spark, sf_dir, "pages")
    n = pages.agg(F.count("*")).scalar()
    page = F.col("page_id")
    targets = pages.select(
        "page_id",
        F.posexplode(F.array((page * 7 + 1) % n, (page * page + 3) % n, page % 10)).alias("k", "target"),
    )
    urls = pages.select(F.col("page_id").alias("target"), F.col("url").alias("target_url"))
    links = (
        targets.join(urls, "target")
        .groupBy("page_id")
        .agg(*(F.max(F.when(F.col("k") == i, F.col("target_url"))).alias(f"u{i}") for i in range(3)))
    )
    rnd, kind = F.col("rnd"), page % 8
    block = (
        F.when((kind == 1) & (rnd == 0), DATE_BLOCKS[1])
        .when(kind == 2, DATE_BLOCKS[2])
        .when(kind == 3, DATE_BLOCKS[3])
        .otherwise("")
    )
    revision = (
        F.when((page % 3 == 0) & (rnd == 1), "<p>rev 1</p>")
        .when((page % 6 == 3) & (rnd == 2), "<p>rev 2</p>")
        .otherwise("")
    )
    anchors = F.format_string(
        '<p><a href="%s">l0</a> <a href="%s">l1</a> <a href="%s">l2</a></p>', "u0", "u1", "u2"
    )
    body = F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), block, anchors, revision))
    lost = page % 31 == 8
    return (
        pages.join(links, "page_id")
        .withColumn("rnd", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .select(
            "page_id",
            "url",
            "rnd",
            F.when(lost, None)
            .when((page % 17 == 3) & (rnd > 0), 404)
            .when(page % 23 == 5, 302)
            .when(page % 29 == 7, 500)
            .otherwise(200)
            .alias("status"),
            F.when(lost | (page % 13 == 6), None)
            .when(page % 19 == 4, "application/pdf")
            .otherwise("text/html; charset=utf-8")
            .alias("content_type"),
            F.when(~lost, body).alias("html"),
            F.when(lost, "timeout").alias("error"),
            F.timestamp_add(
                "SECOND", rnd * 86400 + page, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
            ).alias("fetched_at"),
        )
    )


FETCH_LOG = f"""
rounds AS (SELECT * FROM (VALUES (0),(1),(2)) AS t(rnd)),
n AS (SELECT count(*) AS n FROM pages),
lk AS (
  SELECT s.page_id,
         max(CASE WHEN k.k=0 THEN d.url END) AS u0,
         max(CASE WHEN k.k=1 THEN d.url END) AS u1,
         max(CASE WHEN k.k=2 THEN d.url END) AS u2
  FROM pages s CROSS JOIN n CROSS JOIN (VALUES (0),(1),(2)) AS k(k)
  JOIN pages d ON d.page_id =
       CASE WHEN k.k=0 THEN (s.page_id*7+1) % n.n
            WHEN k.k=1 THEN (s.page_id*s.page_id+3) % n.n
            ELSE s.page_id % 10 END
  GROUP BY s.page_id),
base AS (
  SELECT p.page_id, p.url, r.rnd,
    replace(p.html, '<article>', concat('<article>',
      CASE WHEN p.page_id % 8 = 1 AND r.rnd = 0 THEN '{DATE_BLOCKS[1]}'
           WHEN p.page_id % 8 = 2 THEN '{DATE_BLOCKS[2]}'
           WHEN p.page_id % 8 = 3 THEN '{DATE_BLOCKS[3]}'
           ELSE '' END,
      '<p><a href="', l.u0, '">l0</a> <a href="', l.u1, '">l1</a> <a href="', l.u2, '">l2</a></p>',
      CASE WHEN p.page_id % 3 = 0 AND r.rnd = 1 THEN '<p>rev 1</p>'
           WHEN p.page_id % 6 = 3 AND r.rnd = 2 THEN '<p>rev 2</p>'
           ELSE '' END)) AS html
  FROM pages p CROSS JOIN rounds r JOIN lk l ON l.page_id = p.page_id),
fetch_log AS (
  SELECT page_id, url, rnd,
    CASE WHEN page_id % 31 = 8 THEN NULL
         WHEN page_id % 17 = 3 AND rnd > 0 THEN 404
         WHEN page_id % 23 = 5 THEN 302
         WHEN page_id % 29 = 7 THEN 500 ELSE 200 END AS status,
    CASE WHEN page_id % 31 = 8 OR page_id % 13 = 6 THEN NULL
         WHEN page_id % 19 = 4 THEN 'application/pdf'
         ELSE 'text/html; charset=utf-8' END AS content_type,
    CASE WHEN page_id % 31 = 8 THEN NULL ELSE html END AS html,
    CASE WHEN page_id % 31 = 8 THEN 'timeout' END AS error,
    timestamp '2024-01-01 00:00:00' + to_seconds(rnd * 86400 + page_id) AS fetched_at
  FROM base)"""


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One robots.txt outcome per origin."""
    site = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    k = F.length("origin") % 6
    status = (
        F.when(k == 1, 404).when(k == 2, 403).when(k == 3, 503).when(k == 5, None).otherwise(200)
    )
    body = F.when(k == 0, "User-agent: *\nDisallow: /de/").when(
        k == 4,
        "User-agent: sitebot\nAllow: /en/1\nDisallow: /en/\n\nUser-agent: *\nDisallow: /",
    )
    origins = table(spark, sf_dir, "pages").select(site.alias("origin")).distinct()
    return origins.select("origin", status.cast("int").alias("status"), body.alias("body"))


ROBOTS = """
robots AS (
  SELECT origin,
    CASE WHEN k=1 THEN 404 WHEN k=2 THEN 403 WHEN k=3 THEN 503
         WHEN k=5 THEN NULL ELSE 200 END AS status,
    CASE WHEN k=0 THEN concat('User-agent: *',chr(10),'Disallow: /de/')
         WHEN k=4 THEN concat('User-agent: sitebot',chr(10),'Allow: /en/1',chr(10),
                              'Disallow: /en/',chr(10),chr(10),
                              'User-agent: *',chr(10),'Disallow: /') END AS body
  FROM (SELECT DISTINCT regexp_extract(url,'^(https?://[^/?#]+)',1) AS origin,
               length(regexp_extract(url,'^(https?://[^/?#]+)',1)) % 6 AS k
        FROM pages) t)"""


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three page URLs, and six seeds of no use: other schemes, no host, nothing."""
    pages = table(spark, sf_dir, "pages").filter("page_id < 3")
    useless = F.explode(F.array(F.concat(F.lit("mailto:"), "url"), F.replace("url", F.lit("http"), F.lit("ftp"))))
    useless = pages.filter("page_id < 2").select(useless.alias("url")).unionByName(pages.filter("page_id = 2").select(F.explode(F.array(F.lit("http://"), F.lit(None).cast("string"))).alias("url")))
    return pages.select("url").unionByName(useless)


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timestamps of the events table written in many notations."""
    ts, kind = F.col("ts"), F.col("event_id") % 12
    fmt = lambda p: F.date_format(ts, p)
    raw = (
        F.when(kind == 0, fmt("yyyy-MM-dd"))
        .when(kind == 1, fmt("yyyy/MM/dd"))
        .when(kind == 2, fmt("yyyy.MM.dd"))
        .when(kind == 3, fmt("yyyy-MM-dd HH:mm"))
        .when(kind == 4, fmt("yyyy-MM-dd HH:mm:ss"))
        .when(kind == 5, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(kind == 6, F.concat(fmt("yyyy-MM-dd'T'HH:mm"), F.lit("Z")))
        .when(kind == 7, F.concat(F.lit("Posted on: "), fmt("MMM dd, yyyy")))
        .when(kind == 8, fmt("MMMM dd, yyyy HH:mm"))
        .when(kind == 9, F.concat(F.lit(" Published "), fmt("MMM dd"), F.lit("th, "), fmt("yyyy")))
        .when(kind == 10, F.concat(fmt("yyyy-MM-dd HH:mm"), F.lit(" UTC")))
        .otherwise("some day")
    )
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
