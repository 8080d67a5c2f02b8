"""Registered queries on URLs, HTML, fetches, tables, links and robots rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.dates import display_date, normalize_post_date
from linkloom.functions.html import page_links, page_text, page_title, raw_post_date, strip_ignored
from linkloom.functions.urls import base_parts, canonical_url, netloc, origin, path_and_query, resolve_url
from linkloom.operators import fetches as fx
from linkloom.operators import links as lk
from linkloom.operators import store as st
from linkloom.operators.frontier import allowed_hosts, normalize_seeds, reachable, unseen
from linkloom.operators.rank import inbound_counts
from linkloom.operators.robots import agent_rules, robots_allowed, robots_rules
from linkloom.sources.lineage import cut, shared_folder
from linkloom.sources.tables import SCHEMAS, empty, read_table, stream_fetches, write_table
from linkloom.streaming.sightings import url_sightings
from linkloom.streaming.ingest import State, current_state, first_seen, start_ingest, stream_throughput
from suite import fixtures as fixture
from suite import sql

table = fixture.table


def text(ts: str):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(fx.parse_fetches(fixture.fetch_log(spark, sf_dir)))


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parsed fetches, pages, links) after all rounds."""
    parsed = parsed_log(spark, sf_dir)
    pages = cut(st.upsert_pages(empty(spark, "pages"), parsed))
    return parsed, pages, cut(st.upsert_links(empty(spark, "links"), parsed, pages))


# --- URLs -----------------------------------------------------------------


def canonical_urls(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("page_id", canonical_url("url").alias("url"))
    return urls.select("page_id", "url", netloc("url").alias("host"), origin("url").alias("origin"),
                       path_and_query("url").alias("path"))


def messy_urls(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.upper(F.substring_index("url", "/", 3)), F.lit(":"),
                   F.when(F.col("url").startswith("https"), "443").otherwise("80"),
                   F.lit("//a///b;v=1/c;d=2?q=//x#y"))
    kinds = F.array(raw, F.concat(F.lit("ftp:"), F.col("url")), F.concat("url", F.lit("?")), F.lit("no-scheme"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(kinds).alias("k", "raw")).select(
        "page_id", "k", canonical_url("raw").alias("url"))


SITE = "regexp_extract(u, '^[^:]+://[^/]+')"
FOLDER = "regexp_replace(regexp_extract(u, '^[^?]+'), '[^/]*$', '')"


def resolved_links(spark, sf_dir):
    hrefs = ["/Root/./a//b", "rel?x=1", "../up", "?z=1", "//O.org:443/x", "#f", "mailto:a@b", "./", "x/../y"]
    pages = table(spark, sf_dir, "pages").select("page_id", canonical_url("url").alias("u"))
    return pages.select("page_id", "u", F.posexplode(F.array(*map(F.lit, hrefs))).alias("k", "href")).select(
        "page_id", "k", canonical_url(resolve_url(base_parts("u"), "href")).alias("url"))


RESOLVED_SQL = f"""
WITH p AS (SELECT page_id, {sql.canonical("url")} AS u FROM pages),
k AS (SELECT unnest(range(9)) AS k)
SELECT page_id, CAST(k AS INTEGER) AS k, CASE k
  WHEN 0 THEN {SITE} || '/Root/a/b' WHEN 1 THEN {FOLDER} || 'rel?x=1'
  WHEN 2 THEN CASE WHEN {FOLDER} = {SITE} || '/' THEN {FOLDER} ELSE regexp_replace({FOLDER}, '[^/]+/$', '') END || 'up'
  WHEN 3 THEN regexp_extract(u, '^[^?]+') || '?z=1'
  WHEN 4 THEN split_part(u, ':', 1) || CASE WHEN u LIKE 'https%' THEN '://o.org/x' ELSE '://o.org:443/x' END
  WHEN 5 THEN u WHEN 7 THEN {FOLDER} WHEN 8 THEN {FOLDER} || 'y' END AS url
FROM p CROSS JOIN k"""


# --- HTML and dates -------------------------------------------------------


def page_features(spark, sf_dir):
    s = strip_ignored("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", page_title(s).alias("title"), page_text(s).alias("text"), F.sha2("html", 256).alias("content_hash")
    )


def page_out_links(spark, sf_dir):
    s = strip_ignored("html")
    pages = table(spark, sf_dir, "pages").select("page_id", page_links(s, canonical_url("url")).alias("l"))
    return pages.select("page_id", F.posexplode("l").alias("position", "to_url"))


OUT_LINKS_SQL = f"""
WITH {sql.PAGE_TEXTS}, src AS (SELECT page_id, url, s, 0 AS fetched_at FROM docs), {sql.hrefs("src")}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS position, to_url
FROM firsts"""


_SITE = "regexp_extract(url, '^https?://[^/?#]+')"
_ODD_ANCHORS = (
    '<a title="a > b" href="', "/x?p=1\">1</a><a href='/y'>2</a><a title=\"see href=bad\" href=\"/z?id=",
    '">3</a><a data-href="/no" HREF = /w>4</a><a href="/y">5</a>',
)


def odd_links(spark, sf_dir):
    """Anchors with brackets and names of attributes within values, single quotes and none."""
    site = F.regexp_extract("url", "^https?://[^/?#]+", 0)
    one, two, three = map(F.lit, _ODD_ANCHORS)
    html = F.concat(one, site, two, F.col("page_id").cast("string"), three)
    pages = table(spark, sf_dir, "pages").select("page_id", page_links(html, canonical_url("url")).alias("l"))
    return pages.select("page_id", F.posexplode("l").alias("position", "to_url"))


ODD_LINKS_SQL = f"""
WITH p AS (SELECT page_id, lower({_SITE}) AS site FROM pages)
SELECT page_id, CAST(k AS INTEGER) AS position,
  site || CASE k WHEN 0 THEN '/x?p=1' WHEN 1 THEN '/y' WHEN 2 THEN '/z?id=' || page_id ELSE '/w' END AS to_url
FROM p CROSS JOIN range(4) AS r(k)"""


def odd_dates(spark, sf_dir):
    """Dates within nested elements of one name, behind attributes with brackets."""
    day = F.format_string("%02d", 1 + F.col("page_id") % 28)
    html = F.concat(
        F.lit("<div title='a>b' class=\"x post_meta y\"><div>n</div><span data-class=post_date>no</span>"
              "<span title=\"2 > 1\" class='post_date'><span>Aug</span> "), day, F.lit(", 2023</span> z</div>"))  # fmt: skip
    return table(spark, sf_dir, "pages").select(
        "page_id", normalize_post_date(raw_post_date(strip_ignored(html)))["post_date_iso"].alias("post_date_iso"))


def post_dates(spark, sf_dir):
    return fx.parse_fetches(fixture.fetch_log(spark, sf_dir)).select(
        "page_id", "rnd", text("post_date").alias("post_date"), "post_date_iso"
    )


def missing_dates(spark, sf_dir):
    return fx.missing_dates(fx.parse_fetches(fixture.fetch_log(spark, sf_dir)))


def date_notations(spark, sf_dir):
    dates = fixture.date_texts(spark, sf_dir).select("event_id", normalize_post_date("raw").alias("d"))
    return dates.select("event_id", text("d.post_date").alias("post_date"), F.col("d.post_date_iso"),
                        display_date("d.post_date_iso").alias("shown"))


_EVENT_DATES = "CASE event_id % 12 " + " ".join(
    f"WHEN {i} THEN {e}"
    for i, e in enumerate(
        [*(f"strftime(ts, '{f}')" for f in ("%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S")),
         "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'", "strftime(ts, '%Y-%m-%dT%H:%M') || 'Z'",
         "'Posted on: ' || strftime(ts, '%b %d, %Y')", "strftime(ts, '%B %d, %Y %H:%M')",
         "' Published ' || strftime(ts, '%b %dth, %Y')", "strftime(ts, '%Y-%m-%d %H:%M') || ' UTC'"]
    )
) + " ELSE 'some day' END"
_D = sql.parsed_date("raw")
DATES_SQL = f"""
WITH e AS (SELECT event_id, {_EVENT_DATES} AS raw FROM events),
d AS (SELECT event_id, {_D[0]} AS ts, {_D[1]} AS iso FROM e)
SELECT event_id, {sql.stamp("ts")} AS post_date, iso AS post_date_iso,
  coalesce(strftime(try_strptime(left(iso, 19), '%Y-%m-%dT%H:%M:%S'), '%b %d, %Y %H:%M'), '') AS shown
FROM d"""


# --- Fetch log ------------------------------------------------------------


def fetch_outcomes(spark, sf_dir):
    return fx.clean_fetches(fixture.fetch_log(spark, sf_dir)).select(
        "page_id", "rnd", "url", "status", "drop_reason", F.sha2("html", 256).alias("content_hash"))


def large_fetches(spark, sf_dir):
    """Outcomes under a body limit that some pages exceed."""
    return fx.drop_reasons(fixture.fetch_log(spark, sf_dir), max_bytes=3000)


def fetch_counters(spark, sf_dir):
    return fx.fetch_counters(fixture.fetch_log(spark, sf_dir))


def drop_reasons(spark, sf_dir):
    return fx.drop_reasons(fixture.fetch_log(spark, sf_dir))


def fetch_throughput(spark, sf_dir):
    rates = fx.fetch_throughput(fx.kept_fetches(fixture.fetch_log(spark, sf_dir)), delay=0.19)
    return rates.select(text("window_start").alias("window_start"), "n", "running_n",
                        F.round("percent_of_limit", 4).alias("percent"), "slow")


THROUGHPUT_SQL = f"""
WITH {sql.CLEANED},
w AS (SELECT time_bucket(INTERVAL 60 SECOND, fetched_at) AS t, count(*) AS n FROM kept GROUP BY 1),
r AS (SELECT t, n, sum(n) OVER (ORDER BY t) AS running_n, min(t) OVER () AS started FROM w),
p AS (SELECT *, 100 * 0.19 * running_n / (epoch(t) - epoch(started) + 60) AS percent FROM r)
SELECT {sql.stamp("t")} AS window_start, n, CAST(running_n AS BIGINT) AS running_n, round(percent, 4) AS percent,
       percent < 80 AS slow FROM p"""


def content_changes(spark, sf_dir):
    return st.content_changes(parsed_log(spark, sf_dir)).select(
        "url", text("fetched_at").alias("fetched_at"), "content_hash", "changed")


# --- Tables ---------------------------------------------------------------


def _shown_pages(pages):
    return pages.select("page_id", "url", "title", "text", "content_hash", "status_code",
                        text("fetched_at").alias("fetched_at"), "post_date_iso")


PAGES_SQL = f"""
WITH {sql.STORED}
SELECT page_id, url, title, text, content_hash, status_code, {sql.stamp("fetched_at")} AS fetched_at, post_date_iso
FROM stored"""


def page_upsert(spark, sf_dir):
    """Rounds 0 and 1 stored, round 2 as a second batch."""
    parsed = parsed_log(spark, sf_dir)
    before = cut(st.upsert_pages(empty(spark, "pages"), parsed.filter("rnd < 2")))
    return _shown_pages(st.upsert_pages(before, parsed.filter("rnd = 2")))


def upsert_report(spark, sf_dir):
    parsed = parsed_log(spark, sf_dir)
    before = empty(spark, "pages")
    reports = []
    for rnd in range(3):
        batch = parsed.filter(F.col("rnd") == rnd)
        reports.append(st.upsert_report(before, batch).withColumn("rnd", F.lit(rnd)))
        before = cut(st.upsert_pages(before, batch))
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


def version_history(spark, sf_dir):
    parsed = parsed_log(spark, sf_dir)
    pages = cut(st.upsert_pages(empty(spark, "pages"), parsed))
    first = st.append_versions(empty(spark, "page_versions"), parsed.filter("rnd = 0"), pages)
    versions = st.append_versions(cut(first), parsed.filter("rnd > 0"), pages)
    return st.version_history(versions).select(
        "page_id", "number", "content_hash", "status_code", text("fetched_at").alias("fetched_at"))


VERSIONS_SQL = f"""
WITH {sql.PARSED},
ids AS (SELECT url, min(page_id) AS id FROM parsed GROUP BY url),
v AS (SELECT id AS page_id, content_hash, min(fetched_at) AS seen_at, arg_min(status, fetched_at) AS status_code
      FROM parsed JOIN ids USING (url) GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY seen_at, content_hash) AS number, content_hash,
       status_code, {sql.stamp("seen_at")} AS fetched_at FROM v"""


def _shown_links(links):
    return links.select("from_page_id", "to_url", "to_page_id", text("first_seen_at").alias("first_seen_at"),
                        text("last_seen_at").alias("last_seen_at"))


_LINK_COLUMNS = (
    f"from_page_id, to_url, to_page_id, {sql.stamp('first_seen_at')} AS first_seen_at,"
    f" {sql.stamp('last_seen_at')} AS last_seen_at"
)


def link_upsert(spark, sf_dir):
    parsed, pages, _ = stored(spark, sf_dir)
    before = cut(st.upsert_links(empty(spark, "links"), parsed.filter("rnd = 1"), pages))
    return _shown_links(st.upsert_links(before, parsed, pages))


def live_links(spark, sf_dir):
    _, pages, links = stored(spark, sf_dir)
    return _shown_links(st.live_links(links, pages))


def _after_delete(spark, sf_dir):
    parsed, pages, links = stored(spark, sf_dir)
    versions = st.append_versions(empty(spark, "page_versions"), parsed, pages)
    return st.delete_pages(pages, versions, links, pages.filter("page_id % 10 = 3"))


def delete_links(spark, sf_dir):
    return _shown_links(_after_delete(spark, sf_dir)[2])


def delete_versions(spark, sf_dir):
    return _after_delete(spark, sf_dir)[1].groupBy("page_id").agg(F.count("*").alias("n_versions"))


def page_copy(spark, sf_dir):
    _, pages, _ = stored(spark, sf_dir)
    last = pages.agg(F.max("page_id")).scalar()
    return st.page_by_id(pages, last).select("page_id", "url", "title", F.sha2("html", 256).alias("content_hash"))


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.sha2("text", 256).alias("content_hash"))


def duplicate_groups(spark, sf_dir):
    return st.duplicate_groups(_documents(spark, sf_dir))


def duplicate_pages(spark, sf_dir):
    return st.duplicate_pages(_documents(spark, sf_dir))


def canonical_groups(spark, sf_dir):
    return st.group_canonical(fixture.fetch_log(spark, sf_dir).select(
        F.explode(F.array("url", F.concat("url", F.lit("#again")))).alias("url")))


# --- Links ----------------------------------------------------------------


def link_edges(spark, sf_dir):
    parsed, pages, _ = stored(spark, sf_dir)
    rounds = [lk.link_edges(parsed.filter(F.col("rnd") == rnd), pages).withColumn("rnd", F.lit(rnd)) for rnd in range(3)]
    return rounds[0].unionByName(rounds[1]).unionByName(rounds[2])


def inbound(spark, sf_dir):
    return inbound_counts(stored(spark, sf_dir)[2])


def outbound_top(spark, sf_dir):
    _, pages, links = stored(spark, sf_dir)
    return lk.outbound_top(links, pages)


def unresolved(spark, sf_dir):
    return lk.unresolved(stored(spark, sf_dir)[2])


# --- Hosts, robots, reachability ------------------------------------------

AGENT = "sitebot/1.0 (+https://example.org)"


def host_allow_list(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("page_id", canonical_url("url").alias("url"))
    return allowed_hosts(urls, normalize_seeds(fixture.seeds(spark, sf_dir)))


def frontier_unseen(spark, sf_dir):
    _, pages, links = stored(spark, sf_dir)
    return unseen(links.select(F.col("to_url").alias("url")).distinct(), pages)


def robots_rule_table(spark, sf_dir):
    rules = robots_rules(fixture.robots(spark, sf_dir))
    return rules.select("origin", "group_no", F.array_join("agents", ",").alias("agents"), "allow", "path_prefix")


ROBOTS_RULES_SQL = f"""
WITH {sql.ROBOTS}
SELECT origin, CAST(g AS BIGINT) AS group_no, agents, allow, path_prefix FROM robots JOIN (VALUES
  ('/de/', 1, '*', false, '/de/'), ('/en/', 1, 'sitebot', true, '/en/1'), ('/en/', 1, 'sitebot', false, '/en/'),
  ('/en/', 2, '*', false, '/')) AS r(mark, g, agents, allow, path_prefix) ON contains(body, mark)
WHERE status = 200"""


def robots_check(spark, sf_dir):
    sites = fixture.robots(spark, sf_dir)
    urls = table(spark, sf_dir, "pages").select("page_id", F.col("url"))
    named = robots_allowed(urls, agent_rules(sites, AGENT)).withColumn("agent", F.lit("sitebot"))
    other = robots_allowed(urls, agent_rules(sites, "other/1.0")).withColumn("agent", F.lit("other"))
    return named.unionByName(other).select("page_id", "agent", "allowed")


def robots_longest(spark, sf_dir):
    """The longest matching rule counts: files with their rules in the opposite order."""
    body = F.replace("body", F.lit("Allow: /en/1\nDisallow: /en/\n"), F.lit("Disallow: /en/\nAllow: /en/1\n"))
    sites = fixture.robots(spark, sf_dir).withColumn("body", body)
    urls = table(spark, sf_dir, "pages").select("page_id", F.col("url"))
    named, other = (
        robots_allowed(urls, agent_rules(sites, agent), match="longest").withColumn("agent", F.lit(name)) for agent, name in ((AGENT, "sitebot"), ("other/1.0", "other"))
    )
    return named.unionByName(other).select("page_id", "agent", "allowed")


_VERDICT = (
    "CASE WHEN status IS NULL OR status = 404 THEN true WHEN status IN (403, 503) THEN false"
    " WHEN contains(body, '/de/') THEN NOT starts_with(path, '/de/')"
    " WHEN body IS NULL THEN true WHEN agent = 'other' THEN false"
    " ELSE starts_with(path, '/en/1') OR NOT starts_with(path, '/en/') END"
)
ROBOTS_CHECK_SQL = f"""
WITH {sql.ROBOTS},
u AS (SELECT page_id, regexp_extract(url, '^[^:]+://[^/]+') AS origin, regexp_replace(url, '^[^:]+://[^/]+', '') AS path,
             unnest(['sitebot', 'other']) AS agent FROM pages)
SELECT page_id, agent, {_VERDICT} AS allowed FROM u JOIN robots USING (origin)"""


def reachable_pages(spark, sf_dir):
    _, pages, links = stored(spark, sf_dir)
    rules = agent_rules(fixture.robots(spark, sf_dir), AGENT)
    found = reachable(links, pages, fixture.seeds(spark, sf_dir), rules, max_pages=10**9, same_host=False)
    return found.select("page_id", "url", "depth")


def reachable_same_host(spark, sf_dir):
    """The walk on the hosts of the seeds."""
    _, pages, links = stored(spark, sf_dir)
    found = reachable(links, pages, fixture.seeds(spark, sf_dir), None, max_pages=10**9, same_host=True)
    return found.select("page_id", "url", "depth")


def reachable_some(spark, sf_dir):
    """A walk that ends within its second level."""
    _, pages, links = stored(spark, sf_dir)
    return reachable(links, pages, fixture.seeds(spark, sf_dir), None, max_pages=5, same_host=False).select("page_id", "depth")


REACHABLE_SQL = f"""
WITH RECURSIVE {sql.LINKS}, {sql.ROBOTS},
open_pages AS (
  SELECT page_id, url FROM (
    SELECT page_id, url, status, body, 'sitebot' AS agent, regexp_replace(url, '^[^:]+://[^/]+', '') AS path
    FROM stored LEFT JOIN robots ON origin = regexp_extract(url, '^[^:]+://[^/]+'))
  WHERE {_VERDICT}),
walk(page_id, depth) USING KEY (page_id) AS (
  SELECT page_id, 0 FROM open_pages WHERE url IN (SELECT {sql.canonical("url")} FROM pages WHERE page_id < 3)
  UNION
  SELECT o.page_id, min(w.depth) + 1 FROM walk w JOIN links l ON l.from_page_id = w.page_id
    JOIN open_pages o ON o.page_id = l.to_page_id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.page_id = o.page_id)
  GROUP BY o.page_id)
SELECT page_id, url, CAST(depth AS INTEGER) AS depth FROM walk JOIN open_pages USING (page_id)"""


REACHABLE_HOST_SQL = f"""
WITH RECURSIVE {sql.LINKS},
seed AS (SELECT {sql.canonical("url")} AS url FROM pages WHERE page_id < 3),
open_pages AS (SELECT page_id, url FROM stored WHERE split_part(url, '/', 3) IN (SELECT split_part(url, '/', 3) FROM seed)),
walk(page_id, depth) USING KEY (page_id) AS (
  SELECT page_id, 0 FROM open_pages WHERE url IN (SELECT url FROM seed)
  UNION
  SELECT o.page_id, min(w.depth) + 1 FROM walk w JOIN links l ON l.from_page_id = w.page_id
    JOIN open_pages o ON o.page_id = l.to_page_id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.page_id = o.page_id)
  GROUP BY o.page_id)
SELECT page_id, url, CAST(depth AS INTEGER) AS depth FROM walk JOIN open_pages USING (page_id)"""

# Seeds in the order of their URLs, then the pages they link to by (parent, URL), five in all.
REACHABLE_SOME_SQL = f"""
WITH {sql.LINKS},
first AS (SELECT page_id, url, row_number() OVER (ORDER BY url) AS place FROM stored
          WHERE url IN (SELECT {sql.canonical("url")} FROM pages WHERE page_id < 3)),
second AS (SELECT s.page_id, s.url, min(f.place) AS parent FROM first f JOIN links l ON l.from_page_id = f.page_id
           JOIN stored s ON s.page_id = l.to_page_id WHERE s.page_id NOT IN (SELECT page_id FROM first) GROUP BY ALL),
ranked AS (SELECT page_id, 0 AS depth, place AS a, '' AS b FROM first UNION ALL SELECT page_id, 1, parent, url FROM second)
SELECT page_id, CAST(depth AS INTEGER) AS depth FROM ranked ORDER BY depth, a, b LIMIT 5"""


# --- Streaming ------------------------------------------------------------


def ingested(spark, sf_dir, rounds=(0, 1, 2), **options) -> tuple[str, str]:
    """The fetch log written as stream files round by round and ingested; (log folder, state folder)."""
    folder = shared_folder(spark, "stream")
    columns = [c.split()[0] for c in SCHEMAS["fetch_log"].split(", ")]
    log = cut(fixture.fetch_log(spark, sf_dir))
    for rnd in rounds:
        log.filter(F.col("rnd") == rnd).select(*columns).write.mode("append").parquet(f"{folder}/log")
        stream = stream_fetches(spark, f"{folder}/log")
        start_ingest(stream, f"{folder}/state", f"{folder}/checkpoint", stem=False, once=True, **options).awaitTermination()
    return f"{folder}/log", f"{folder}/state"


def streamed_pages(spark, sf_dir):
    """Pages of a stream of three micro-batches."""
    return _shown_pages(State(spark, ingested(spark, sf_dir)[1]).pages()).drop("page_id")


def streamed_late_pages(spark, sf_dir):
    """The same pages when the last round comes first."""
    return _shown_pages(State(spark, ingested(spark, sf_dir, (2, 0, 1))[1]).pages()).drop("page_id")


def streamed_compacted_pages(spark, sf_dir):
    """The same pages when the state is folded after every batch."""
    _, folder = ingested(spark, sf_dir, compact_every=1)
    return _shown_pages(current_state(spark, folder).pages()).drop("page_id")


def streamed_versions(spark, sf_dir):
    state = State(spark, ingested(spark, sf_dir)[1])
    urls = state.pages().select("page_id", "url")
    return st.version_history(state.versions()).join(urls, "page_id").select(
        "url", "number", "content_hash", "status_code", text("fetched_at").alias("fetched_at"))


def streamed_links(spark, sf_dir):
    state = State(spark, ingested(spark, sf_dir)[1])
    urls = state.pages().select("page_id", F.col("url").alias("from_url"))
    links = state.links().join(urls.withColumnRenamed("page_id", "from_page_id"), "from_page_id")
    return links.select("from_url", "to_url", F.col("to_page_id").isNotNull().alias("resolved"),
                        text("first_seen_at").alias("first_seen_at"), text("last_seen_at").alias("last_seen_at"))


def streamed_index(spark, sf_dir):
    """Words of the stream's index with the pages and places they occur in."""
    rows = State(spark, ingested(spark, sf_dir)[1]).index().postings
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"))


STREAMED_INDEX_SQL = f"""
WITH {sql.STORED}, docs AS (SELECT * FROM stored), {sql.TOKENS},
p AS (SELECT token, page_id, col, count(*) AS tf FROM tok GROUP BY ALL)
SELECT token, count(*) AS n, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY token"""


def _to_files(frame: DataFrame, spark: SparkSession) -> DataFrame:
    """All rows that a stream gives, by way of a file sink."""
    folder = shared_folder(spark, "sink")
    writer = frame.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/rows")


def first_seen_urls(spark, sf_dir):
    """Distinct URLs of a stream that spells each in two ways."""
    log, _ = ingested(spark, sf_dir, (0,))
    spelled = F.explode(F.array("url", F.concat("url", F.lit("#x"))))
    stream = stream_fetches(spark, log, 1).withColumn("url", spelled)
    return _to_files(first_seen(stream, lateness=None).select("url"), spark)


def streamed_sightings(spark, sf_dir):
    """First fetch, last fetch and late fetches of each URL when the last round comes second."""
    folder = shared_folder(spark, "sightings")
    columns = [c.split()[0] for c in SCHEMAS["fetch_log"].split(", ")]
    log = cut(fixture.fetch_log(spark, sf_dir))
    for rnd in (0, 2, 1):
        log.filter(F.col("rnd") == rnd).select(*columns).write.mode("append").parquet(f"{folder}/log")
        seen = url_sightings(stream_fetches(spark, f"{folder}/log"))
        writer = seen.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    rows = spark.read.schema(seen.schema).parquet(f"{folder}/rows")
    return rows.groupBy("url").agg(
        F.count("*").alias("n_batches"), F.count_if(F.col("event") == "new").alias("n_new"), text(F.min("first_seen")).alias("first_seen"),
        text(F.max("last_fetch")).alias("last_fetch"), F.sum("n_fetches").alias("n_fetches"), F.sum("n_late").alias("n_late"))


SIGHTINGS_SQL = f"""
WITH {fixture.FETCH_LOG}, f AS (SELECT *, {sql.canonical("url")} AS canonical FROM fetch_log)
SELECT canonical AS url, count(DISTINCT rnd) AS n_batches, CAST(1 AS BIGINT) AS n_new, {sql.stamp("min(fetched_at)")} AS first_seen,
  {sql.stamp("max(fetched_at)")} AS last_fetch, count(*) AS n_fetches, count(*) FILTER (rnd = 1) AS n_late
FROM f WHERE canonical IS NOT NULL GROUP BY 1"""


def streamed_windows(spark, sf_dir):
    """Kept fetches of the minutes that are closed when the stream ends."""
    log, _ = ingested(spark, sf_dir)
    rows = _to_files(stream_throughput(stream_fetches(spark, log), 60), spark)
    return rows.select(text("window_start").alias("window_start"), "n")


def _written(frame: DataFrame, name: str) -> DataFrame:
    """A table written to files and read back."""
    folder = shared_folder(frame.sparkSession, name)
    write_table(frame, folder)
    return read_table(frame.sparkSession, name, folder)


def stored_versions(spark, sf_dir):
    parsed = parsed_log(spark, sf_dir)
    pages = cut(st.upsert_pages(empty(spark, "pages"), parsed))
    versions = _written(st.append_versions(empty(spark, "page_versions"), parsed, pages), "page_versions")
    return st.version_history(versions).select(
        "page_id", "number", "content_hash", "status_code", text("fetched_at").alias("fetched_at"))


def stored_links(spark, sf_dir):
    return _shown_links(_written(stored(spark, sf_dir)[2], "links"))


def delete_remaining(spark, sf_dir):
    """Pages that stay after a deletion."""
    return _shown_pages(_after_delete(spark, sf_dir)[0])


QUERIES = {
    "canonical_urls": (canonical_urls, f"""
        WITH c AS (SELECT page_id, {sql.canonical("url")} AS url FROM pages)
        SELECT page_id, url, regexp_extract(url, '^[^:]+://([^/]+)', 1) AS host,
          regexp_extract(url, '^[^:]+://[^/]+') AS origin, regexp_replace(url, '^[^:]+://[^/]+', '') AS path FROM c"""),
    "messy_urls": (messy_urls, f"""
        WITH k AS (SELECT unnest(range(4)) AS k)
        SELECT page_id, CAST(k AS INTEGER) AS k, CASE k
          WHEN 0 THEN lower(regexp_extract(url, '^[^:]+://[^/]+')) || '/a/b;v=1/c?q=//x'
          WHEN 2 THEN {sql.canonical("concat(url, '?')")} END AS url FROM pages CROSS JOIN k"""),
    "resolved_links": (resolved_links, RESOLVED_SQL),
    "canonical_groups": (canonical_groups, f"""
        WITH {sql.FETCH_LOG}, u AS (SELECT unnest([url, url || '#again']) AS raw FROM fetch_log)
        SELECT {sql.canonical("raw")} AS canonical, count(*) AS n_rows, count(DISTINCT raw) AS n_spellings,
          min(raw) AS first_spelling FROM u GROUP BY 1"""),
    "page_features": (page_features, f"WITH {sql.PAGE_TEXTS} SELECT page_id, title, text, sha256(html) AS content_hash FROM docs"),
    "page_out_links": (page_out_links, OUT_LINKS_SQL),
    "odd_links": (odd_links, ODD_LINKS_SQL),
    "odd_dates": (odd_dates, """
        SELECT page_id, strftime(make_date(2023, 8, CAST(1 + page_id % 28 AS INTEGER)), '%Y-%m-%dT00:00:00+00:00') AS post_date_iso FROM pages"""),
    "post_dates": (post_dates, f"WITH {sql.PARSED} SELECT page_id, rnd, {sql.stamp('post_date')} AS post_date, post_date_iso FROM parsed"),
    "missing_dates": (missing_dates, f"""WITH {sql.PARSED}
        SELECT regexp_extract(url, '^[^:]+://([^/]+)', 1) AS host, count(*) AS n FROM parsed WHERE post_date IS NULL GROUP BY 1"""),
    "date_notations": (date_notations, DATES_SQL),
    "fetch_outcomes": (fetch_outcomes, f"""WITH {sql.CLEANED}
        SELECT page_id, rnd, url, status, drop_reason, CASE WHEN drop_reason IS NULL THEN sha256(html) END AS content_hash FROM cleaned"""),
    "fetch_counters": (fetch_counters, f"""WITH {sql.CLEANED}
        SELECT count(DISTINCT url) AS seen, count(*) AS fetched, count(*) FILTER (drop_reason IS NULL) AS to_store,
          count(DISTINCT url) FILTER (drop_reason IS NULL) AS pages FROM cleaned"""),
    "drop_reasons": (drop_reasons, f"WITH {sql.CLEANED} SELECT coalesce(drop_reason, 'stored') AS outcome, count(*) AS n FROM cleaned GROUP BY 1"),
    "large_fetches": (large_fetches, f"""WITH {sql.CLEANED.replace("> 2000000", "> 3000")}
        SELECT coalesce(drop_reason, 'stored') AS outcome, count(*) AS n FROM cleaned GROUP BY 1"""),
    "fetch_throughput": (fetch_throughput, THROUGHPUT_SQL),
    "content_changes": (content_changes, f"""WITH {sql.CLEANED}
        SELECT url, {sql.stamp("fetched_at")} AS fetched_at, content_hash,
          content_hash <> lag(content_hash) OVER (PARTITION BY url ORDER BY fetched_at) AS changed FROM kept"""),
    "page_upsert": (page_upsert, PAGES_SQL),
    "upsert_report": (upsert_report, f"""WITH {sql.CLEANED},
        b AS (SELECT url, rnd, arg_max(content_hash, fetched_at) AS h FROM kept GROUP BY ALL),
        c AS (SELECT rnd, h, lag(h) OVER (PARTITION BY url ORDER BY rnd) AS a FROM b)
        SELECT CASE WHEN a IS NULL THEN 'new' WHEN a = h THEN 'refreshed' ELSE 'changed' END AS change,
          count(*) AS n, CAST(rnd AS INTEGER) AS rnd FROM c GROUP BY ALL"""),
    "version_history": (version_history, VERSIONS_SQL),
    "link_upsert": (link_upsert, f"WITH {sql.LINKS} SELECT {_LINK_COLUMNS} FROM links"),
    "live_links": (live_links, f"""WITH {sql.LINKS}
        SELECT {_LINK_COLUMNS} FROM links JOIN stored ON page_id = from_page_id AND fetched_at = last_seen_at"""),
    "delete_links": (delete_links, f"""WITH {sql.LINKS}, cut AS (
          SELECT from_page_id, to_url, CASE WHEN to_page_id % 10 <> 3 THEN to_page_id END AS to_page_id,
            first_seen_at, last_seen_at FROM links WHERE from_page_id % 10 <> 3)
        SELECT {_LINK_COLUMNS} FROM cut"""),
    "delete_versions": (delete_versions, f"""WITH {sql.STORED}
        SELECT id AS page_id, count(DISTINCT content_hash) AS n_versions FROM parsed JOIN ids USING (url)
        WHERE id % 10 <> 3 GROUP BY 1"""),
    "page_copy": (page_copy, f"""WITH {sql.STORED}
        SELECT page_id, url, title, content_hash FROM stored WHERE page_id = (SELECT max(page_id) FROM stored)"""),
    "duplicate_groups": (duplicate_groups, """
        SELECT sha256(text) AS content_hash, count(*) AS n_pages, min(doc_id) AS keeper FROM documents GROUP BY 1 HAVING count(*) > 1"""),
    "duplicate_pages": (duplicate_pages, """
        SELECT doc_id AS page_id, sha256(text) AS content_hash, count(*) OVER (PARTITION BY text) AS n_pages,
          min(doc_id) OVER (PARTITION BY text) AS keeper FROM documents QUALIFY n_pages > 1"""),
    "link_edges": (link_edges, f"""WITH {sql.LINKS}, o AS (
          SELECT f.*, p.rnd FROM firsts f JOIN parsed p ON p.page_id = f.page_id AND p.fetched_at = f.fetched_at)
        SELECT page_id AS from_page_id, CAST(row_number() OVER (PARTITION BY page_id, rnd ORDER BY pos) - 1 AS INTEGER) AS position,
          to_url, id AS to_page_id, CAST(rnd AS INTEGER) AS rnd FROM o LEFT JOIN ids ON ids.url = o.to_url"""),
    "inbound_counts": (inbound, f"""WITH {sql.LINKS}
        SELECT to_page_id AS page_id, count(DISTINCT from_page_id) AS inbound FROM links WHERE to_page_id IS NOT NULL GROUP BY 1"""),
    "outbound_top": (outbound_top, f"""WITH {sql.LINKS},
        t AS (SELECT from_page_id AS page_id, count(*) AS outbound FROM links GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
        SELECT page_id, url, outbound FROM t JOIN stored USING (page_id)"""),
    "unresolved_targets": (unresolved, f"WITH {sql.LINKS} SELECT to_url, count(*) AS n_links FROM links WHERE to_page_id IS NULL GROUP BY 1"),
    "host_allow_list": (host_allow_list, f"""
        WITH c AS (SELECT page_id, {sql.canonical("url")} AS url FROM pages), h AS (SELECT *, split_part(url, '/', 3) AS host FROM c)
        SELECT page_id, url FROM h WHERE host IN (SELECT host FROM h WHERE page_id < 3)"""),
    "frontier_unseen": (frontier_unseen, f"WITH {sql.LINKS} SELECT DISTINCT to_url AS url FROM links WHERE to_url NOT IN (SELECT url FROM stored)"),
    "robots_rules": (robots_rule_table, ROBOTS_RULES_SQL),
    "robots_check": (robots_check, ROBOTS_CHECK_SQL),
    "robots_longest": (robots_longest, ROBOTS_CHECK_SQL),
    "reachable_pages": (reachable_pages, REACHABLE_SQL),
    "reachable_same_host": (reachable_same_host, REACHABLE_HOST_SQL),
    "reachable_some": (reachable_some, REACHABLE_SOME_SQL),
    **{name: (query, f"SELECT url, title, text, content_hash, status_code, fetched_at, post_date_iso FROM ({PAGES_SQL})")
       for name, query in (("streamed_pages", streamed_pages), ("streamed_late_pages", streamed_late_pages),
                           ("streamed_compacted_pages", streamed_compacted_pages))},
    "streamed_versions": (streamed_versions, f"SELECT v.* EXCLUDE (page_id), url FROM ({VERSIONS_SQL}) v JOIN ({PAGES_SQL}) p USING (page_id)"),
    "streamed_links": (streamed_links, f"""
        SELECT url AS from_url, to_url, to_page_id IS NOT NULL AS resolved, first_seen_at, last_seen_at
        FROM (WITH {sql.LINKS} SELECT {_LINK_COLUMNS} FROM links) l JOIN ({PAGES_SQL}) p ON p.page_id = l.from_page_id"""),
    "streamed_index": (streamed_index, STREAMED_INDEX_SQL),
    "first_seen_urls": (first_seen_urls, f"SELECT DISTINCT {sql.canonical('url')} AS url FROM pages"),
    "streamed_sightings": (streamed_sightings, SIGHTINGS_SQL),
    "streamed_windows": (streamed_windows, f"""WITH {sql.CLEANED}
        SELECT {sql.stamp("time_bucket(INTERVAL 60 SECOND, fetched_at)")} AS window_start, count(*) AS n FROM kept
        GROUP BY time_bucket(INTERVAL 60 SECOND, fetched_at)
        HAVING time_bucket(INTERVAL 60 SECOND, fetched_at) + INTERVAL 60 SECOND <= (SELECT max(fetched_at) FROM kept) - INTERVAL 10 MINUTE"""),
    "stored_versions": (stored_versions, VERSIONS_SQL),
    "stored_links": (stored_links, f"WITH {sql.LINKS} SELECT {_LINK_COLUMNS} FROM links"),
    "delete_remaining": (delete_remaining, f"SELECT * FROM ({PAGES_SQL}) WHERE page_id % 10 <> 3"),
}
