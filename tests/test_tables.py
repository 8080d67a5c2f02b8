"""Invariants of the table jobs, checked against plain Python on the small data."""

from collections import defaultdict
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical_url
from linkloom.operators import fetches as fx
from linkloom.operators import store as st
from linkloom.operators.frontier import allowed_hosts, normalize_seeds, reachable
from linkloom.operators.links import link_edges, outbound_top, unresolved
from linkloom.operators.rank import inbound_counts
from linkloom.operators.robots import agent_rules, robots_allowed
from linkloom.operators.skew import skew_join
from linkloom.sources.lineage import cut
from linkloom.sources.tables import empty, read_table, write_table
from suite import fixtures as fixture


@pytest.fixture(scope="module")
def log(spark, sf_dir):
    return cut(fixture.fetch_log(spark, sf_dir))


@pytest.fixture(scope="module")
def parsed(log):
    return cut(fx.parse_fetches(log))


def rows(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=repr)


def test_fetch_outcomes(spark):
    cases = [
        ("http://h/1", 404, "text/html", "x", None, "status-404"),
        ("http://h/2", 302, "text/pdf", None, None, "status-302"),
        ("http://h/3", 500, "text/html", "x", None, None),
        ("http://h/4", 200, "image/png", "x", None, "non-html"),
        ("http://h/5", 200, None, "x", None, None),
        ("http://h/6", 200, "", "x", None, None),
        ("http://h/7", None, None, None, "timeout", "timeout"),
        ("http://h/8", None, None, None, "client-error:X", "client-error:X"),
        ("http://h/9", 200, "TEXT/HTML", "éééé", None, "too-large"),
        ("nope", 200, "text/html", "x", None, "bad-url"),
        ("http://h/10", 200, "text/html", None, None, "no-html"),
    ]
    frame = spark.createDataFrame(
        [c[:5] for c in cases], "url string, status int, content_type string, html string, error string"
    )
    got = fx.clean_fetches(frame, max_bytes=6).select("drop_reason", "html").collect()
    assert [r.drop_reason for r in got] == [c[5] for c in cases]
    assert all((r.html is None) or r.drop_reason is None for r in got)


def fold_in_python(parsed):
    """The upsert, one fetch at a time."""
    pages, versions, links = {}, {}, {}
    batch = sorted(parsed.collect(), key=lambda r: (r.fetched_at, r.content_hash))
    ids = {}
    for r in batch:
        ids[r.url] = min(r.page_id, ids.get(r.url, r.page_id))
    for r in batch:
        old = pages.get(r.url)
        date = r.post_date_iso or (old[2] if old else None)
        pages[r.url] = (ids[r.url], r.content_hash, date, r.status, r.fetched_at, r.title)
        versions.setdefault((ids[r.url], r.content_hash), r.fetched_at)
        for u in r.out_links:
            first = links.get((ids[r.url], u), (r.fetched_at,))[0]
            links[ids[r.url], u] = (first, r.fetched_at)
    edges = {
        (f, u, pages[u][0] if u in pages else None, *times) for (f, u), times in links.items()
    }
    return pages, versions, edges


def check_state(parsed, pages, versions, links):
    want_pages, want_versions, want_links = fold_in_python(parsed)
    got = {
        r.url: (r.page_id, r.content_hash, r.post_date_iso, r.status_code, r.fetched_at, r.title)
        for r in pages.collect()
    }
    assert got == want_pages
    assert {(r.page_id, r.content_hash): r.fetched_at for r in versions.collect()} == want_versions
    assert {tuple(r) for r in links.select(*st.LINK_COLUMNS).collect()} == want_links


def ingest(state, batch):
    pages = cut(st.upsert_pages(state[0], batch))
    versions = cut(st.append_versions(state[1], batch, pages))
    links = cut(st.upsert_links(state[2], batch, pages))
    return pages, versions, links


@pytest.fixture(scope="module")
def stored_tables(spark, parsed):
    return ingest(nothing(spark), parsed)


def nothing(spark):
    return tuple(empty(spark, t) for t in ("pages", "page_versions", "links"))


def test_upserts_at_once_and_by_round(spark, parsed, stored_tables):
    at_once = stored_tables
    check_state(parsed, *at_once)
    state = nothing(spark)
    for rnd in (0, 2, 1, 1):  # late rows and a replay included
        state = ingest(state, parsed.filter(F.col("rnd") == rnd))
    key = ["page_id", "content_hash"]  # a late fetch does not restamp a known version
    assert rows(at_once[0]) == rows(state[0])
    assert rows(at_once[1].select(*key)) == rows(state[1].select(*key))
    assert rows(at_once[2]) == rows(state[2])
    report = {r.change: r.n for r in st.upsert_report(at_once[0], parsed.filter("rnd = 0")).collect()}
    assert set(report) <= {"late", "refreshed"} and report["late"] > 0
    assert st.live_links(at_once[2], at_once[0]).count() > 0


def test_delete(spark, parsed, stored_tables):
    pages, versions, links = stored_tables
    ids = pages.filter("page_id % 5 = 1").select("page_id")
    gone = {r.page_id for r in ids.collect()}
    p, v, l = st.delete_pages(pages, versions, links, ids)
    assert {r.page_id for r in p.collect()} == {r.page_id for r in pages.collect()} - gone
    assert not {r.page_id for r in v.collect()} & gone
    kept = [r for r in links.collect() if r.from_page_id not in gone]
    want = {(r.from_page_id, r.to_url, None if r.to_page_id in gone else r.to_page_id) for r in kept}
    assert {(r.from_page_id, r.to_url, r.to_page_id) for r in l.collect()} == want


def test_history_and_changes(parsed):
    by_url = defaultdict(list)
    for r in parsed.collect():
        by_url[r.url].append((r.fetched_at, r.content_hash))
    want = set()
    for url, seen in by_url.items():
        seen.sort()
        for i, (at, h) in enumerate(seen):
            want.add((url, at, h, None if i == 0 else h != seen[i - 1][1]))
    for bucket in ("hour", "month"):
        assert {tuple(r) for r in st.content_changes(parsed, bucket).collect()} == want


def test_duplicates(spark):
    pages = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(9)] + [(9, "c")], "page_id long, content_hash string")
    assert {tuple(r) for r in st.duplicate_groups(pages).collect()} == {("a", 6, 1), ("b", 3, 0)}
    assert st.duplicate_pages(pages).count() == 9


def test_skew_join_equals_plain_join(spark):
    left = spark.range(500).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 7 as string)) as k")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("0", 3), ("x", 4)], "k string, v int")
    for how in ("left", "inner"):
        salted = skew_join(left, right, ["k"], ["id"], how, hot_rows=50, salts=4)
        assert rows(salted) == rows(left.join(right, ["k"], how))


BODIES = [
    "User-agent: *\nDisallow: /private",
    "User-agent: sitebot\nAllow: /en/1\nDisallow: /en/\n\nUser-agent: *\nDisallow: /",
    "# none\n",
    "Disallow: /x\nUser-agent: other\nUser-agent: SiteBot\n# c\nDisallow: /a%20b # d\nDisallow:\n",
    "User-agent: sitebot\n\nDisallow: /\nUser-agent: *\nAllow: /p?q=1\nDisallow: /p\nUser-agent: *\nDisallow: /",
    "User-agent: *\nCrawl-delay: 1\n\nUser-agent: *\nDisallow: /",
    "User-agent: *\nUser-agent: sitebot\nDisallow: /s\n\nUser-agent: site\nDisallow: /t\r\nSitemap: x",
]
PATHS = ["", "/", "/private/x", "/en/1", "/en/2", "/a%20b/c", "/a+b", "/p?q=1", "/p?q=2", "/s", "/t/u"]


def test_robots_agree_with_the_standard_library(spark):
    sites = spark.createDataFrame([(f"http://h{i}", 200, b) for i, b in enumerate(BODIES)], "origin string, status int, body string")
    urls = [(f"http://h{i}{p}",) for i in range(len(BODIES)) for p in PATHS]
    for agent in ("sitebot/1.0 (+https://example.org)", "other/1.0", "nobody"):
        checked = robots_allowed(spark.createDataFrame(urls, "url string"), agent_rules(sites, agent))
        want = {}
        for i, body in enumerate(BODIES):
            parser = RobotFileParser()
            parser.parse(body.splitlines())
            for p in PATHS:
                want[f"http://h{i}{p}"] = parser.can_fetch(agent, f"http://h{i}{p}")
        assert {r.url: r.allowed for r in checked.collect()} == want


def test_robots_status_and_longest_match(spark):
    sites = [("http://a", 404, "User-agent: *\nDisallow: /"), ("http://b", 403, None), ("http://c", 503, None), ("http://d", None, None), ("http://e", 200, "User-agent: *\nDisallow: /x\nAllow: /x/y")]
    rules = agent_rules(spark.createDataFrame(sites, "origin string, status int, body string"), "bot")
    urls = spark.createDataFrame([(f"http://{h}/x/y",) for h in "abcdef"], "url string")
    flags = lambda m: [r.allowed for r in robots_allowed(urls, rules, m).orderBy("url").collect()]
    assert flags("first") == [True, False, False, True, False, True]
    assert flags("longest") == [True, False, False, True, True, True]


def test_hosts_and_seeds(spark):
    seeds = spark.createDataFrame([("HTTP://A.org:80",), ("ftp://x/",), ("",), ("no-scheme",)], "url string")
    assert [r.url for r in normalize_seeds(seeds).collect()] == ["http://a.org/"]
    with pytest.raises(ValueError):
        normalize_seeds(seeds.filter("url like 'ftp%'"))
    urls = spark.createDataFrame([("http://a.org/x",), ("http://b.org/x",), ("",), (None,)], "url string")
    seeds = normalize_seeds(seeds)
    assert [r.url for r in allowed_hosts(urls, seeds).collect()] == ["http://a.org/x"]
    assert allowed_hosts(urls, seeds, same_host=False).count() == 2


def bfs(edges, stored, starts, allowed, room):
    order, depth, seen, level = [], {}, set(starts), sorted(starts)
    d = 0
    while level and len(order) < room:
        visited = [u for u in level if allowed(u) and u in stored][: room - len(order)]
        for u in visited:
            order.append(u)
            depth[u] = d
        following = []
        for u in visited:
            for v in sorted(edges.get(u, ())):
                if v not in seen:
                    seen.add(v)
                    following.append(v)
        level, d = following, d + 1
    return order, depth


@pytest.mark.parametrize("room", [7, 4000])
def test_reachability_agrees_with_breadth_first_search(spark, sf_dir, parsed, stored_tables, room):
    pages, _, links = stored_tables
    rules = agent_rules(fixture.robots(spark, sf_dir), "sitebot/1.0")
    seeds = fixture.seeds(spark, sf_dir)
    got = reachable(links, pages, seeds, rules, room, same_host=False).collect()
    stored = {r.url: r.page_id for r in pages.collect()}
    by_id = {v: k for k, v in stored.items()}
    edges = defaultdict(set)
    for r in links.collect():
        edges[by_id[r.from_page_id]].add(r.to_url)
    all_urls = spark.createDataFrame([(u,) for u in set(stored) | {v for s in edges.values() for v in s}], "url string")
    ok = {r.url: r.allowed for r in robots_allowed(all_urls, rules).collect()}
    starts = [r.url for r in normalize_seeds(seeds).collect()]
    order, depth = bfs(edges, stored, starts, ok.__getitem__, room)
    assert {r.url: r.depth for r in got} == depth
    assert [r.url for r in sorted(got, key=lambda r: (r.depth, r.order))] == order
    assert len(order) > 3


def test_link_reports(spark, parsed, stored_tables):
    pages, _, links = stored_tables
    edges = links.collect()
    inbound = defaultdict(set)
    outbound = defaultdict(int)
    missing = defaultdict(int)
    for e in edges:
        outbound[e.from_page_id] += 1
        if e.to_page_id is None:
            missing[e.to_url] += 1
        else:
            inbound[e.to_page_id].add(e.from_page_id)
    assert {r.page_id: r.inbound for r in inbound_counts(links).collect()} == {k: len(v) for k, v in inbound.items()}
    assert {r.to_url: r.n_links for r in unresolved(links).collect()} == missing
    top = sorted(outbound.items(), key=lambda x: (-x[1], x[0]))[:20]
    assert {r.page_id: r.outbound for r in outbound_top(links, pages).collect()} == dict(top)
    features = parsed.filter("rnd = 2")
    got = link_edges(features, pages)
    assert got.count() == sum(len(r.out_links) for r in features.collect())


def test_throughput(spark, log):
    kept = fx.kept_fetches(log)
    got = fx.fetch_throughput(kept, delay=0.19).orderBy("window_start").collect()
    times = sorted(r.fetched_at for r in kept.collect())
    assert sum(r.n for r in got) == len(times) == got[-1].running_n
    assert all(r.slow for r in got[-2:])
    assert fx.fetch_throughput(kept, delay=0).first().percent_of_limit is None
    counters = fx.fetch_counters(log).first()
    assert counters.fetched == log.count() and counters.to_store == len(times)
    assert counters.seen == log.select(canonical_url("url")).distinct().count()
    assert sum(r.n for r in fx.drop_reasons(log).collect()) == counters.fetched


def test_snapshots(spark, parsed, stored_tables, tmp_path):
    pages, _, _ = stored_tables
    write_table(pages, f"{tmp_path}/pages", sorted_by="page_id")
    again = read_table(spark, "pages", f"{tmp_path}/pages")
    assert rows(again) == rows(pages)
    some = pages.first()
    assert st.page_by_id(again, some.page_id).first().html == some.html
    assert st.page_by_id(again, -1).count() == 0
