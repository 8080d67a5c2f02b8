from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom.operators.index import build_index
from linkloom.functions.urls import canonical_url
from linkloom.operators.store import upsert_links, upsert_pages
from linkloom.operators.fetches import kept_fetches, parse_fetches, window_counts
from linkloom.sources.lineage import Scratch, cut
from linkloom.sources.tables import SCHEMAS, empty, stream_fetches
from linkloom.streaming import ingest
from linkloom.streaming.ingest import State, first_seen, start_ingest, stream_throughput
from linkloom.streaming.sightings import url_sightings
from suite import fixtures as fixture
from tests.test_tables import rows

LOG = [c.split()[0] for c in SCHEMAS["fetch_log"].split(", ")]


@pytest.fixture(scope="module")
def log_folder(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("log") / "files")
    log = cut(fixture.fetch_log(spark, sf_dir))
    for rnd in (0, 1, 2):
        log.filter(F.col("rnd") == rnd).select(*LOG).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_equals_batch(spark, log_folder, tmp_path):
    folder = str(tmp_path / "state")
    for _ in range(2):  # the second start finds nothing new
        query = start_ingest(
            stream_fetches(spark, log_folder, 1), folder, str(tmp_path / "checkpoint"), once=True
        )
        query.awaitTermination()
    state = State(spark, folder)
    assert state.last_batch() == 2
    parsed = cut(parse_fetches(spark.read.schema(SCHEMAS["fetch_log"]).parquet(log_folder)))
    pages = cut(upsert_pages(empty(spark, "pages"), parsed))
    links = upsert_links(empty(spark, "links"), parsed, pages)
    index = build_index(pages)
    assert rows(state.pages()) == rows(pages)
    assert rows(state.links()) == rows(links)
    assert rows(state.index().postings.drop("bucket")) == rows(index.postings)
    assert rows(state.index().doc_stats) == rows(index.doc_stats)
    few = state.pages(buckets=[3, 9])
    assert few.count() == pages.filter(f"pmod(xxhash64(url), {state.buckets()}) in (3, 9)").count()
    assert "bucket" in few._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]
    waiting = links.filter("to_page_id is null").select("to_url", "from_page_id")
    assert rows(state.pending()) == rows(waiting)
    hashes = parsed.select("content_hash").distinct().count()
    assert state.deltas("contents").count() == state.deltas("content_keys").count() == hashes
    before = rows(state.versions())
    state.apply(spark.read.schema(SCHEMAS["fetch_log"]).parquet(log_folder), 1)  # replayed
    assert rows(state.versions()) == before
    compacted = state.compact(str(tmp_path / "compacted"))
    assert rows(compacted.pages()) == rows(pages)
    assert rows(compacted.links()) == rows(links) and rows(compacted.versions()) == before and rows(compacted.pending()) == rows(waiting)
    assert rows(compacted.index().postings.drop("bucket")) == rows(index.postings)
    assert compacted.index().corpus_stats.first() == state.index().corpus_stats.first() == index.corpus_stats.first()


def fetched(spark, batches):
    """Raw fetches of pages given as (url, minute, links, text)."""
    page = "<html><title>t</title><body>{} {}</body></html>"
    made = [(u, 200, "text/html", page.format(" ".join(f'<a href="{x}">x</a>' for x in links), text), None, minute) for u, minute, links, text in batches]
    kinds = "url string, status int, content_type string, html string, error string, minute int"
    return spark.createDataFrame(made, kinds).withColumn("fetched_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, minute)")).drop("minute")


def test_edges_wait_for_their_target(spark, tmp_path):
    """Targets that come later, in the same batch, late, or never; contents seen before."""
    a, b, c, d, e = (f"http://site/{x}" for x in "abcde")
    batches = [
        [(a, 1, [b, c, e], "one"), (d, 2, [a, c], "one")],
        [(b, 10, [a], "two"), (a, 3, [b], "one")],
        [(c, 20, [c, e], "one"), (a, 21, [c], "three")],
        [(c, 5, [d], "late"), (b, 30, [], "one")],
    ]
    state = State(spark, str(tmp_path / "state"))
    pages, links = empty(spark, "pages"), empty(spark, "links")
    for k, batch in enumerate(batches):
        log = fetched(spark, batch)
        state.apply(log, k)
        parsed = cut(parse_fetches(log))
        pages = cut(upsert_pages(pages, parsed))
        links = cut(upsert_links(links, parsed, pages))
        assert rows(state.pages()) == rows(pages)
        assert rows(state.links()) == rows(links)
        assert rows(state.pending()) == rows(links.filter("to_page_id is null").select("to_url", "from_page_id"))
    assert state.pending().select("to_url").distinct().count() == 1
    assert len({(r.to_url, r.from_page_id) for r in state.deltas("pending").filter("not resolved").collect()}) > 1
    assert state.deltas("contents").select("content_hash").distinct().count() == state.deltas("contents").count()


def test_batches_read_their_buckets_and_move_no_html(spark, log_folder, tmp_path, monkeypatch):
    """Plans of a small batch on a larger store: other buckets are not read, HTML is in no shuffle."""
    state = State(spark, str(tmp_path / "state"))
    log = spark.read.schema(SCHEMAS["fetch_log"]).parquet(log_folder)
    state.apply(log, 0)
    assert state.buckets() == ingest.buckets_for(50) == ingest.FEWEST_BUCKETS and ingest.buckets_for(10**9) == 40_000
    plans = []
    keep, write = Scratch.keep, State._write
    monkeypatch.setattr(Scratch, "keep", lambda self, frame: (plans.append(("scratch", frame)), keep(self, frame))[1])
    monkeypatch.setattr(State, "_write", staticmethod(lambda frame, table, *rest: (plans.append((table, frame)), write(frame, table, *rest))[1]))
    state.apply(log.limit(1), 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        texts = [(name, frame._jdf.queryExecution().executedPlan().toString()) for name, frame in plans]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {"heads", "contents", "links", "pending", "page_versions", "content_keys"} <= {name for name, _ in texts}
    for name, plan in texts:
        for line in plan.splitlines():
            if "Exchange" in line and "BroadcastExchange" not in line:
                assert "html#" not in line, (name, line)
    wide = next(frame for name, frame in plans if name == "contents")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in wide and "hashpartitioning" not in wide
    scans = [line for _, p in texts for line in p.splitlines() if "FileScan" in line and "bucket#" in line]
    assert len(scans) > 3 and all("bucket#" in line.split("PartitionFilters: ")[1].split("]")[0] for line in scans)


def run_to_memory(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return frame.sparkSession.table(name)


def test_first_seen(spark, log_folder):
    log = spark.read.schema(SCHEMAS["fetch_log"]).parquet(log_folder)
    n = log.select(canonical_url("url")).distinct().count()
    for i, lateness in enumerate((None, "30 days")):
        got = run_to_memory(first_seen(stream_fetches(spark, log_folder), lateness), f"seen{i}")
        assert got.count() == got.select("url").distinct().count() == n


def test_throughput_windows(spark, log_folder):
    kept = kept_fetches(spark.read.schema(SCHEMAS["fetch_log"]).parquet(log_folder))
    want = {str(r.window_start): r.n for r in window_counts(kept).collect()}
    got = run_to_memory(stream_throughput(stream_fetches(spark, log_folder, 1)), "rates")
    got = {str(r.window_start): r.n for r in got.collect()}
    # The newest windows are still open.
    assert got and got.items() <= want.items()


def test_sightings(spark, tmp_path):
    """New, known and late URLs over restarts, and a notice when a URL falls silent."""
    base = "http://site/"
    batches = [[(f"{base}a", 1), (f"{base}a#x", 9), (f"{base}b", 5), ("mailto:x", 5)], [(f"{base}a", 4), (f"{base}c", 60)], [(f"{base}b", 6), (f"{base}c", 400)], [(f"{base}c", 401)]]
    events = {}
    for name, options in (("kept", {}), ("silent", {"quiet": timedelta(hours=2), "lateness": "10 minutes"})):
        for k, batch in enumerate(batches):
            fetched(spark, [(u, minute, [], "x") for u, minute in batch]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/log")
            seen = url_sightings(stream_fetches(spark, f"{tmp_path}/{name}/log"), **options)
            writer = seen.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}/checkpoint")
            writer.trigger(availableNow=True).start(f"{tmp_path}/{name}/rows").awaitTermination()
        found = spark.read.schema(seen.schema).parquet(f"{tmp_path}/{name}/rows").collect()
        minute = lambda t: int((t - datetime(2024, 1, 1)).total_seconds() // 60)
        events[name] = sorted((r.url[-1], r.event, minute(r.first_seen), minute(r.last_fetch), r.n_fetches, r.n_late) for r in found)
    kept = [("a", "known", 1, 9, 1, 1), ("a", "new", 1, 9, 2, 0), ("b", "known", 5, 6, 1, 0), ("b", "new", 5, 5, 1, 0),
            ("c", "known", 60, 400, 1, 0), ("c", "known", 60, 401, 1, 0), ("c", "new", 60, 60, 1, 0)]
    assert events["kept"] == kept
    silent = [e for e in events["silent"] if e[1] == "silent"]
    assert {e[0] for e in silent} == {"a", "b"} and ("a", "silent", 1, 9, 0, 0) in silent
