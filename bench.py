"""Times the headline jobs and prints one JSON line.

BENCH_SF_DIR  folder with the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkloom.operators import store as st
from linkloom.operators.fetches import drop_reasons, fetch_throughput, kept_fetches, parse_fetches
from linkloom.operators.frontier import reachable
from linkloom.operators.index import build_index
from linkloom.operators.match import CLAUSE_SCHEMA, prepare
from linkloom.operators.rank import inbound_counts
from linkloom.operators.robots import agent_rules
from linkloom.plans.search import ranked, search
from linkloom.sources.index_store import IndexStore
from linkloom.sources.tables import empty, read_table, spread, write_table
from suite import fixtures as fixture
from suite.search_queries import document_texts, page_texts
from suite.table_queries import AGENT

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LONG = 8.0


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("linkloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    work = tempfile.mkdtemp(prefix="linkloom-bench-")
    times: dict[str, float] = {}

    def timed(name, job):
        """Seconds of a job: the median of three runs, of the one run if that is long."""
        taken = []
        while len(taken) < (3 if not taken or taken[0] < LONG else 1):
            started = time.perf_counter()
            result = job()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken), 3)
        return result

    def run(frame):
        frame.write.format("noop").mode("overwrite").save()

    spark.range(1000).selectExpr("sum(id)").collect()
    docs = document_texts(spark, SF_DIR)
    fixture.fetch_log(spark, SF_DIR).write.parquet(f"{work}/log")
    log = spread(spark.read.parquet(f"{work}/log"), "page_id", "rnd")

    run(page_texts(spark, SF_DIR).limit(100))
    run(build_index(docs.limit(100)).postings)  # starts the Python workers
    timed("extract_pages", lambda: run(page_texts(spark, SF_DIR)))
    timed("index_build_stemmed", lambda: IndexStore(spark, f"{work}/index").build(docs))
    timed("index_build_plain", lambda: IndexStore(spark, f"{work}/plain").build(docs, stem=False))
    index = IndexStore(spark, f"{work}/index").read()
    words = [r.token for r in index.postings.groupBy("token").agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), "token").limit(2000).collect()][::20]
    rows = [(q, c, c, "must", "term", 7, 0, 0, words[(q * 7 + c * 31) % len(words)]) for q in range(100) for c in range(2)]
    batch = spark.createDataFrame(rows, CLAUSE_SCHEMA)
    timed("search_one_word", lambda: run(ranked(index, prepare(batch.filter("query_id = 0 and clause_id = 0")))))
    timed("search_100_queries", lambda: run(ranked(index, prepare(batch))))
    wide = docs.withColumns({"status_code": F.lit(200), "post_date_iso": F.lit(None).cast("string")})
    timed("search_100_with_snippets", lambda: run(search(index, wide, batch).results))
    phrases = spark.createDataFrame([(q, 0, 0, "must", "phrase", 7, 0, 0, f"{words[q]} {words[q + 1]}") for q in range(50)], CLAUSE_SCHEMA)
    timed("search_50_phrases", lambda: run(ranked(index, prepare(phrases))))

    timed("fetch_outcomes", lambda: run(drop_reasons(log)))
    timed("fetch_throughput", lambda: run(fetch_throughput(kept_fetches(log), 0.19)))
    timed("parse_fetches", lambda: write_table(parse_fetches(log), f"{work}/parsed"))
    parsed = spark.read.parquet(f"{work}/parsed")
    first, second = parsed.filter("rnd < 2"), parsed.filter("rnd = 2")
    timed("upsert_first", lambda: write_table(st.upsert_pages(empty(spark, "pages"), first), f"{work}/pages1", "page_id"))
    before = read_table(spark, "pages", f"{work}/pages1")
    timed("upsert_round", lambda: write_table(st.upsert_pages(before, second), f"{work}/pages2", "page_id"))
    pages = read_table(spark, "pages", f"{work}/pages2")
    timed("version_append", lambda: run(st.append_versions(empty(spark, "page_versions"), parsed, pages)))
    timed("link_upsert", lambda: write_table(st.upsert_links(empty(spark, "links"), parsed, pages), f"{work}/links"))
    links = read_table(spark, "links", f"{work}/links")
    timed("inbound_counts", lambda: run(inbound_counts(links)))
    rules = agent_rules(fixture.robots(spark, SF_DIR), AGENT)
    timed("reachability", lambda: run(reachable(links, pages, fixture.seeds(spark, SF_DIR), rules, 10**9, same_host=False)))
    timed("duplicate_pages", lambda: run(st.duplicate_pages(pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 10**6)))))

    print(json.dumps({
        "metric": "total seconds of the headline jobs", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
