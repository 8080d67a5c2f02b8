"""Search results against SQLite's full-text engine, which follows the same rules."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.html import page_text, page_title, strip_ignored
from linkloom.operators.index import build_index, missing_ids, sync_index, tokens, verify_index
from linkloom.operators.match import CLAUSE_SCHEMA, hit_counts, instances, located, match, phrase_hits, plain_clauses, prepare
from linkloom.operators.rank import boost, page_info, top_per_query
from linkloom.plans.search import search

# (match expression, clause rows without query_id)
C = lambda clause, group, op, kind, text, mask=7, slop=0, phrase=0: (
    clause, group, op, kind, mask, slop, phrase, text
)
QUERIES = [
    ("from", [C(0, 0, "must", "term", "from")]),
    ("was", [C(0, 0, "must", "term", "was")]),
    ("from AND with", [C(0, 0, "must", "term", "from"), C(1, 1, "must", "term", "with")]),
    ("des OR auf", [C(0, 0, "should", "term", "des"), C(1, 0, "should", "term", "auf")]),
    ("with NOT from", [C(0, 0, "must", "term", "with"), C(1, 1, "not", "term", "from")]),
    ('"of the"', [C(0, 0, "must", "phrase", "of the")]),
    ('"example com"', [C(0, 0, "must", "phrase", "Example.com")]),
    ("title:des", [C(0, 0, "must", "term", "des", mask=1)]),
    ('url:"example com"', [C(0, 0, "must", "phrase", "example.com", mask=4)]),
    ("han*", [C(0, 0, "must", "prefix", "han")]),
    ("t* AND e*", [C(0, 0, "must", "prefix", "t"), C(1, 1, "must", "prefix", "e")]),
    ('"of t" *', [C(0, 0, "must", "prefix", "of t")]),
    ("NEAR(from with, 10)", [C(0, 0, "must", "near", "from", slop=10), C(0, 0, "must", "near", "with", slop=10, phrase=1)]),
    ("NEAR(the of, 0)", [C(0, 0, "must", "near", "the"), C(0, 0, "must", "near", "of", phrase=1)]),
    ('NEAR("of the" and, 3)', [C(0, 0, "must", "near", "of the", slop=3), C(0, 0, "must", "near", "and", slop=3, phrase=1)]),
    ("NEAR(the of and, 2)", [C(0, 0, "must", "near", t, slop=2, phrase=i) for i, t in enumerate(("the", "of", "and"))]),
    ('NEAR("the of" the "of the", 4)', [C(0, 0, "must", "near", t, slop=4, phrase=i) for i, t in enumerate(("the of", "the", "of the"))]),
    ("NEAR(the o*, 2)", [C(0, 0, "must", "near", "the", slop=2), C(0, 0, "must", "prefix", "o", slop=2, phrase=1)]),
    ('"the of the of"', [C(0, 0, "must", "phrase", "the of the of")]),
    ("^the", [C(0, 0, "must", "initial", "the")]),
    ("^of AND the", [C(0, 0, "must", "initial", "of"), C(1, 1, "must", "term", "the")]),
    ("(from OR des) AND (with OR auf)", [
        C(0, 0, "should", "term", "from"), C(1, 0, "should", "term", "des"),
        C(2, 1, "should", "term", "with"), C(3, 1, "should", "term", "auf")]),
    ("the NOT (from OR with)", [
        C(0, 0, "must", "term", "the"), C(1, 1, "not", "term", "from"), C(2, 2, "not", "term", "with")]),
    ("zzzunknown", [C(0, 0, "must", "term", "zzzunknown")]),
    ("the AND the", [C(0, 0, "must", "term", "the"), C(1, 1, "must", "term", "the")]),
    ("running", [C(0, 0, "must", "term", "Running")]),
    ("was OR edre OR the", [C(i, 0, "should", "term", t) for i, t in enumerate(("was", "edre", "the"))]),
]


def clause_frame(spark, queries=QUERIES):
    rows = [(q, *clause) for q, (_, clauses) in enumerate(queries) for clause in clauses]
    return spark.createDataFrame(rows, CLAUSE_SCHEMA)


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    stripped = strip_ignored("html")
    frame = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id",
        "url",
        page_title(stripped).alias("title"),
        page_text(stripped).alias("text"),
        F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("status_code"),
        F.lit("2023-08-30T10:00:00+02:00").alias("post_date_iso"),
    )
    extra = spark.createDataFrame(
        [
            (1001, "http://x/", "Running shoes", " First: he runs. They ran running over the of the of and. the", 200, None),
            (1002, "http://y/", "", "", 200, None),
            (1003, "http://z/", "the", "…the… of the (of the) and the of; running", 404, "bad"),
        ],
        T.StructType([T.StructField(f.name, f.dataType) for f in frame.schema]),
    )
    return frame.unionByName(extra).cache()


@pytest.fixture(scope="module", params=[True, False], ids=["stemmed", "plain"])
def stem(request):
    return request.param


@pytest.fixture(scope="module")
def index(pages, stem):
    built = build_index(pages, stem)
    return type(built)(built.postings.cache(), built.doc_stats.cache(), built.corpus_stats, stem)


@pytest.fixture(scope="module")
def sqlite(pages, stem):
    base = sqlite3.connect(":memory:")
    tokenizer = "porter unicode61" if stem else "unicode61"
    base.execute(f"create virtual table f using fts5(title, text, url, tokenize='{tokenizer}')")
    base.execute("create virtual table v using fts5vocab(f, 'instance')")
    rows = [(r.page_id, r.title, r.text, r.url) for r in pages.collect()]
    base.executemany("insert into f(rowid, title, text, url) values (?, ?, ?, ?)", rows)
    return base


def expected_scores(sqlite):
    found = {}
    for q, (expression, _) in enumerate(QUERIES):
        for row, score in sqlite.execute("select rowid, bm25(f) from f where f match ?", (expression,)):
            found[q, row] = score
    return found


def test_tokens(sqlite, pages, stem):
    names = {"title": 0, "text": 1, "url": 2}
    expected = {(t, d, names[c], o) for t, d, c, o in sqlite.execute("select term, doc, col, offset from v")}
    got = {(r.token, r.page_id, r.col, r.pos) for r in tokens(pages, stem).collect()}
    assert got == expected


def test_scores(spark, sqlite, index, stem):
    got = match(index, prepare(clause_frame(spark), stem)).collect()
    assert len({(r.query_id, r.page_id) for r in got}) == len(got)
    got = {(r.query_id, r.page_id): r.score for r in got}
    expected = expected_scores(sqlite)
    for q, (expression, _) in enumerate(QUERIES):
        mine = {k: v for k, v in got.items() if k[0] == q}
        theirs = {k: v for k, v in expected.items() if k[0] == q}
        assert set(mine) == set(theirs), expression
        assert mine == pytest.approx(theirs, abs=1e-9), expression


def test_large_batches_give_the_same(spark, index, stem, monkeypatch):
    small = match(index, prepare(clause_frame(spark), stem)).collect()
    monkeypatch.setattr("linkloom.operators.match.SMALL_BATCH", 3)
    terms = prepare(clause_frame(spark), stem)
    assert not terms.small
    large = match(index, terms).collect()
    rounded = lambda rows: sorted((r.query_id, r.page_id, round(r.score, 9)) for r in rows)
    assert rounded(large) == rounded(small)


def test_weights(spark, sqlite, index, stem):
    got = match(index, prepare(clause_frame(spark, QUERIES[:1]), stem), (3.0, 1.0, 0.0)).collect()
    rows = sqlite.execute("select rowid, bm25(f, 3.0, 1.0, 0.0) from f where f match 'from'")
    assert {r.page_id: r.score for r in got} == pytest.approx(dict(rows.fetchall()), abs=1e-9)


def test_results_and_snippets(spark, sqlite, index, pages):
    got = search(index, pages, clause_frame(spark), limit=50)
    rows = {(r.query_id, r.page_id): r for r in got.results.collect()}
    for q, (expression, _) in enumerate(QUERIES):
        found = sqlite.execute(
            "select rowid, bm25(f), snippet(f, 1, '<mark>', '</mark>', ' … ', 12)"
            " from f where f match ? order by bm25(f), rowid",
            (expression,),
        ).fetchall()
        shown = sorted((r for k, r in rows.items() if k[0] == q), key=lambda r: r.place)
        assert [r.place for r in shown] == list(range(1, min(len(found), 50) + 1))
        assert [r.score for r in shown] == pytest.approx([s for _, s, _ in found][:50])
        snippets = {page: text for page, _, text in found}
        for r in shown:
            assert r.snippet == snippets[r.page_id], (expression, r.page_id)
    totals = {r.query_id: r.total for r in got.totals.collect()}
    assert totals == {
        q: sqlite.execute("select count(*) from f where f match ?", (e,)).fetchone()[0]
        for q, (e, _) in enumerate(QUERIES)
    }
    dead = [r for r in rows.values() if r.status_code == 404]
    assert dead and all(r.title.startswith(r.url + " / ") for r in dead)
    assert {r.shown_date for r in rows.values()} >= {"Aug 30, 2023 10:00", ""}


def test_paging(spark, index, pages, stem):
    scored = match(index, prepare(clause_frame(spark), stem)).cache()
    everything = {(r.query_id, r.place): r.page_id for r in top_per_query(scored, 50).collect()}
    second = {(r.query_id, r.place): r.page_id for r in top_per_query(scored, 3, 3).collect()}
    assert second == {k: v for k, v in everything.items() if 3 < k[1] <= 6}
    deep = {(r.query_id, r.place): r.page_id for r in top_per_query(scored, 2000).collect()}
    assert everything.items() <= deep.items()
    totals = spark.createDataFrame([(1, 20), (2, 0), (3, 35)], "query_id int, total long")
    info = [tuple(r) for r in page_info(totals, 10, 10).orderBy("query_id").collect()]
    assert info == [(1, 20, 2, 3, 0, None), (2, 0, 2, 1, 0, None), (3, 35, 2, 4, 0, 20)]


def test_plain_queries(spark, sqlite, index, stem):
    queries = spark.createDataFrame([(0, ' of  "the of" '), (1, "   "), (2, "!!")], "query_id int, q string")
    clauses = plain_clauses(queries)
    got = {(r.query_id, r.page_id) for r in match(index, prepare(clauses, stem)).collect()}
    rows = sqlite.execute("""select rowid from f where f match 'of "the of"'""").fetchall()
    assert got == {(0, page) for (page,) in rows}
    counts = hit_counts(match(index, prepare(clauses, stem)), queries)
    assert {r.query_id: r.total for r in counts.collect()} == {0: len(rows), 1: 0, 2: 0}


def test_boost(spark):
    scored = spark.createDataFrame([(1, 1, -2.0), (1, 2, -2.0), (1, 3, -2.0)], "query_id int, page_id long, score double")
    inbound = spark.createDataFrame([(2, 10), (3, 100)], "page_id long, inbound long")
    got = {r.page_id: r.score for r in boost(scored, inbound).collect()}
    assert got == pytest.approx({1: -2.0, 2: -3.0, 3: -4.0})


def test_incremental_index_equals_rebuild(spark, pages, stem):
    before = pages.filter("page_id % 7 <> 3")
    changed = pages.filter("page_id % 7 in (1, 3)").withColumn("text", F.concat("text", F.lit(" anew")))
    removed = pages.filter("page_id % 7 = 2").select("page_id")
    after = before.join(changed, "page_id", "left_anti").join(removed, "page_id", "left_anti").unionByName(changed)
    synced = sync_index(build_index(before, stem), changed, removed)
    rebuilt = build_index(after, stem)
    for name in ("postings", "doc_stats", "corpus_stats"):
        rows = [sorted(map(tuple, getattr(i, name).select(*getattr(rebuilt, name).columns).collect())) for i in (synced, rebuilt)]
        assert rows[0] == rows[1], name
    report = verify_index(synced, after).first()
    assert report.ok and report.n_pages == report.n_indexed == after.count()
    assert not verify_index(synced, before).first().ok
    assert missing_ids(synced, before).count() > 0


def near_sweep(lists, sizes, slop):
    """Starts that count, found by moving one instance of one phrase at a time.

    While some instance ends too far before the one that starts last, it moves on; a
    window that holds all phrases counts for all, and then the nearest next one moves.
    """
    at, kept = [0] * len(lists), [set() for _ in lists]
    if not all(lists):
        return kept
    while True:
        latest = max(starts[k] for starts, k in zip(lists, at, strict=True))
        late = [i for i, k in enumerate(at) if lists[i][k] + sizes[i] + slop < latest]
        if late:
            moving = late[0]
        else:
            for i, k in enumerate(at):
                kept[i].add(lists[i][k])
            following = [(starts[k + 1], i) for i, (starts, k) in enumerate(zip(lists, at, strict=True)) if k + 1 < len(starts)]
            if not following:
                return kept
            moving = min(following)[1]
        at[moving] += 1
        if at[moving] == len(lists[moving]):
            return kept


def test_near_counts_like_a_sweep(spark):
    """Repeated words, phrases that overlap, prefixes, far apart and none at all, on dense and sparse texts."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "of", "to", "tom", *"abcdefgh"[: rng.randint(0, 8)]]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts.append("the " * 300 + "x " * 20 + "of the " * 100)
    groups = [["the", "the"], ["the of", "the", "of the"], ["of", "the", "of"], ["the", "t*"], ["to", "to", "to"], ["of the", "h"], ["a", "b", "c", "the"]]
    rows, plans = [], []
    for group in groups:
        for slop in (0, 1, 4, 50, 10_000_000):
            rows += [(len(plans), 0, 0, "must", "prefix" if "*" in p else "near", 7, slop, i, p) for i, p in enumerate(group)]
            plans.append((group, slop))
    pages = spark.createDataFrame([(k, None, t, "") for k, t in enumerate(texts)], "page_id long, title string, text string, url string")
    index = build_index(pages, stem=False)
    terms = located(index, prepare(spark.createDataFrame(rows, CLAUSE_SCHEMA), stem=False))
    want = {}
    for q, (group, slop) in enumerate(plans):
        for page, text in enumerate(texts):
            words = text.split()
            fits = lambda w, p: w.startswith(p[:-1]) if p.endswith("*") else w == p
            lists = [[i for i in range(len(words) - len(p.split()) + 1) if all(map(fits, words[i:], p.split()))] for p in group]
            kept = near_sweep(lists, [len(p.split()) for p in group], slop)
            want |= {(q, i, page): sorted(kept[i]) for i in range(len(group)) if kept[i]}
    found = instances(index, terms)
    assert {(r.query_id, r.phrase_no, r.page_id): r.starts for r in found.collect()} == want
    hits = phrase_hits(index, terms, (1.0, 1.0, 1.0))
    assert {(r.query_id, r.phrase_no, r.page_id): r.hits for r in hits.filter("hits > 0").collect()} == {k: len(v) for k, v in want.items()}
    assert "explode(positions" not in hits._jdf.queryExecution().toString()
