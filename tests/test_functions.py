import re
import sqlite3
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.functions import analysis, html
from linkloom.functions.analysis import stem_column, stem_tokens, stem_word, tokenize
from linkloom.functions.dates import display_date, normalize_post_date
from linkloom.functions.html import (
    decode_entities,
    page_links,
    page_text,
    page_title,
    raw_post_date,
    strip_ignored,
)
from linkloom.functions.urls import (
    base_parts,
    canonical_url,
    netloc,
    origin,
    path_and_query,
    resolve_url,
)
from linkloom.operators.index import build_index


def apply(spark, values, function):
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, v string").select("i", function(F.col("v")).alias("r"))
    return [row.r for row in sorted(frame.collect())]


def test_canonical_url(spark):
    cases = {
        "HTTPS://Shop.Test:443/x///y//z?q=1&r=2#part": "https://shop.test/x/y/z?q=1&r=2",
        "gopher://shop.test/x": None,
        "shop.test/x": None,
        "https://example.com:443": "https://example.com/",
        "https://example.com:80/": "https://example.com:80/",
        "http://example.com:443/": "http://example.com:443/",
        " https://Example.com/A/B;p=1;q?y=//z ": "https://example.com/A/B?y=//z",
        "http://h/a;x/b;y/c": "http://h/a;x/b;y/c",
        "http://h/?": "http://h/",
        "http://h?x=1": "http://h/?x=1",
        "http://h/a\tb\n": "http://h/ab",
        "http://u:p@H:8080/": "http://u:p@h:8080/",
        "http://[::1]:80/x": "http://[::1]/x",
        "http://[::1/x": None,
        "http:/h/x": None,
        "https:///x": None,
        "mailto:a@b.c": None,
        "": None,
        None: None,
    }
    assert apply(spark, cases, canonical_url) == list(cases.values())


def test_url_pieces(spark):
    url = ["https://Me@Host.org:81/a/b?c=d"]
    assert apply(spark, url, netloc) == ["me@host.org:81"]
    assert apply(spark, url, origin) == ["https://Me@Host.org:81"]
    assert apply(spark, url, path_and_query) == ["/a/b?c=d"]
    assert apply(spark, ["http://h"], path_and_query) == ["/"]


BASES = ["http://h.org/a/b/c?q=1", "https://h.org", "http://h.org/a/", "http://h.org/x.html"]
HREFS = [
    "http://o.org/p", "//o.org/x", "/x", "x", "../x", "./x", "?q", "?", "#f", "", "mailto:a@b",
    "../../../x", "..", ".", "./", "../", "x/../y", "x/./y/", "/a/../../b", "/a/b/..", "x//y",
    "http:z", "https://h.org:443/", "x?y=../z", "x:y", "g;p", "a/b/../../c", "/..", "/a//../b",
]


def test_resolve_url(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    frame = spark.createDataFrame(rows, "b string, h string")
    got = frame.select(
        "b", "h", canonical_url(resolve_url(base_parts("b"), "h")).alias("r")
    ).collect()
    joined = [urldefrag(urljoin(b, h)).url for b, h in rows]
    expected = apply(spark, joined, canonical_url)
    assert [(r.b, r.h, r.r) for r in got] == [(b, h, e) for (b, h), e in zip(rows, expected)]


PAGE = """<!doctype html>
<html><head><title>
 Harbour <em>news</em> </title><style>a{}</style>
<script>document.write('<p>never</p>');</script></head><body>
<!-- <a href="/old">gone</a> --><h1 title="x > y">Tide &lt; 4 m</h1>
<p>Ships&nbsp;come   in</p> <a href="tides?d=1&amp;m=2">tides</a>
<a id=k href='//port.test/x'>port</a> <a title="5 > 4" href="/deep">deep</a>
<a href="tides?d=1&amp;m=2#top">twice</a> <a href="tel:123">call</a> <a href="">none</a> <a name=x>no</a>
<a title="see href=bad" href="/good">good</a> <a data-href="/no" hreflang=en HREF = /caps>caps</a>
<a href="/cut">3 < 4<template>hidden</template></a><noscript>off</noscript></body></html>"""


def test_extraction(spark):
    stripped = lambda c: strip_ignored(c)
    assert apply(spark, [PAGE], lambda c: page_title(stripped(c))) == ["Harbour news"]
    assert apply(spark, [PAGE], lambda c: page_text(stripped(c))) == [
        "Harbour news Tide < 4 m Ships\u00a0come   in tides port deep twice call none no good caps 3 < 4"
    ]
    links = apply(spark, [PAGE], lambda c: page_links(stripped(c), F.lit("https://bay.test/en/")))
    paths = ["/en/tides?d=1&m=2", None, "/deep", "/good", "/caps", "/cut"]
    assert links == [[f"https://bay.test{p}" if p else "https://port.test/x" for p in paths]]
    assert apply(spark, ["<p>x</p>", "<title></title>x"], lambda c: page_title(stripped(c))) == [None, ""]
    assert apply(spark, ["a<script>b"], lambda c: page_text(stripped(c))) == ["a"]


def test_long_markup_is_safe(spark):
    html = "<p " + "a='b' " * 50_000 + ">x</p>" + "<script>" + "y;" * 200_000 + "</script>z"
    assert apply(spark, [html], lambda c: page_text(strip_ignored(c))) == ["x z"]


def test_entities(spark):
    cases = {
        "a &lt;b&gt; &eacute;&#233;&#xE9; &copy x": "a <b> ééé © x",
        "&unknown; & &; &#0; &#128512; &#150;": "&unknown; & &; � 😀 –",
        "no entity": "no entity",
        "&#99999999999999999999;": "�",
    }
    assert apply(spark, cases, decode_entities) == list(cases.values())


def test_post_date_block(spark):
    cases = {
        '<div class="post_meta"><span class="post_date">2023-08-30</span></div>': "2023-08-30",
        '<div id=1 class="a post_meta b"><div>x</div><time class="post_date" datetime="2023">y</time></div>': "2023",
        '<div class="post_meta"></div><span class="post_date">late</span>': None,
        '<div class="post_meta"><div><p>a</p></div><i class=post_date datetime=""> b <u>c</u></i></div>': "b c",
        '<div class="post_meta_x"><span class="post_date">2023</span></div>': None,
        "<div><span class='post_date'>2023</span></div>": None,
        '<div title="a>b" class="post_meta"><p data-x=\'>\' class="q post_date">2023</p></div>': "2023",
        '<div class="post_meta"><span class="post_date"><span>Aug</span> 30, <b><span>2023</span></b></span> x</div>': "Aug 30, 2023",
        '<div data-class="post_meta"><span class="post_date">no</span></div>': None,
        '<div class="post_meta"><span title="class=post_date">no</span><em class="post_date" title="datetime=1">yes</em></div>': "yes",
    }
    assert apply(spark, cases, lambda c: raw_post_date(strip_ignored(c))) == list(cases.values())


DATES = {
    "2023-08-30": "2023-08-30T00:00:00+00:00",
    "2023/8/30": "2023-08-30T00:00:00+00:00",
    "2023.08.30": "2023-08-30T00:00:00+00:00",
    "2023-8-3 1:02": "2023-08-03T01:02:00+00:00",
    "2023-08-30 10:11:12": "2023-08-30T10:11:12+00:00",
    "2023-08-30 10:11:12-0530": "2023-08-30T10:11:12-05:30",
    "2023-08-30T10:11": "2023-08-30T10:11:00+00:00",
    "2023-08-30T10:11:12": "2023-08-30T10:11:12+00:00",
    "2023-08-30T10:11:12+02:00": "2023-08-30T10:11:12+02:00",
    "2023-08-30T10:11:12Z": "2023-08-30T10:11:12+00:00",
    "2023-08-30T10:11:12.5Z": "2023-08-30T10:11:12.500000+00:00",
    "20230830": "2023-08-30T00:00:00+00:00",
    "20230830T1011": "2023-08-30T10:11:00+00:00",
    "2023-W35-3": "2023-08-30T00:00:00+00:00",
    "2023W353": "2023-08-30T00:00:00+00:00",
    "2023-W53": None,
    "Aug 30, 2023": "2023-08-30T00:00:00+00:00",
    "August 30, 2023": "2023-08-30T00:00:00+00:00",
    "aug 3, 2023 22:05": "2023-08-03T22:05:00+00:00",
    "December 30, 2023 7:05 PM": "2023-12-30T19:05:00+00:00",
    "Sep 30, 2023 12:05 am": "2023-09-30T00:05:00+00:00",
    "Posted on: Aug 30th, 2023": "2023-08-30T00:00:00+00:00",
    "published 3rd": None,
    "2023-08-30 10:00 UTC": "2023-08-30T10:00:00+00:00",
    "2023-08-30 10:00 GMT": "2023-08-30T10:00:00+00:00",
    "  ": None,
    "Posted on": None,
    "yesterday": None,
    "2023-02-30": None,
    "2023-08-30T25:00": None,
    "Sept 30, 2023": None,
    "2023/08/30 10:00": None,
    None: None,
}


def test_post_dates(spark):
    got = apply(spark, DATES, lambda c: normalize_post_date(c)["post_date_iso"])
    assert dict(zip(DATES, got)) == DATES
    stamps = apply(
        spark,
        ["2023-08-30T10:11:12+02:00", "2023-08-30T10:11:12.5Z"],
        lambda c: normalize_post_date(c)["post_date"].cast("string"),
    )
    assert stamps == ["2023-08-30 08:11:12", "2023-08-30 10:11:12.5"]


def test_display_date(spark):
    cases = {"2023-08-30T10:00:00+02:00": "Aug 30, 2023 10:00", "bad": "", None: ""}
    assert apply(spark, cases, display_date) == list(cases.values())


TEXTS = [
    "Running naïvely: the ponies' étude_no5, relational ÉCOLE Straße áb ế ΑΣ ς ſ 10.5",
    "caresses flies dies mules denied died agreed owned humbled sized meeting stating siezing "
    "itemization sensational traditional reference colonizer plotted hopping hoping falling",
    "oscillators generalizations triplicate formative formalize electrical hopeful goodness "
    "revival allowance inference airliner gyroscopic adjustable defensible irritant replacement "
    "adjustment dependent adoption homologou communism activate angulariti homologous effective "
    "bowdlerize probate rate cease controll roll feed bled is as ing bed ies sky happy analogy "
    "radically differently vileli conformably operator feudalism decisiveness callousness "
    + "x" * 60 + "ing " + "y" * 62 + "ing",
]


def test_analysis_agrees_with_sqlite(spark):
    base = sqlite3.connect(":memory:")
    for name, tokenizer in (("plain", "unicode61"), ("stemmed", "porter unicode61")):
        base.execute(f"create virtual table {name} using fts5(x, tokenize='{tokenizer}')")
        base.execute(f"create virtual table {name}_v using fts5vocab({name}, 'instance')")
        base.executemany(f"insert into {name}(rowid, x) values (?, ?)", enumerate(TEXTS))

    def expected(name):
        rows = base.execute(f"select doc, term from {name}_v order by doc, offset").fetchall()
        return [[t for d, t in rows if d == i] for i in range(len(TEXTS))]

    assert apply(spark, TEXTS, tokenize) == expected("plain")
    assert apply(spark, TEXTS, lambda c: stem_tokens(tokenize(c))) == expected("stemmed")
    flat = [t for text in expected("plain") for t in text]
    assert apply(spark, flat, stem_column) == [t for text in expected("stemmed") for t in text]


def test_empty_token_lists(spark):
    assert apply(spark, ["", None, "a"], lambda c: stem_tokens(tokenize(c))) == [[], [], ["a"]]


@pytest.mark.parametrize("word, stem", [("relational", "relat"), ("ponies", "poni"), ("ies", "ie")])
def test_published_stems(word, stem):
    assert stem_word(word) == stem


def test_tokens_of_a_batch_are_grouped_in_bounded_slices(monkeypatch):
    """A batch of many rows is answered slice by slice; a row longer than a slice is whole."""
    rows = [[["a", "b", "a"], [], ["c"]], [[], [], []], [["b"] * 50, ["x", "b"], []], [["a"], ["a"], ["a"]]] * 3
    batch = pa.array(rows, pa.list_(pa.list_(pa.string())))
    monkeypatch.setattr(analysis, "SLICE_TOKENS", 8)
    parts = list(analysis._grouped_columns(iter([batch.slice(1), batch.slice(0, 0)]), stem=False))
    assert len(parts) > 5
    found = [[[(g["token"], g["positions"]) for g in column] for column in row] for part in parts for row in part.to_pylist()]
    plain = [[{t: [i for i, u in enumerate(column) if u == t] for t in column} for column in row] for row in rows[1:]]
    assert [[dict(column) for column in row] for row in found] == plain


def test_an_index_groups_each_page_once(spark, capsys):
    pages = spark.createDataFrame([(1, "a b", "a a", ""), (1, None, "c", "u"), (None, "", "", None)], "page_id long, title string, text string, url string")
    postings = build_index(pages, stem=False).postings
    postings.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    rows = sorted((r.page_id, r.col, r.token, r.positions) for r in postings.collect())
    assert rows == [(1, 0, "a", [0]), (1, 0, "b", [1]), (1, 1, "a", [0, 1]), (1, 1, "c", [0]), (1, 2, "u", [0])]


def test_markup_patterns_try_alternatives_behind_a_bracket_only(spark):
    """They match what the alternatives one by one match."""
    plain = {
        "_IGNORED": r"(?is)<!--.*?-->|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<noscript\b.*?</noscript\s*>",
        "_NOT_SHOWN": r"(?is)<template\b.*?</template\s*>|<rt\b.*?</rt\s*>|<rp\b.*?</rp\s*>",
        "_TAG": r"""<[A-Za-z/!?](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|<[A-Za-z/!?][^>]*>""",
    }
    odd = ["", "a < b <!-- c <script> --> d", "x<SCRIPT a='>'>y</script >z<style>open", "<noscript>open <rt>r</RT><rp", "<template><b>\n</template>t",
           "<a title='>' b>c</a>", '<a title="open>c</a>', "<a 'x'<b>c", "</p><?x?><!d><1>", "<!-- open <style>s</style>"]
    for name, pattern in plain.items():
        assert re.match(r"(\(\?is\))?<(\[[^]]*\])?\(\?:", getattr(html, name))
        found, wanted = (apply(spark, odd, lambda c, p=p: F.regexp_replace(c, p, "#")) for p in (getattr(html, name), pattern))
        assert found == wanted
