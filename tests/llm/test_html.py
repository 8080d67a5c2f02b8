"""Main text of declared articles, and of pages that only their host gives away."""

import html as entities
import re
import time

import numpy as np

from linkloom.llm import html_main
from linkloom.llm.queries import QUERIES


def text(page):
    return html_main.main_text(page, None)


def test_declared_articles():
    assert text('<body><nav>m</nav><article><h1>T &amp; t</h1><p>a<b> b<br>c<p>d <i>e</i>f</article><footer>x</footer>') == "T & t\n\na b c\n\nd ef"
    assert text("<main><p>lead</p><article>one</article><article>two</article></main>") == "one\n\ntwo"
    assert text("<main><div>only main</div></main><p>outside</p>") == "only main"
    assert text('<article><p>a</p><aside>no</aside><div class="ad-box">no</div><div id="comments">no</div><form>no</form><p>b') == "a\n\nb"
    assert text('<article><script>var t="</p>";</script><style>p{}</style><!-- <p>no</p> --><p title="a > b">x  \n y</p></article>') == "x y"
    assert text('<body class="has-sidebar"><article class="post">a</article><article class="comment">b</article>') == "a"
    assert text("<article>cut <a href=") == "cut"
    assert text("") == text("<article></article>") == text("<!-- open") == ""
    assert text("<ul><li>a<li>b</ul></div></div>plain &am; &#233;&nbsp;x") == "a\n\nb\n\nplain &am; é x"


def test_names_and_inline_elements():
    assert text('<div class="content has-sidebar"><article><p>a</p></article></div>') == "a"
    assert text('<article class="post no-comments with_share"><section class="related-work">b</section></article>') == "b"
    assert text('<article><p>a</p><div class="related-posts">no</div><ul class="x related">no</ul></article>') == "a"
    assert text('<article><p>a</p><button>Share</button><p>b <label>no</label>c<span class="advert">no</span> d</p></article>') == "a\n\nb c d"


def test_broken_markup_takes_linear_time():
    """Quotes that never close, tags and comments without an end, on a megabyte each."""
    for broken in ('<a "', "<a '", "<a ", "<!--", "<", "<p class=", '<a x="'):
        page = "<article>text</article>" + broken * ((1 << 20) // len(broken))
        start = time.perf_counter()
        assert text(page).startswith("text")
        assert text(page + '"').startswith("text")
        assert time.perf_counter() - start < 10
    assert text('<article><a href="x>one</a><p>two</p></article>').endswith("two")


def test_suffix_windows_equal_a_plain_count():
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 3, n).astype(np.uint64) for n in (40, 25, 7, 6, 90)]
    numbers, pages = html_main.repeated_windows(streams, 6)
    want: dict[tuple, set] = {}
    for k, s in enumerate(streams):
        for at in range(len(s) - 5):
            want.setdefault(tuple(s[at : at + 6]), set()).add(k)
    by_number = {int(html_main.window_numbers(np.array(w, np.uint64), 6)[0]): len(p) for w, p in want.items()}
    assert dict(zip(numbers.tolist(), pages.tolist(), strict=True)) == by_number


def test_repeats_of_a_host(spark):
    """Pages without an article: what at least three pages of the host share goes, on that host only."""
    shared = "<div>Welcome to our little site about many things</div>"
    rows = [(k, f"http://Site.example/{k}", f"{shared}<div>Page number {k} tells its very own story {k} here</div>{shared}") for k in range(4)]
    rows += [(10, "http://other.example/", f"{shared}<p>Another site.</p>"), (11, None, None), (None, "x", ""), (0, "http://site.example/0", rows[0][2])]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_main.extract(pages).collect()), key=str)
    own = lambda k: f"Page number {k} tells its very own story {k} here"
    other = "Welcome to our little site about many things\n\nAnother site."
    want = [(k, own(k), len(own(k))) for k in (0, 0, 1, 2, 3)] + [(10, other, len(other)), (11, "", 0), (None, "", 0)]
    assert got == sorted(want, key=str)
    assert html_main.extract(pages.limit(0)).count() == 0


def test_query_equals_a_plain_reading(spark, sf_dir):
    got = {r.page_id: r for r in QUERIES["op5_html"][0](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = re.sub("<br>", " ", re.search("<article>(.*?)</article>", p.html, re.DOTALL)[1])
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        want = "\n\n".join(x for x in parts if x)
        assert (got[p.page_id].text, got[p.page_id].url, got[p.page_id].n_chars) == (want, p.url, len(want))


def test_repeats_on_pages_that_only_seem_to_declare_an_article(spark):
    shared = "<div>Welcome to our little site about many things</div>"
    odd = ['<article class="comment">c</article>', "<main></main>", "<script>'<main>'</script>", "<!-- <main> -->", '<p title="<article>"></p>']
    rows = [(k, "http://a.example/", f"{shared}{x}<div>Page number {k} tells its very own story {k} here</div>") for k, x in enumerate(odd)]
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Page number {k} tells its very own story {k} here" for k in range(5)}


def test_copies_of_a_page_keep_their_text(spark):
    """Copies are no repeats; a menu on distinct pages is, also beside a declared article."""
    page = "<div>One story of its own that is told on this page alone</div>"
    menu = "<div>Welcome to our little site about many things</div>"
    rows = [(k, None if k % 2 else f"http://a.example/{k}", page) for k in range(1000)]
    rows += [(k, "http://b.example/", f"{menu}<article>Article {k}</article>") for k in range(2000, 2003)]
    rows += [(3000, "http://b.example/x", menu + page)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    text = "One story of its own that is told on this page alone"
    assert got == {k: text for k in [*range(1000), 3000]} | {k: f"Article {k}" for k in range(2000, 2003)}
