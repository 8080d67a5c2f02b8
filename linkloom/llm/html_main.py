"""Main text of web pages: declared articles, and unique runs of the host's token streams.

Pages are read as blocks of text with the elements they lie in. A block within a
declared article (or main element) is kept as it is. Blocks elsewhere form the token
streams of their host. The streams of a host are concatenated per task and put into
a suffix array, whose equal neighbours give the windows of ``RUN`` tokens and the
number of distinct pages with each. These counts are summed over all tasks, so a
host of any size is handled and no task sees more than its share. A window on at
least ``PAGES`` pages repeats; every longer repeated substring consists of such
windows. On a page without a declared article, tokens that repeats cover are
boilerplate, and the blocks that are mostly unique runs are the text. Menus, footers
and the like, named by their elements or classes, never are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import as_texts, column_of, parts
from linkloom.sources.lineage import cut

#: Tokens of a window, pages from which on it repeats, and the covered share that makes a block boilerplate.
RUN, PAGES, COVERED = 6, 3, 0.5
#: Tokens that a task puts into one suffix array.
STREAM = 1_000_000
#: Pages with covered blocks that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 50_000

_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = set("aside button datalist dialog fieldset footer form head header iframe input label menu nav noscript option script search select style svg template textarea title".split())
_CLOSES_P = _BLOCKS - {"body", "html", "head"}
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banners?|sidebars?|menus?|nav|navbar|navigation|cookies?|notices?|consent|gdpr|newsletter|promo\w*|sponsor\w*|share|sharing|social|"
    r"recommend\w*|comments?|respond|replies|disqus|breadcrumbs?|footer|masthead|header|popup|modal|overlay|subscribe|login|signup|widget|toolbar|pagination|pager|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: "related" says so little beside other words that only these forms count.
_RELATED = re.compile(r"(?:^|\s)related(?:[_-]?(?:posts?|articles?|stories|links|content|items|news|pages|reading))?(?:$|\s)", re.IGNORECASE)
#: Names that say what an element has or lacks, not what it is.
_ABOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[_-]\S*", re.IGNORECASE)
_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
#: A tag whose quotes do not close ends at the next bracket; nothing is read twice for it.
_TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|$)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.IGNORECASE)

#: Where a block lies: in a declared article, in an element that is never text, or neither.
INSIDE, NEVER, FREE = 0, 1, 2
Block = tuple[str, int]


def _never(name: str, attributes: str) -> bool:
    if name in _NEVER:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key in ("class", "id"):
            named = _ABOUT.sub("", value)
            if _NAMED.search(named) or _RELATED.search(named):
                return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Blocks of text of a page in order, with where they lie.

    Unclosed, crossed and cut-off tags are tolerated: an end tag closes everything
    down to its start tag, or nothing if there is none, and a block element closes
    an open paragraph. Text in an article counts as inside it, in a main element
    only if the page has no article. An inline element that is never text leaves the
    rest of its block together.
    """
    found: list[tuple[str, int, int, int]] = []
    pieces: list[tuple[str, bool]] = []
    stack: list[tuple[str, int]] = []
    depth = {"never": 0, "article": 0, "main": 0}
    paragraph = at = 0

    def flush() -> None:
        for hidden in (False, True):
            text = " ".join(html.unescape("".join(t for t, h in pieces if h == hidden)).split())
            if text:
                found.append((text, int(hidden), depth["article"], depth["main"]))
        pieces.clear()

    def marks(name: str, never: int) -> Iterator[str]:
        if never:
            yield "never"
        elif name in ("article", "main"):
            yield name

    def close(count: int) -> None:
        nonlocal paragraph
        for _ in range(count):
            name, never = stack.pop()
            paragraph -= name == "p"
            for mark in marks(name, never):
                depth[mark] -= 1

    while m := _TAG.search(page, at):
        if m.start() > at:
            pieces.append((page[at : m.start()], depth["never"] > 0))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _BLOCKS or name in _RAW:
            flush()
        elif name == "br":
            pieces.append((" ", depth["never"] > 0))
        if m[1]:
            for back, (open_, _) in enumerate(reversed(stack), 1):
                if open_ == name:
                    close(back)
                    break
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID or m[3].endswith("/") and name in ("svg", "path", "use"):
            continue
        if paragraph and name in _CLOSES_P:
            close(next(k for k, (open_, _) in enumerate(reversed(stack), 1) if open_ == "p"))
        never = int(_never(name, m[3]))
        stack.append((name, never))
        paragraph += name == "p"
        for mark in marks(name, never):
            depth[mark] += 1
    pieces.append((page[at:], depth["never"] > 0))
    flush()
    articles = any(article and not never for _, never, article, _ in found)
    return [(text, NEVER if never else INSIDE if (article if articles else main) else FREE) for text, never, article, main in found]


def host(url: Column) -> Column:
    """Lower-case host of a URL, empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


# streams and suffix arrays


def _stream(found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of the blocks outside declared articles, and the block of each; a block starts with a mark."""
    tokens, owner = [], []
    for k, (text, where) in enumerate(found):
        if where != INSIDE:
            words = ["\n", *text.split()]
            tokens += [xxhash.xxh64_intdigest(w) for w in words]
            owner += [k] * len(words)
    return np.array(tokens, np.uint64), np.array(owner, np.int64)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def window_numbers(tokens: np.ndarray, size: int = RUN) -> np.ndarray:
    """A number for the window that starts at each token; equal windows have equal numbers everywhere."""
    n = len(tokens) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        total = total * _BASE + tokens[k : k + max(n, 0)]
    return (total ^ (total >> np.uint64(31))) * _BASE


def suffix_order(tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``size`` tokens or more, and the rank of each, by prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, reach = np.argsort(rank, kind="stable"), 1
    while reach < size:
        after = np.full(len(rank), -1, np.int64)
        after[:-reach] = rank[reach:]
        order = np.lexsort((after, rank))
        fresh = np.r_[0, (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(fresh)
        reach *= 2
    return order, rank


def repeated_windows(streams: list[np.ndarray], size: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct windows of one host's streams, and on how many of them each occurs."""
    gap = np.arange(len(streams), dtype=np.uint64)  # ends every stream with a token of its own
    joined = np.concatenate([np.r_[s, g] for s, g in zip(streams, gap, strict=True)])
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    left = np.concatenate([np.arange(len(s), -1, -1) for s in streams])
    order, rank = suffix_order(joined, size)
    order = order[left[order] >= size]
    numbers = np.concatenate([np.r_[window_numbers(s, size), np.zeros(len(s) + 1 - max(0, len(s) - size + 1), np.uint64)] for s in streams])[order]
    if not len(order):
        return numbers, numbers.astype(np.int64)
    # equal windows are neighbours; of each, count the changes of page
    group = np.cumsum(np.r_[0, numbers[1:] != numbers[:-1]])
    by_page = np.unique(np.stack([group, page[order]], axis=1), axis=0)
    counts = np.bincount(by_page[:, 0])
    return numbers[np.r_[True, numbers[1:] != numbers[:-1]]], counts


def _streams(batches):
    """The token stream of each page, and a digest of all its text, by which copies are told."""
    for batch in parts(batches):
        streams, digests = [], []
        for page in as_texts(column_of(batch, "html")):
            found = blocks(page)
            streams.append(_stream(found)[0].tobytes())
            digests.append(xxhash.xxh3_128_digest("\n".join(text for text, _ in found)))
        yield pa.record_batch({"host": column_of(batch, "host"), "digest": pa.array(digests, pa.binary()), "stream": pa.array(streams, pa.binary())})


def _window_counts(batches):
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def out():
        for name, streams in held.items():
            numbers, pages = repeated_windows(streams)
            yield pa.record_batch({"host": pa.array([name] * len(numbers), pa.string()), "number": pa.array(numbers.view(np.int64)), "pages": pa.array(pages.astype(np.int64))})

    for batch in parts(batches):
        for name, data in zip(column_of(batch, "host").to_pylist(), column_of(batch, "stream").to_pylist(), strict=True):
            tokens = np.frombuffer(data, np.uint64)
            if len(tokens) >= RUN:
                held.setdefault(name, []).append(tokens)
                size += len(tokens)
            if size > STREAM:
                yield from out()
                held, size = {}, 0
    yield from out()


def _page_windows(batches):
    """Windows of the pages on which no block lies in a declared article."""
    for batch in parts(batches):
        for key, name, page in zip(column_of(batch, "page").to_pylist(), column_of(batch, "host").to_pylist(), as_texts(column_of(batch, "html")), strict=True):
            found = blocks(page)
            if any(where == INSIDE for _, where in found):
                continue
            numbers = window_numbers(_stream(found)[0])
            if len(numbers):
                yield pa.record_batch(
                    {
                        "page": pa.array([key] * len(numbers), pa.int64()),
                        "host": pa.array([name] * len(numbers), pa.string()),
                        "number": pa.array(numbers.view(np.int64)),
                        "at": pa.array(np.arange(len(numbers), dtype=np.int32)),
                    }
                )


def main_text(page: str, repeats: list[int] | None) -> str:
    """Text of a page, given where repeated windows start in its stream."""
    found = blocks(page)
    if any(where == INSIDE for _, where in found):
        return "\n\n".join(text for text, where in found if where == INSIDE)
    _, owner = _stream(found)
    covered = np.zeros(len(owner), bool)
    for at in repeats or ():
        covered[at : at + RUN] = True
    total, hidden = np.bincount(owner, minlength=len(found)), np.bincount(owner, weights=covered, minlength=len(found))
    return "\n\n".join(text for k, (text, where) in enumerate(found) if where == FREE and hidden[k] < COVERED * total[k])


def _texts(batches):
    for batch in parts(batches):
        texts = [main_text(p, r) for p, r in zip(as_texts(column_of(batch, "html")), column_of(batch, "repeats").to_pylist(), strict=True)]
        yield pa.record_batch(
            {"page_id": column_of(batch, "page_id"), "url": column_of(batch, "url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}
        )


def repeats_of(rows: DataFrame) -> DataFrame:
    """host, number: windows on at least ``PAGES`` distinct pages of a host of ``rows`` (host, html).

    Pages of a host with the same text are one page.
    """
    streams = rows.select("host", "html").mapInArrow(_streams, "host string, digest binary, stream binary")
    alone = streams.dropDuplicates(["host", "digest"]).select("host", "stream")
    counts = alone.mapInArrow(_window_counts, "host string, number long, pages long")
    return counts.groupBy("host", "number").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= PAGES)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null page is an empty one. A page without text has an empty text. A null or
    broken url belongs to the host without name. Pages of a host with the
    same text count as one page of it, and all get a row. Other columns are not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    rows = rows.withColumns({"host": host(F.col("url")), "page": F.xxhash64("page_id", "url", "html")})
    repeats = cut(repeats_of(rows))
    windows = rows.select("page", "host", "html").mapInArrow(_page_windows, "page long, host string, number long, at int")
    hits = windows.distinct().join(repeats.select("host", "number"), ["host", "number"])
    covered = cut(hits.groupBy("page").agg(F.collect_list("at").alias("repeats")))
    covered = F.broadcast(covered) if covered.count() <= MOST_BROADCAST else covered
    marked = rows.join(covered, "page", "left").select("page_id", "url", "html", "repeats")
    return marked.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
