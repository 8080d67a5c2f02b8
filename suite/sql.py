"""SQL texts shared by the oracle queries. Written for DuckDB."""

from __future__ import annotations

from suite.fixtures import FETCH_LOG, ROBOTS

BLANKS = "concat(' ', chr(9), chr(10), chr(13), chr(160))"


def canonical(url: str) -> str:
    """Canonical form of an SQL string expression, null if not http(s)."""
    bare = f"trim(regexp_replace({url}, '#.*$', ''), {BLANKS})"
    site = f"lower(regexp_extract({bare}, '^(?i:https?)://[^/?]+'))"
    path = f"regexp_extract({bare}, '^[^:]+://[^/?]+([^?]*)', 1)"
    path = f"regexp_replace(regexp_replace({path}, ';[^/]*$', ''), '/+', '/', 'g')"
    return (
        f"CASE WHEN regexp_matches({bare}, '^(?i:https?)://[^/?]+') THEN concat("
        f"CASE WHEN {site} LIKE 'http:%' THEN regexp_replace({site}, ':80$', '')"
        f" ELSE regexp_replace({site}, ':443$', '') END,"
        f" CASE WHEN {path} = '' THEN '/' ELSE {path} END,"
        f" regexp_extract({bare}, '\\?.+$')) END"
    )


def decoded(text: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return text


def stripped(html: str) -> str:
    return (
        f"regexp_replace({html}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>"
        f"|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>', chr(1), 'g')"
    )


def text_of(markup: str) -> str:
    nodes = decoded(f"regexp_replace({markup}, '<[^>]*>', chr(1), 'g')")
    return (
        f"array_to_string(list_filter(list_transform(string_split({nodes}, chr(1)),"
        f" lambda x: trim(x, {BLANKS})), lambda x: x <> ''), ' ')"
    )


def title(strip: str) -> str:
    inner = text_of(f"regexp_extract({strip}, '(?is)<title[^>]*>(.*?)</title', 1)")
    return f"CASE WHEN regexp_matches({strip}, '(?i)<title') THEN {inner} END"


def parsed_date(raw: str) -> tuple[str, str]:
    """(UTC timestamp, ISO text) of a date text."""
    text = (
        f"trim(regexp_replace(regexp_replace(regexp_replace(trim({raw}),"
        f" '(?i)^(posted on|published on|published|posted)\\s*:?', ''),"
        f" '(\\d)(st|nd|rd|th)', '\\1'), '(Z| UTC| GMT)$', ''))"
    )
    offset = f"regexp_extract({text}, 'T.*([+-]\\d\\d:\\d\\d)$', 1)"
    local = f"regexp_replace({text}, '(T.*)[+-]\\d\\d:\\d\\d$', '\\1')"
    formats = (
        "%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S",
        "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S", "%b %d, %Y", "%B %d, %Y", "%B %d, %Y %H:%M",
    )
    stamp = f"try_strptime({local}, [{', '.join(repr(f) for f in formats)}])"
    hours = f"coalesce(try_cast(nullif(left({offset}, 3), '') AS INTEGER), 0)"
    iso = (
        f"concat(strftime({stamp}, '%Y-%m-%dT%H:%M:%S'),"
        f" CASE WHEN {offset} = '' THEN '+00:00' ELSE {offset} END)"
    )
    return f"{stamp} - to_hours({hours})", f"CASE WHEN {stamp} IS NOT NULL THEN {iso} END"


def stamp(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


# Page table with canonical URL, title and text, straight from the given pages.
PAGE_TEXTS = f"""
raw AS (SELECT page_id, {canonical("url")} AS url, {stripped("html")} AS s, html FROM pages),
docs AS (SELECT page_id, url, {title("s")} AS title, {text_of("s")} AS text, s, html FROM raw)"""

CLEANED = f"""{FETCH_LOG},
cleaned AS (
  SELECT page_id, {canonical("url")} AS url, rnd, status, html, fetched_at,
    CASE WHEN {canonical("url")} IS NULL THEN 'bad-url'
         WHEN status IN (404, 302) THEN concat('status-', status)
         WHEN coalesce(content_type, '') <> '' AND content_type NOT ILIKE '%html%' THEN 'non-html'
         WHEN html IS NULL THEN coalesce(error, 'no-html')
         WHEN strlen(html) > 2000000 THEN 'too-large' END AS drop_reason
  FROM fetch_log),
kept AS (SELECT page_id, url, rnd, status, html, fetched_at, sha256(html) AS content_hash
         FROM cleaned WHERE drop_reason IS NULL)"""

_DATE = "regexp_extract(s, '(?is)<div class=\"post_meta\">(.*?)</div>', 1)"
_RAW_DATE = (
    f"CASE WHEN {_DATE} LIKE '%datetime=%' THEN regexp_extract({_DATE}, 'datetime=\"([^\"]*)\"', 1)"
    f" ELSE nullif({text_of(_DATE)}, '') END"
)
PARSED = f"""{CLEANED},
strips AS (SELECT *, {stripped("html")} AS s FROM kept),
dates AS (SELECT *, {_RAW_DATE} AS raw_date FROM strips),
parsed AS (SELECT page_id, url, rnd, status, html, fetched_at, content_hash, s,
                  {title("s")} AS title, {text_of("s")} AS text,
                  {parsed_date("raw_date")[0]} AS post_date,
                  {parsed_date("raw_date")[1]} AS post_date_iso FROM dates)"""


def hrefs(source: str) -> str:
    """(page_id, url, ..., pos, to_url) of a table with columns url and s."""
    href = "href"
    absolute = (
        f"CASE WHEN {href} LIKE '//%' THEN concat(split_part(url, ':', 1), ':', {href})"
        f" WHEN {href} LIKE '/%' THEN concat(regexp_extract(url, '^[^:]+://[^/]+'), {href})"
        f" ELSE {href} END"
    )
    return f"""
hrefs AS (
  SELECT * EXCLUDE (l), unnest(l) AS href, unnest(range(len(l))) AS pos
  FROM (SELECT *, list_transform(regexp_extract_all(s, '(?is)<a\\s[^>]*?href\\s*=\\s*"([^"]+)"', 1),
                                 lambda x: {decoded("x")}) AS l FROM {source})),
targets AS (SELECT * EXCLUDE (href), {canonical(absolute)} AS to_url FROM hrefs),
firsts AS (SELECT page_id, url, fetched_at, to_url, min(pos) AS pos
           FROM targets WHERE to_url IS NOT NULL GROUP BY ALL)"""


STORED = f"""{PARSED},
ids AS (SELECT url, min(page_id) AS id FROM parsed GROUP BY url),
latest AS (
  SELECT url, arg_max(content_hash, fetched_at) AS content_hash, arg_max(status, fetched_at) AS status_code,
         arg_max(title, fetched_at) AS title, arg_max(text, fetched_at) AS text, max(fetched_at) AS fetched_at,
         arg_max(post_date_iso, fetched_at) FILTER (post_date_iso IS NOT NULL) AS post_date_iso
  FROM parsed GROUP BY url),
stored AS (SELECT id AS page_id, latest.* FROM latest JOIN ids USING (url))"""

LINKS = f"""{STORED},{hrefs("parsed")},
links AS (
  SELECT i.id AS from_page_id, f.to_url, t.id AS to_page_id,
         min(f.fetched_at) AS first_seen_at, max(f.fetched_at) AS last_seen_at
  FROM firsts f JOIN ids i ON i.url = f.url LEFT JOIN ids t ON t.url = f.to_url GROUP BY ALL)"""


def token_list(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({text}, ''))), '[\\p{{L}}\\p{{N}}]+')"


# Needs a table ``docs`` (page_id, title, text, url).
TOKENS = f"""
lists AS (SELECT page_id, 0 AS col, {token_list("title")} AS l FROM docs
          UNION ALL SELECT page_id, 1, {token_list("text")} FROM docs
          UNION ALL SELECT page_id, 2, {token_list("url")} FROM docs),
tok AS (SELECT page_id, col, unnest(l) AS token, unnest(range(len(l))) AS pos FROM lists),
lens AS (SELECT page_id, sum(len(l)) AS doc_len FROM lists GROUP BY page_id),
corpus AS (SELECT count(*) AS n_docs, sum(doc_len) AS total_len, avg(doc_len) AS avg_len FROM lens)"""


def term(token: str, where: str = "true") -> str:
    return f"SELECT page_id, count(*) AS f FROM tok WHERE token = '{token}' AND {where} GROUP BY page_id"


def prefix(head: str) -> str:
    return f"SELECT page_id, count(*) AS f FROM tok WHERE starts_with(token, '{head}') GROUP BY page_id"


def phrase(first: str, second: str, where: str = "true") -> str:
    return (
        f"SELECT a.page_id, count(*) AS f FROM tok a JOIN tok b ON a.page_id = b.page_id"
        f" AND a.col = b.col AND b.pos = a.pos + 1"
        f" WHERE a.token = '{first}' AND b.token = '{second}' AND {where} GROUP BY a.page_id"
    )


def near(one: str, other: str, slop: int) -> str:
    return (
        f"SELECT page_id, sum(CASE WHEN EXISTS (SELECT 1 FROM tok b WHERE b.page_id = a.page_id"
        f" AND b.col = a.col AND b.token = '{other}' AND abs(a.pos - b.pos) - 1 <= {slop})"
        f" THEN 1 ELSE 0 END) AS f FROM tok a WHERE token = '{one}' GROUP BY page_id"
    )


def scores(phrases: list[tuple[int, int, str, str]], weight_of_f: str = "f") -> str:
    """CTEs up to ``scored`` (query_id, page_id, score).

    Each phrase is (query, group, op, hits SQL giving page_id and f).
    """
    union = " UNION ALL ".join(
        f"SELECT {q} AS query_id, {i} AS phrase, {g} AS group_id, '{op}' AS op, page_id, f FROM ({hits})"
        for i, (q, g, op, hits) in enumerate(phrases)
    )
    needed: dict[int, set[int]] = {}
    for q, g, op, _ in phrases:
        if op != "not":
            needed.setdefault(q, set()).add(g)
    groups = ", ".join(f"({q}, {len(g)})" for q, g in needed.items())
    idf = "ln((n_docs - n + 0.5) / (n + 0.5))"
    return f"""
ph AS ({union}),
df AS (SELECT phrase, count(*) AS n FROM ph GROUP BY phrase),
need(query_id, n_groups) AS (VALUES {groups}),
parts AS (
  SELECT query_id, group_id, op, page_id, f,
         -(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END)
           * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * doc_len / avg_len)) AS part
  FROM ph JOIN df USING (phrase) JOIN lens USING (page_id) CROSS JOIN corpus WHERE f > 0),
scored AS (
  SELECT query_id, page_id, sum(part) FILTER (op <> 'not') AS score
  FROM parts JOIN need USING (query_id)
  GROUP BY query_id, page_id, n_groups
  HAVING count(DISTINCT group_id) FILTER (op <> 'not') = n_groups
     AND count(*) FILTER (op = 'not') = 0)"""


TOP = """
SELECT query_id, place, page_id, round(score, 4) + 0.0 AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, page_id) AS place FROM scored)
WHERE place <= 10"""

__all__ = [n for n in dir() if not n.startswith("_")] + ["ROBOTS"]
