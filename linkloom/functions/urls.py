"""URL column functions: canonical form, host, origin, relative links.

``parse_url`` is not used: it follows Java's strict parser and fails on links
that are common on the web. Plain string functions cover the split and stay
cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.columns import as_column, let, strip

_CONTROL_OR_SPACE = "".join(map(chr, range(0x21)))


def _bare(raw: Column) -> Column:
    """The URL without fragment, line breaks, tabs and outer white space."""
    no_breaks = F.translate(raw, "\t\r\n", "")
    return F.ltrim(strip(F.substring_index(no_breaks, "#", 1)), F.lit(_CONTROL_OR_SPACE))


def canonical_url(url: Column | str) -> Column:
    """Canonical http(s) URL, or null when the input is not one.

    Scheme and host go to lower case, default ports, fragments, ``;params`` of
    the last segment and an empty query are dropped, repeated slashes of the
    path collapse. The query is kept as written.
    """

    def build(bare: Column, head: Column) -> Column:
        scheme = F.lower(F.substring_index(head, ":", 1))
        rest = F.substr(head, F.length(scheme) + 4)
        raw_netloc = F.substring_index(rest, "/", 1)
        netloc = F.lower(raw_netloc)
        default_port = (
            F.when((scheme == "http") & netloc.endswith(":80"), 3)
            .when((scheme == "https") & netloc.endswith(":443"), 4)
            .otherwise(0)
        )
        path = F.substr(rest, F.length(raw_netloc) + 1)
        path = F.regexp_replace(F.regexp_replace(path, r";[^/]*\z", ""), "/{2,}", "/")
        query = F.substr(bare, F.length(head) + 2)
        valid = (
            scheme.isin("http", "https")
            & (F.substr(head, F.length(scheme) + 1, F.lit(3)) == "://")
            & (raw_netloc != "")
            & (raw_netloc.contains("[") == raw_netloc.contains("]"))
        )
        return F.when(
            valid,
            F.concat(
                scheme,
                F.lit("://"),
                F.left(netloc, F.length(netloc) - default_port),
                F.when(path == "", F.lit("/")).otherwise(path),
                F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
            ),
        )

    return let(
        _bare(as_column(url)),
        lambda bare: let(F.substring_index(bare, "?", 1), lambda head: build(bare, head)),
    )


def netloc(url: Column | str) -> Column:
    """Lower-case authority (host with port and user info); '' if there is none."""
    return F.lower(F.regexp_extract(as_column(url), r"^[^:/?#]+://([^/?#]*)", 1))


def origin(url: Column | str) -> Column:
    """``scheme://authority`` as robots.txt files are keyed."""
    return F.regexp_extract(as_column(url), r"^([^:/?#]+://[^/?#]*)", 1)


def path_and_query(url: Column | str) -> Column:
    """What follows the origin: path plus query, at least ``/``."""
    tail = F.regexp_replace(as_column(url), r"^[^:/?#]+://[^/?#]*", "")
    return F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))


def base_parts(base: Column | str) -> Column:
    """Pieces of a page URL that resolving its links needs, computed once per page."""

    def pieces(bare: Column) -> Column:
        site = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
        tail = F.substr(bare, F.length(site) + 1)
        path = F.substring_index(tail, "?", 1)
        return F.struct(
            F.lower(F.substring_index(bare, ":", 1)).alias("scheme"),
            site.alias("site"),
            path.alias("path"),
            F.concat(F.lit("/"), F.regexp_replace(path, r"[^/]*\z", "")).alias("folder"),
            F.substr(tail, F.length(path) + 1).alias("query"),
        )

    return let(_bare(as_column(base)), pieces)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..``; extra ``..`` stop at the root."""

    def fold(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    # The part before the leading slash is empty; a final dot segment leaves a folder.
    segments = F.slice(F.split(path, "/"), F.lit(2), F.length(path) + 1)
    kept = F.reduce(segments, F.array().cast("array<string>"), fold)
    folder = F.when(path.rlike(r"/\.{1,2}\z"), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    resolved = F.concat(F.lit("/"), F.array_join(F.concat(kept, folder), "/"))
    return F.when(path.rlike(r"/\.{1,2}(/|\z)"), resolved).otherwise(path)


def resolve_url(base: Column, href: Column | str) -> Column:
    """Absolute form of ``href`` seen from a page; ``base`` comes from ``base_parts``.

    The fragment is dropped, since the canonical form never keeps it.
    """

    def relative(rel: Column) -> Column:
        path = F.substring_index(rel, "?", 1)
        query = F.substr(rel, F.length(path) + 1)
        return (
            F.when(rel.startswith("//"), F.concat(base["scheme"], F.lit(":"), rel))
            .when(
                path == "",
                F.concat(
                    base["site"],
                    base["path"],
                    F.when(F.length(query) > 1, query).otherwise(base["query"]),
                ),
            )
            .otherwise(
                F.concat(
                    base["site"],
                    _without_dots(
                        F.when(path.startswith("/"), path).otherwise(
                            F.regexp_replace(F.concat(base["folder"], path), "/{2,}", "/")
                        )
                    ),
                    query,
                )
            )
        )

    def resolve(bare: Column) -> Column:
        scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        after = F.substr(bare, F.length(scheme) + 2)
        return (
            F.when(scheme == "", relative(bare))
            .when((scheme == base["scheme"]) & ~after.startswith("//"), relative(after))
            .otherwise(bare)
        )

    return let(_bare(as_column(href)), resolve)
