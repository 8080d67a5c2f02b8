"""HTML column functions: title, visible text, links, post date.

All of it is regular expressions and array functions, so that extraction stays
inside the scan stage and never leaves the JVM. The patterns do not need
balanced markup.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.columns import as_column, let, strip
from linkloom.functions.urls import base_parts, canonical_url, resolve_url

# Marks the place of removed markup. It cannot occur in HTML text.
_GAP = "\x01"

# The bracket stands before the alternatives, so that a place without one is tried once.
_IGNORED = (
    r"(?is)<(?:!--.*?-->"
    r"|script\b.*?(?:</script\s*>|\z)"
    r"|style\b.*?(?:</style\s*>|\z)"
    r"|noscript\b.*?</noscript\s*>)"
)
_NOT_SHOWN = r"(?is)<(?:template\b.*?</template\s*>|rt\b.*?</rt\s*>|rp\b.*?</rp\s*>)"
# The possessive groups step over quoted attribute values without recursion.
_TAG = r"""<[A-Za-z/!?](?:(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)"""
_TITLE = r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)"
_ATTRIBUTES = r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+"""
# Attributes of every anchor; unbalanced quotes end at the next bracket.
_ANCHOR = rf"(?is)<a(\s(?:{_ATTRIBUTES}(?=>)|[^>]*))>"
_ENTITY_PIECES = r"(&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?|[^&]+|&)"

_FREQUENT_FIRST = ("amp", "lt", "gt", "quot", "nbsp")


def _entity_map() -> Column:
    """Named entities as one map literal, the frequent names first."""
    names = [*_FREQUENT_FIRST, *(n for n in name2codepoint if n not in _FREQUENT_FIRST)]
    pairs = [f"{n}\x03{chr(name2codepoint[n])}" for n in names] + ["apos\x03'"]
    return F.str_to_map(F.lit("\x02".join(pairs)), F.lit("\x02"), F.lit("\x03"))


def _c1_pairs() -> tuple[str, str]:
    """Numeric references 128 to 159 are read as Windows-1252, as browsers do."""
    pairs = [(chr(i), bytes([i]).decode("cp1252", "ignore")) for i in range(128, 160)]
    return "".join(a for a, b in pairs if b), "".join(b for _, b in pairs if b)


def decode_entities(col: Column | str) -> Column:
    """Replace ``&name;``, ``&#n;`` and ``&#xh;``; unknown names stay as written."""
    entities = _entity_map()
    wrong, right = _c1_pairs()

    def numeric(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#[xX]?0*([0-9a-fA-F]{0,8})", 1)
        hexa = F.when(
            F.lower(F.substr(piece, F.lit(3), F.lit(1))) == "x", F.upper(digits)
        ).otherwise(F.conv(digits, 10, 16))
        code = F.conv(hexa, 16, 10).cast("long")
        usable = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.when(usable, hexa), 8, "0")), "UTF-32")
        return F.coalesce(F.translate(char, wrong, right), F.lit("�"))

    def piece_text(piece: Column) -> Column:
        name = F.rtrim(F.substr(piece, F.lit(2)), F.lit(";"))
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            .when(piece.startswith("&#"), numeric(piece))
            .otherwise(F.coalesce(F.try_element_at(entities, name), piece))
        )

    text = as_column(col)
    pieces = F.regexp_extract_all(text, F.lit(_ENTITY_PIECES), F.lit(1))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, piece_text), "")).otherwise(text)


def strip_ignored(html: Column | str) -> Column:
    """HTML without comments, scripts, styles and noscript blocks."""
    return F.regexp_replace(as_column(html), _IGNORED, _GAP)


def _text_of(markup: Column) -> Column:
    nodes = F.split(decode_entities(F.regexp_replace(markup, _TAG, _GAP)), _GAP)
    return F.array_join(F.filter(F.transform(nodes, strip), lambda n: n != ""), " ")


def page_title(stripped: Column) -> Column:
    """Text of the first title element; null when there is none."""
    inner = F.regexp_extract(stripped, _TITLE, 1)
    return F.when(stripped.rlike(r"(?i)<title\b[^>]*>"), _text_of(inner))


def page_text(stripped: Column) -> Column:
    """All text nodes (title included), each trimmed, joined by one blank."""
    return _text_of(F.regexp_replace(stripped, _NOT_SHOWN, _GAP))


def _up_to(name: str) -> str:
    """Pattern of the attributes before the one of a name. Values, quoted or not, are stepped over."""
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""
    return rf"""(?:\s++(?!{name}\b\s*=)[^\s=>"']++(?:\s*+=\s*+{value})?+)*+"""


def _attribute(attributes: Column, name: str) -> Column:
    """Decoded value of an attribute, empty without one."""
    pattern = rf"""(?is)^{_up_to(name)}\s++{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
    quoted = F.regexp_extract(attributes, pattern, 1)
    return decode_entities(F.regexp_replace(quoted, r"""(?s)^(["'])(.*)\1\z""", "$2"))


def page_links(stripped: Column, url: Column | str) -> Column:
    """Canonical absolute link targets in order of first occurrence."""
    anchors = F.regexp_extract_all(stripped, F.lit(_ANCHOR), F.lit(1))

    def targets(base: Column) -> Column:
        hrefs = F.filter(F.transform(anchors, lambda a: _attribute(a, "href")), lambda h: h != "")
        return F.filter(
            F.transform(hrefs, lambda h: canonical_url(resolve_url(base, h))),
            lambda u: u.isNotNull(),
        )

    return F.array_distinct(let(base_parts(url), targets))


def _with_class(token: str) -> str:
    """Pattern of the attributes of a start tag whose class lists ``token``."""
    return (
        _up_to("class")
        + rf"""\s++class\s*+=\s*+(?:"(?:[^"]*\s)?{token}(?:\s[^"]*)?\""""
        + rf"""|'(?:[^']*\s)?{token}(?:\s[^']*)?'|{token}(?=[\s>/])){_ATTRIBUTES}"""
    )


_DATE_BLOCK = rf"(?is)<div{_with_class('post_meta')}>(.*)"
_DATE_ELEMENT = rf"(?is)<([a-z][a-z0-9]*)({_with_class('post_date')})>(.*)"


def _body(rest: Column, name: Column, end: str) -> Column:
    """The part of ``rest`` up to the tag that closes the element of this name before it.

    ``end`` stands for its inner end tags in the result.
    """
    start_tag = F.concat(F.lit("(?i)<"), name, F.lit(r"(?=[\s/>])"))
    end_tag = F.concat(F.lit("(?i)</"), name, F.lit(r"\s*>"))

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.regexp_count(part, start_tag) - 1
        return F.struct(
            F.when(acc["depth"] > 0, depth).otherwise(acc["depth"]).alias("depth"),
            F.when(acc["depth"] > 0, acc["parts"] + 1).otherwise(acc["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("parts"))
    return let(
        F.split(rest, end_tag),
        lambda parts: F.array_join(
            F.slice(parts, F.lit(1), F.reduce(parts, start, step, lambda a: a["parts"])),
            end,
        ),
    )


def raw_post_date(stripped: Column) -> Column:
    """Date text of the first ``post_date`` element in the first ``post_meta`` div."""

    def from_block(block: Column) -> Column:
        name, attributes, rest = (F.regexp_extract(block, _DATE_ELEMENT, i) for i in (1, 2, 3))
        stamp = _attribute(attributes, "datetime")
        return F.when(
            block.rlike(_DATE_ELEMENT), F.when(stamp != "", stamp).otherwise(_text_of(_body(rest, name, "</x>")))
        )

    return F.when(
        stripped.contains("post_meta"),
        let(_body(F.regexp_extract(stripped, _DATE_BLOCK, 1), F.lit("div"), "</div>"), from_block),
    )
