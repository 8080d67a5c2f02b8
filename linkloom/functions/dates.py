"""Post-date normalization and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.columns import as_column, let, strip

_PREFIX = r"(?i)^(posted on|published on|published|posted)\s*:?"
_ORDINAL = r"(?i)(\d)(st|nd|rd|th)"

_OFFSET = r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?"
# Accepted shapes. ISO: full or compact date, or week date, then any one
# separator and a full or compact time. Loose: 1-digit fields. Named: month
# name first.
_ISO_DATE = r"(\d{4})-?(?:(\d{2})-?(\d{2})|W(\d{2})(?:-?([1-7]))?)"
_ISO_TIME = r"(?:[\s\S](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,}))?)?)?" + _OFFSET + r")?"
_ISO = "^" + _ISO_DATE + _ISO_TIME + r"\z"
_LOOSE = (
    r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})"
    r"(?:[\sT]+(\d{1,2}):(\d{1,2})(?::(\d{1,2})\s*(Z|[+-]\d{2}:?\d{2})?)?)?\z"
)
_NAMED = (
    r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april"
    r"|june|july|august|september|october|november|december)\s+(\d{1,2}),\s+(\d{4})"
    r"(?:\s+(\d{1,2}):(\d{1,2})(?:\s+(am|pm))?)?\z"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _number(text: Column, pattern: str, group: int, default: int = 0) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.coalesce(found.try_cast("int"), F.lit(default))


def _parsed(local: Column, offset: Column, micros: Column) -> Column:
    return F.struct(local.alias("local"), offset.alias("offset"), micros.alias("micros"))


def _moment(day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """NTZ timestamp from a date and time fields; null when a field is out of range."""
    fits = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    return F.when(
        fits,
        day.cast("timestamp_ntz")
        + F.make_dt_interval(F.lit(0), hour, minute, second.cast("decimal(18,6)")),
    )


def _day(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year > 0, text.try_cast("date"))


def _iso(text: Column) -> Column:
    year = _number(text, _ISO, 1)
    week = _number(text, _ISO, 4)
    first_week_day = _day(year, F.lit(1), F.lit(4))
    monday = F.date_sub(first_week_day, F.weekday(first_week_day))
    week_day = F.date_add(monday, (week - 1) * 7 + _number(text, _ISO, 5, 1) - 1)
    week_fits = (week > 0) & (F.weekofyear(week_day) == week)
    day = F.when(F.regexp_extract(text, _ISO, 4) != "", F.when(week_fits, week_day)).otherwise(
        _day(year, _number(text, _ISO, 2), _number(text, _ISO, 3))
    )
    moment = _moment(
        day, _number(text, _ISO, 6), _number(text, _ISO, 7), _number(text, _ISO, 8)
    )
    micros = F.left(F.rpad(F.regexp_extract(text, _ISO, 9), 6, "0"), F.lit(6)).cast("int")
    return F.when(text.rlike(_ISO), _parsed(moment, F.regexp_extract(text, _ISO, 10), micros))


def _loose(text: Column) -> Column:
    dashed = F.regexp_extract(text, _LOOSE, 2) == "-"
    dated_only = F.regexp_extract(text, _LOOSE, 5) == ""
    moment = _moment(
        _day(_number(text, _LOOSE, 1), _number(text, _LOOSE, 3), _number(text, _LOOSE, 4)),
        _number(text, _LOOSE, 5),
        _number(text, _LOOSE, 6),
        _number(text, _LOOSE, 7),
    )
    return F.when(
        text.rlike(_LOOSE) & (dashed | dated_only),
        _parsed(moment, F.regexp_extract(text, _LOOSE, 8), F.lit(0)),
    )


def _named(text: Column) -> Column:
    name = F.lower(F.left(text, F.lit(3)))
    month = ((F.instr(F.lit(_MONTHS), name) + 2) / 3).cast("int")
    half = F.lower(F.regexp_extract(text, _NAMED, 6))
    clock = _number(text, _NAMED, 4)
    hour = (
        F.when(half == "", clock)
        .when(clock.between(1, 12), clock % 12 + F.when(half == "pm", 12).otherwise(0))
        .otherwise(-1)
    )
    moment = _moment(
        _day(_number(text, _NAMED, 3), month, _number(text, _NAMED, 2)),
        hour,
        _number(text, _NAMED, 5),
        F.lit(0),
    )
    return F.when(text.rlike(_NAMED), _parsed(moment, F.lit(""), F.lit(0)))


def _offset_seconds(offset: Column) -> Column:
    digits = F.rpad(F.regexp_replace(offset, "[^0-9]", ""), 6, "0")
    seconds = (
        F.left(digits, F.lit(2)).try_cast("int") * 3600
        + F.substr(digits, F.lit(3), F.lit(2)).try_cast("int") * 60
        + F.right(digits, F.lit(2)).try_cast("int")
    )
    return F.when(offset.startswith("-"), -seconds).otherwise(seconds)


def _offset_text(seconds: Column) -> Column:
    size = F.abs(seconds)
    text = F.format_string(
        "%s%02d:%02d",
        F.when(seconds < 0, "-").otherwise("+"),
        F.floor(size / 3600).cast("int"),
        F.floor(size / 60 % 60).cast("int"),
    )
    return F.when(size % 60 == 0, text).otherwise(
        F.concat(text, F.format_string(":%02d", (size % 60).cast("int")))
    )


def normalize_post_date(raw: Column | str) -> Column:
    """Struct (post_date timestamp, post_date_iso string) of a free-form date text.

    Reads ISO 8601 dates and the usual blog notations, with an optional "posted
    on" prefix and ordinal days. A text without zone is UTC. ``post_date_iso``
    keeps the offset of the source, which a timestamp cannot.
    """

    def finish(p: Column) -> Column:
        shift = _offset_seconds(p["offset"])
        zone = F.expr("INTERVAL '1' SECOND") * shift
        part = F.expr("INTERVAL '0.000001' SECOND") * p["micros"]
        iso = F.concat(
            F.date_format(p["local"], "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(p["micros"] > 0, F.format_string(".%06d", p["micros"])).otherwise(F.lit("")),
            _offset_text(shift),
        )
        valid = p["local"].isNotNull() & (F.abs(shift) < 86400)
        return F.struct(
            F.when(valid, p["local"] - zone + part).alias("post_date"),
            F.when(valid, iso).alias("post_date_iso"),
        )

    cleaned = strip(F.regexp_replace(strip(as_column(raw)), _PREFIX, ""))
    cleaned = F.regexp_replace(cleaned, _ORDINAL, "$1")
    cleaned = F.regexp_replace(cleaned, r"Z\z", "+00:00")
    cleaned = F.regexp_replace(cleaned, r"\s* (UTC|GMT)\z", "")

    def read(text: Column) -> Column:
        usable = lambda p: F.when(p["local"].isNotNull(), p)
        return F.coalesce(*(let(parse(text), usable) for parse in (_iso, _loose, _named)))

    return let(let(cleaned, read), finish)


def display_date(post_date_iso: Column | str) -> Column:
    """``Aug 30, 2023 00:00`` in the wall clock of the source; '' when absent."""
    clock = F.left(as_column(post_date_iso), F.lit(19))
    stamp = F.try_to_timestamp(clock, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.coalesce(F.date_format(stamp, "MMM dd, yyyy HH:mm"), F.lit(""))
