"""Date expressions: parsing by layouts, the publication-time policy and the feed formats."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text

# Layouts tried before a site's own, by the reference date 2006-01-02 15:04:05.
BUILT_IN = [
    "2006-01-02T15:04:05.999999999Z07:00", "2006-01-02T15:04:05Z0700", "2006-01-02T15:04:05", "2006-01-02T15:04",
    "2006-01-02 15:04:05Z07:00", "2006-01-02 15:04:05", "2006-01-02",
    "Mon, 02 Jan 2006 15:04:05 -0700", "Mon, 02 Jan 2006 15:04:05 MST", "Mon, 2 Jan 2006 15:04:05 -0700", "Mon, 2 Jan 2006 15:04:05 MST",
    "2 Jan 2006 15:04:05 -0700", "2 Jan 2006 15:04:05 MST", "02 Jan 06 15:04 -0700", "02 Jan 06 15:04 MST", "Monday, 02-Jan-06 15:04:05 MST",
]
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_MONTHS = "January February March April May June July August September October November December".split()
#: Layout elements: (element, pattern of values, Spark letters, clock?). Longest first; weekday names are matched and dropped.
_ELEMENTS = [
    (".999999999", r"(?:[.,]\d{1,9})?", "[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", True),
    ("January", "(?:" + "|".join(_MONTHS) + ")", "MMMM", False), ("Monday", "(?:" + "|".join(_DAYS) + ")", None, False),
    ("Z07:00", r"(?:Z|[+-]\d\d:\d\d)", "XXX", True), ("-07:00", r"[+-]\d\d:\d\d", "xxx", True),
    ("Z0700", r"(?:Z|[+-]\d{4})", "XX", True), ("-0700", r"[+-]\d{4}", "xx", True),
    ("2006", r"\d{4}", "yyyy", False), ("Jan", "(?:" + "|".join(m[:3] for m in _MONTHS) + ")", "MMM", False), ("Mon", "(?:" + "|".join(d[:3] for d in _DAYS) + ")", None, False),
    ("MST", r"[A-Z]{3,4}", "", True), ("PM", "(?:AM|PM)", "a", True), ("pm", "(?:am|pm)", "a", True),
    ("15", r"\d\d", "HH", True), ("03", r"\d\d", "hh", True), ("04", r"\d\d", "mm", True), ("05", r"\d\d", "ss", True),
    ("01", r"\d\d", "MM", False), ("02", r"\d\d", "dd", False), ("06", r"\d\d", "yy", False), ("_2", r"[ \d]\d", "d", False),
    ("1", r"\d\d?", "M", False), ("2", r"\d\d?", "d", False), ("3", r"\d\d?", "h", True), ("4", r"\d\d?", "m", True), ("5", r"\d\d?", "s", True),
]


class LayoutError(ValueError):
    pass


@dataclass(frozen=True)
class Layout:
    """A compiled layout: what its values look like, and Spark's pattern for them without weekday and zone name."""

    raw: str
    regex: str
    strip: str
    pattern: str
    clock: bool
    zoned: bool
    named: bool
    fraction: bool


def compile_layout(raw: str) -> Layout:
    regex, pattern, strip = "^", "", "^"
    clock = zoned = named = year = fraction = False
    at = 0
    elements = 0
    while at < len(raw):
        for token, values, letters, is_clock in _ELEMENTS:
            if raw.startswith(token, at):
                break
        else:
            ch = raw[at]
            regex += re.escape(ch)
            strip += re.escape(ch)
            pattern += f"'{ch}'" if ch.isalpha() else "''" if ch == "'" else ch
            at += 1
            continue
        elements += 1
        at += len(token)
        clock |= is_clock and not token.startswith(("Z", "-", "MST"))
        zoned |= token in ("Z07:00", "-07:00", "Z0700", "-0700")
        named |= token == "MST"
        year |= token in ("2006", "06")
        fraction |= token == ".999999999"
        regex += values
        if letters is None or token == "MST":  # dropped together with what joins it
            strip += values
            if letters is None:
                while at < len(raw) and raw[at] in ", ":
                    regex += re.escape(raw[at])
                    at += 1
        elif token != ".999999999":
            pattern += letters
    if not elements:
        raise LayoutError(f"layout {raw!r} has no date element")
    if not year:
        raise LayoutError(f"layout {raw!r} has no year")
    return Layout(raw, regex + "$", strip, pattern.rstrip(), clock, zoned, named, fraction)


def _parsed(v: Column, layout: Layout, tz: str) -> Column:
    """Timestamp of values of this layout, else null."""
    bare = F.regexp_replace(v, "^(?:" + "|".join([*_DAYS, *(d[:3] for d in _DAYS)]) + "),? +", "")
    fraction = F.lit(0.0)
    if layout.fraction:
        part = F.regexp_extract(bare, r"[T ]\d\d:\d\d:\d\d[.,](\d{1,9})", 1)
        fraction = F.when(part != "", F.rpad(part, 6, "0").cast("long") / 1e6).otherwise(0.0)
        bare = F.regexp_replace(bare, r"(:\d\d)[.,]\d{1,9}", "$1")
    if layout.named:
        zone = F.regexp_extract(bare, " ([A-Z]{3,4})$", 1)
        bare = F.regexp_replace(bare, " [A-Z]{3,4}$", "")
        t = F.try_to_timestamp(bare, F.lit(layout.pattern))
        # UTC and GMT are exact; another name has no certain offset and counts as UTC.
        out = t
    else:
        t = F.try_to_timestamp(bare, F.lit(layout.pattern))
        out = t if layout.zoned else F.convert_timezone(F.lit(tz), F.lit("UTC"), t.cast("timestamp_ntz")).cast("timestamp")
    if layout.fraction:
        out = F.timestamp_micros(F.unix_micros(out) + F.round(fraction * 1_000_000).cast("long"))
    return F.when(v.rlike(layout.regex), out)


def parse_date(c: Column, layouts: list[str] | None = None, tz: str = "UTC") -> Column:
    """struct(time, date_only, layout) by the first layout that fits, built-in ones first; null if none does.

    Values without a zone are read in ``tz``. The session's time zone must be UTC.
    """
    v = clean_text(c)
    tries = []
    for raw in [*BUILT_IN, *(layouts or [])]:
        layout = compile_layout(raw)
        t = _parsed(v, layout, tz)
        tries.append(F.when(t.isNotNull(), F.struct(t.alias("time"), F.lit(not layout.clock).alias("date_only"), F.lit(raw).alias("layout"))))
    return F.coalesce(*tries)


def local_day(t: Column, tz: str | Column) -> Column:
    return F.date_trunc("day", F.from_utc_timestamp(t, tz))


def date_only_at(day: Column, first_seen: Column, order: Column, tz: str) -> Column:
    """Time of a date-only value: first sight if that was the same local day, else local midnight plus a place by discovery order."""
    midnight = F.to_utc_timestamp(local_day(day, tz), tz)
    place = F.timestamp_millis(F.unix_millis(midnight) + 999 - F.least(order, F.lit(999)))
    return F.when(local_day(day, tz) == local_day(first_seen, tz), first_seen).otherwise(place)


def published_at(time: Column, date_only: Column, source: Column, first_seen: Column, order: Column, tz: str) -> Column:
    """struct(at, source): exact values as they are, date-only ones placed, none at first sight."""
    same_day = local_day(time, tz) == local_day(first_seen, tz)
    return F.when(time.isNull(), F.struct(first_seen.alias("at"), F.lit("first_seen").alias("source"))).otherwise(
        F.when(date_only, F.struct(date_only_at(time, first_seen, order, tz).alias("at"), F.concat(source, F.when(same_day, F.lit(" (date) + first_seen time")).otherwise(F.lit(" (date)"))).alias("source"))).otherwise(F.struct(time.alias("at"), source.alias("source")))
    )


def later_than(t: Column, ref: Column) -> Column:
    return F.when(t > ref, t)


def source_day(t: Column, tz: str) -> Column:
    """Local day as YYYY-MM-DD, '' for none."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(t, tz), "yyyy-MM-dd"), F.lit(""))


def rss_date(t: Column) -> Column:
    return F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss xx")


def atom_date(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def to_millis(t: Column) -> Column:
    return F.unix_millis(t)


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}


def parse_duration(value: str) -> float:
    """Seconds of 1h30m, 90s, 2d and the like."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d)", value.strip())
    if not parts or "".join(a + b for a, b in parts) != value.strip():
        raise ValueError(f"bad duration {value!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


def parse_rate(value: str) -> float:
    """Requests a second of '2/s', '30/m' or '1/5s'."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*/\s*(\d*)(ms|s|m|h)\s*", value)
    if not m or float(m[1]) <= 0 or (m[2] and int(m[2]) == 0):
        raise ValueError(f"bad rate {value!r}")
    return float(m[1]) / (int(m[2] or 1) * _UNITS[m[3]])


def retry_after(header: str, now: float) -> float | None:
    """Seconds to wait by a Retry-After header (seconds or an HTTP date), None if unreadable."""
    from email.utils import parsedate_to_datetime

    value = header.strip()
    if value.isdigit():
        return float(value)
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return None
