"""Time stamps as whole milliseconds, in and out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STAMP = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?\s*$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_stamp(text: Column | str) -> Column:
    """Milliseconds of H+:MM:SS.mmm or MM:SS.mmm (comma or point, fraction padded to the right); null if malformed."""
    t = _col(text)
    part = lambda k: F.regexp_extract(t, _STAMP, k)
    number = lambda x: F.coalesce(F.nullif(x, F.lit("")).cast("long"), F.lit(0).cast("long"))
    value = (number(part(1)) * 60 + number(part(2))) * 60_000 + number(part(3)) * 1000 + number(F.rpad(part(4), 3, "0"))
    return F.when(t.rlike(_STAMP), value)


def format_stamp(ms: Column | str, mark: str = ".") -> Column:
    """HH:MM:SS.mmm of milliseconds."""
    m = _col(ms).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(m / 3_600_000), F.floor(m / 60_000) % 60, F.floor(m / 1000) % 60, m % 1000)


def format_seconds(ms: Column | str) -> Column:
    """Seconds with three places, without a floating-point step."""
    m = _col(ms).cast("long")
    return F.format_string("%d.%03d", F.floor(m / 1000), m % 1000)


def clock(seconds: Column | str) -> Column:
    """H:MM:SS."""
    s = _col(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def to_ms(seconds: Column | str) -> Column:
    return F.round(_col(seconds).cast("double") * 1000).cast("long")


def stamp_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, in any session zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def rfc822(text: Column | str) -> Column:
    """Timestamp of an RFC 2822 date; the weekday is dropped, GMT and UT are +0000, no zone is UTC; null if malformed."""
    t = F.trim(F.regexp_replace(_col(text), r"^\s*[A-Za-z]{3},\s*", ""))
    t = F.regexp_replace(t, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    t = F.when(t.rlike(r"[+-]\d{4}$"), t).otherwise(F.concat(t, F.lit(" +0000")))
    return F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z"))
