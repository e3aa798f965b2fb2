"""Dates and date-times as text: pinned grammars and chronological keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAP = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
DAY = (
    r"(?:[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
    rf"|{LEAP}-02-29)"
)
CLOCK = r"T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,9})?"
OFFSET = r"(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"
DATE, NAIVE, ZONED = rf"\A{DAY}\z", rf"\A{DAY}{CLOCK}\z", rf"\A{DAY}{CLOCK}{OFFSET}\z"
_DATE, _NAIVE, _ZONED = (re.compile(p.replace(r"\z", r"\Z"), re.A) for p in (DATE, NAIVE, ZONED))
#: Added to seconds since 1970 so that years 0000 to 9999 are positive.
SECONDS_BIAS = 100_000_000_000


def is_date(c: Column) -> Column:
    """A real day of the Gregorian calendar, ten characters, not trimmed."""
    return c.rlike(DATE)


def is_naive(c: Column) -> Column:
    return c.rlike(NAIVE)


def is_zoned(c: Column) -> Column:
    return c.rlike(ZONED)


def datetime_key(c: Column) -> Column:
    """Of a date-time text: a string ordered by instant (zoned) or wall clock (naive), fractions by value."""
    number = lambda at, n: F.substring(c, at, n).cast("int")
    days = F.unix_date(F.make_date(number(1, 4), number(6, 2), number(9, 2))).cast("bigint")
    fraction = F.rtrim(F.regexp_extract(c, r"\.([0-9]+)", 1), F.lit("0"))
    sign, hours, minutes = (F.regexp_extract(c, r"([+-])([0-9]{2}):([0-9]{2})\z", k) for k in (1, 2, 3))
    shift = F.when(sign == "", 0).otherwise(F.when(hours == "", 0).otherwise(hours.cast("int") * 3600 + minutes.cast("int") * 60))
    # a naive text ends with seconds, whose "-MM:SS" can't match: the character before is a colon
    seconds = days * 86400 + number(12, 2) * 3600 + number(15, 2) * 60 + number(18, 2) - F.when(sign == "-", -shift).otherwise(shift)
    return F.concat(F.lpad((seconds + F.lit(SECONDS_BIAS)).cast("string"), 13, "0"), fraction)


def date_kind(s: str) -> tuple[str, int] | None:
    """('date' | 'naive' | 'zoned', fraction digits), or None."""
    if _DATE.match(s):
        return "date", 0
    kind = "naive" if _NAIVE.match(s) else "zoned" if _ZONED.match(s) else None
    if kind is None:
        return None
    m = re.search(r"\.([0-9]+)", s)
    return kind, len(m[1]) if m else 0
