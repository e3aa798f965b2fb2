"""Cells formatted for display by column type and options. Numbers stay exact; what isn't representable stays as written."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from decimal import ROUND_HALF_EVEN, Context, Decimal
from enum import Enum

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import numeric, temporal
from tabulon.functions.classify import type_of
from tabulon.spec import ColumnType, Kind, Zone

MOST_DIGITS = 38
MOST_FRACTION = 38
EXPONENTS = (-128, 127)


class Preset(Enum):
    ORIGINAL = "original"
    SHORT = "short"
    MEDIUM = "medium"
    LONG = "long"


class Shown(Enum):
    ORIGINAL = "original"
    FORMATTED = "formatted"
    UNAVAILABLE = "unavailable"


@dataclass(frozen=True)
class Glyphs:
    """A locale's marks; the C locale's point and, for readable groups, commas of three."""

    point: str = "."
    group: str = ","
    size: int = 3


@dataclass(frozen=True)
class Format:
    grouping: bool = False
    fraction_digits: int | None = None
    preset: Preset = Preset.ORIGINAL

    @property
    def auto(self) -> bool:
        return not self.grouping and self.fraction_digits is None and self.preset is Preset.ORIGINAL


def _grouped(digits: str, glyphs: Glyphs) -> str:
    first = len(digits) % glyphs.size or glyphs.size
    return glyphs.group.join([digits[:first], *(digits[k : k + glyphs.size] for k in range(first, len(digits), glyphs.size))])


def format_number(text: str, grouping: bool, fraction_digits: int | None, glyphs: Glyphs = Glyphs()) -> tuple[Shown, str]:
    """Fixed digits round half to even; without them the written fraction stays. Zero has no sign."""
    number = numeric.parse(text)
    if number is None:
        return Shown.UNAVAILABLE, text
    last = number.first + 1 - len(number.digits)
    if number.saturated or len(number.digits) > MOST_DIGITS or number.digits and not EXPONENTS[0] <= last <= EXPONENTS[1]:
        return Shown.UNAVAILABLE, text
    wide = Context(prec=400)
    # the written spelling, so that trailing zeros of the fraction are kept
    value = Decimal(text.strip("\t\n\x0b\x0c\r "), wide)
    if fraction_digits is not None:
        value = value.quantize(Decimal(1).scaleb(-fraction_digits, wide), ROUND_HALF_EVEN, wide)
    whole, _, fraction = f"{abs(value):f}".partition(".")
    if not fraction_digits and fraction_digits is not None:
        fraction = ""
    sign = "-" if value < 0 else ""
    return Shown.FORMATTED, sign + (_grouped(whole, glyphs) if grouping else whole) + (glyphs.point + fraction if fraction else "")


_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_MONTHS = "January February March April May June July August September October November December".split()


def _day(d: date, preset: Preset) -> str:
    match preset:
        case Preset.SHORT:
            return f"{d.month:02d}/{d.day:02d}/{d.year % 100:02d}"
        case Preset.MEDIUM:
            return f"{_MONTHS[d.month - 1][:3]} {d.day:2d}, {d.year}"
    return f"{_DAYS[d.weekday()]}, {_MONTHS[d.month - 1]} {d.day:2d}, {d.year}"


def _moment(text: str, preset: Preset) -> str:
    d = date.fromisoformat(text[:10])
    out = f"{_day(d, preset)}{' ' if preset is Preset.SHORT else ', '}{text[11:16] if preset is Preset.SHORT else text[11:19]}"
    if m := re.search(r"(Z|[+-][0-9]{2}:[0-9]{2})\Z", text):
        out += f" {'+00:00' if m[1] == 'Z' else m[1]}"
    return out


def format_cell(text: str, type_: ColumnType, options: Format, glyphs: Glyphs = Glyphs()) -> tuple[Shown, str]:
    """A cell that doesn't fit its column's kind is shown as written; a zoned moment keeps the offset that it is written with."""
    if not text or options.auto:
        return Shown.ORIGINAL, text
    own = type_of(text)
    match type_.kind:
        case Kind.INTEGER if options.grouping and own.kind is Kind.INTEGER:
            return format_number(text, True, None, glyphs)
        case Kind.DECIMAL if own.kind is Kind.DECIMAL:
            if options.fraction_digits is not None and not 0 <= options.fraction_digits <= MOST_FRACTION:
                return Shown.UNAVAILABLE, text
            if options.grouping or options.fraction_digits is not None:
                return format_number(text, options.grouping, options.fraction_digits, glyphs)
        case Kind.DATE if options.preset is not Preset.ORIGINAL and own.kind is Kind.DATE and text[:4] != "0000":
            return Shown.FORMATTED, _day(date.fromisoformat(text), options.preset)
        case Kind.DATETIME if options.preset is not Preset.ORIGINAL and own.kind is Kind.DATETIME and own.zone is type_.zone and text[:4] != "0000":
            return Shown.FORMATTED, _moment(text, options.preset)
    return Shown.ORIGINAL, text


SHOWN = T.StructType([T.StructField("state", T.StringType()), T.StructField("text", T.StringType())])


def formatted(c: Column, type_: ColumnType, options: Format, glyphs: Glyphs = Glyphs()) -> Column:
    """(state, text) of a column of cells; exact at any precision, so it runs Arrow batches through Python."""
    if options.auto:
        return F.struct(F.lit(Shown.ORIGINAL.value).alias("state"), c.alias("text"))

    @F.pandas_udf(SHOWN)
    def apply(cells: pd.Series) -> pd.DataFrame:
        got = [format_cell(x, type_, options, glyphs) for x in cells]
        return pd.DataFrame({"state": [s.value for s, _ in got], "text": [t for _, t in got]})

    return apply(c)


def grouped_integer(c: Column) -> Column:
    """``format_cell`` of an integer column with grouping, by built-in functions; for cells of up to 38 digits."""
    trimmed = F.regexp_replace(c, r"\A[\x09-\x0d\x20]+|[\x09-\x0d\x20]+\z", "")
    digits = F.regexp_replace(trimmed, r"\A[+-]", "")
    spaced = F.reverse(F.regexp_replace(F.reverse(digits), r"([0-9]{3})(?=[0-9])", "$1,"))
    sign = F.when(trimmed.startswith("-") & digits.rlike("[1-9]"), "-").otherwise("")
    return F.when(numeric.is_integer(c), F.concat(sign, spaced)).otherwise(c)


def offset_of(text: str) -> timezone | None:
    """The written offset of a zoned moment."""
    found = temporal.date_kind(text)
    if not found or found[0] != Zone.ZONED.value:
        return None
    if text.endswith("Z"):
        return timezone.utc
    return datetime.strptime(text[-6:], "%z").tzinfo or timezone(timedelta(0))
