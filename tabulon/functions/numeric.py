"""Exact numbers as text: the grammar, and keys whose byte order is the numeric order at any precision."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Context, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.text import BLANK, trim, trim_text

BODY = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
NUMERIC = rf"\A{BLANK}*{BODY}{BLANK}*\z"
INTEGER = rf"\A{BLANK}*[+-]?[0-9]+{BLANK}*\z"
#: Numbers that a decimal(38,18) holds.
SHORT = r"\A-?[0-9]{1,19}(?:\.[0-9]{1,18})?\z"
PARTS = r"\A([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?)0*([0-9]*))?\z"
_NUMERIC = re.compile(NUMERIC.replace(r"\z", r"\Z"))
_PARTS = re.compile(PARTS.replace(r"\z", r"\Z"))
#: Exponents of more than 18 digits count as this, far beyond any of 18.
FAR = 4 * 10**18
BIAS = 45 * 10**17
DIGITS, NINES = "0123456789", "9876543210"


def is_numeric(c: Column) -> Column:
    return c.rlike(NUMERIC)


def is_integer(c: Column) -> Column:
    """A number without point or exponent."""
    return c.rlike(INTEGER)


def exact_key(c: Column) -> Column:
    """Of a numeric text: a string that orders by exact value and is equal for equal values.

    A class digit (0 negative, 1 zero, 2 positive), the biased exponent of the first significant digit in 19 places, the
    significant digits; for negatives both complemented and closed by a character above the digits.
    """
    t = trim(c)
    part = lambda k: F.regexp_extract(t, PARTS, k)
    zero = F.lit("0")
    whole, digits = part(2), F.concat(part(2), part(3))
    lead = F.length(digits) - F.length(F.ltrim(digits, zero))
    significant = F.rtrim(F.ltrim(digits, zero), zero)
    size = F.when(F.length(part(5)) > 18, F.lit(FAR)).otherwise(F.coalesce(part(5).try_cast("bigint"), F.lit(0)))
    exponent = F.when(part(4) == "-", -size).otherwise(size)
    first = F.length(whole).cast("bigint") - 1 - lead + exponent
    body = F.concat(F.lpad((first + F.lit(BIAS)).cast("string"), 19, "0"), significant)
    return (
        F.when(significant == "", F.lit("1"))
        .when(part(1) == "-", F.concat(F.lit("0"), F.translate(body, DIGITS, NINES), F.lit(":")))
        .otherwise(F.concat(F.lit("2"), body))
    )


@dataclass(frozen=True)
class Exact:
    """A parsed number: significant digits and the exponent of the first."""

    negative: bool
    digits: str  #: empty for zero
    first: int
    plain: bool  #: neither point nor exponent
    saturated: bool

    @property
    def key(self) -> str:
        if not self.digits:
            return "1"
        body = f"{self.first + BIAS:019d}{self.digits}"
        return "0" + body.translate(str.maketrans(DIGITS, NINES)) + ":" if self.negative else "2" + body

    def decimal(self) -> Decimal | None:
        """The number as a decimal(38,18), None if it isn't one."""
        if self.saturated or self.digits and (self.first > 18 or self.scale > 18):
            return None
        return Decimal((int(self.negative), tuple(map(int, self.digits or "0")), self.first + 1 - len(self.digits) if self.digits else 0)).quantize(Decimal(1).scaleb(-18), context=Context(prec=60))

    @property
    def precision(self) -> int:
        return (1 << 64) - 2 if self.saturated else max(1, len(self.digits))

    @property
    def scale(self) -> int:
        """Digits after the point, negative for trailing zeros of the whole part."""
        return max(1, len(self.digits)) - 1 - (self.first if self.digits else 0)


def parse(text: str) -> Exact | None:
    """None if the text is not numeric."""
    if not _NUMERIC.match(text):
        return None
    t = trim_text(text)
    sign, whole, fraction, exp_sign, exp = _PARTS.match(t).groups()
    size = 0 if not exp else FAR if len(exp) > 18 else int(exp)
    digits = whole + fraction
    significant = digits.lstrip("0")
    first = len(whole) - 1 - (len(digits) - len(significant)) + (-size if exp_sign == "-" else size)
    return Exact(sign == "-", significant.rstrip("0"), first, not set(t) & set(".eE"), len(exp or "") > 18)
