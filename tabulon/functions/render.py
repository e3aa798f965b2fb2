"""Parquet values as text, by declared type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import UnsupportedSchema
from tabulon.spec import TEXT, ColumnType, Kind, Zone

DAY_MICROS = 86_400_000_000


def declared(kind: T.DataType) -> ColumnType:
    """The column type that a Spark type stands for."""
    match kind:
        case T.BooleanType():
            return ColumnType(Kind.BOOLEAN)
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return ColumnType(Kind.INTEGER)
        case T.FloatType() | T.DoubleType():
            return ColumnType(Kind.DECIMAL)
        case T.DecimalType():
            return ColumnType(Kind.INTEGER if (kind.precision, kind.scale) == (20, 0) else Kind.DECIMAL, precision=kind.precision, scale=kind.scale)
        case T.DateType():
            return ColumnType(Kind.DATE)
        case T.TimestampType():
            return ColumnType(Kind.DATETIME, Zone.ZONED, fraction_digits=6)
        case T.TimestampNTZType():
            return ColumnType(Kind.DATETIME, Zone.NAIVE, fraction_digits=6)
        case T.StringType() | T.BinaryType():
            return TEXT
    raise UnsupportedSchema(f"columns of type {kind.simpleString()} can't be explored")


def plain_double(c: Column) -> Column:
    """The shortest digits that give the number back, without exponent; whole numbers without a point.

    The engine's own text has an exponent only below 0.001 and from 10 million on. Spreading one out is left to a lambda, as its
    long expression would else be part of every scan's generated code.
    """
    text = c.cast("string")
    spread = F.get(F.transform(F.array(text), _spread), F.lit(0))
    return (
        F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2))
        .when(text.contains("E"), spread)
        .when(text == "NaN", "nan")
        .when(text.endswith("Infinity"), F.when(text.startswith("-"), "-inf").otherwise("inf"))
        .otherwise(text)
    )


def _spread(text: Column) -> Column:
    """A text like -1.25E-7 without its exponent."""
    whole, fraction = (F.regexp_extract(text, r"\A-?([0-9])\.([0-9]+)E", k) for k in (1, 2))
    digits = F.concat(whole, F.rtrim(fraction, F.lit("0")))
    point = F.regexp_extract(text, r"E(-?[0-9]+)\z", 1).cast("int") + 1
    placed = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.rpad(digits, point, "0"))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    )
    return F.concat(F.when(text.startswith("-"), "-").otherwise(""), placed)


def instant(c: Column) -> Column:
    """A timestamp as UTC, from its count of microseconds, so that the session's zone has no say."""
    micros = F.unix_micros(c)
    rest = F.pmod(micros, F.lit(DAY_MICROS))
    two = lambda unit, most: F.lpad(F.floor(rest / unit % most).cast("string"), 2, "0")
    day = F.date_from_unix_date(((micros - rest) / DAY_MICROS).cast("int")).cast("string")
    clock = F.concat_ws(":", two(3_600_000_000, 24), two(60_000_000, 60), two(1_000_000, 60))
    return F.concat(day, F.lit("T"), clock, F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), F.lit("000Z"))


def render(c: Column, kind: T.DataType) -> Column:
    """Never null: a null value is the empty string."""
    match kind:
        case T.FloatType() | T.DoubleType():
            text = plain_double(c)
        case T.TimestampType():
            text = instant(c)
        case T.TimestampNTZType():
            # the engine's own text has no zone either: a day, a blank, the clock and as much of a fraction as there is
            clock = F.split_part(c.cast("string"), F.lit(" "), F.lit(2))
            text = F.concat(F.split_part(c.cast("string"), F.lit(" "), F.lit(1)), F.lit("T"), F.substring(clock, 1, 8), F.lit("."), F.rpad(F.substring(clock, 10, 9), 9, "0"))
        case T.DecimalType():
            text = F.format_string("%s", c.cast("string")) if kind.scale == 0 else plain_decimal(c, kind.scale)
        case _:
            text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def plain_decimal(c: Column, scale: int) -> Column:
    """Fixed scale, a leading zero, never an exponent."""
    unscaled = F.regexp_replace(F.format_number(F.abs(c), scale), ",", "")
    return F.concat(F.when(c < 0, "-").otherwise(""), unscaled)
