"""A cell's type by its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions import numeric, temporal
from tabulon.functions.text import BLANK, fold, fold_text, trim, trim_text
from tabulon.spec import TEXT, ColumnType, Kind, Zone


#: How every boolean, number or date begins; most texts don't, and need no further look.
TYPED = rf"\A{BLANK}*[0-9.+\-tTfF]"


def is_boolean(c: Column) -> Column:
    return fold(trim(c)).isin("true", "false")


def classify(c: Column) -> Column:
    """'boolean', 'integer', 'decimal', 'date', 'datetime_naive', 'datetime_zoned' or 'text'; the first that fits."""
    return (
        F.when(~c.rlike(TYPED), "text")
        .when(is_boolean(c), "boolean")
        .when(numeric.is_integer(c), "integer")
        .when(numeric.is_numeric(c), "decimal")
        .when(temporal.is_date(c), "date")
        .when(temporal.is_naive(c), "datetime_naive")
        .when(temporal.is_zoned(c), "datetime_zoned")
        .otherwise("text")
    )


def type_of(text: str) -> ColumnType:
    """The same, of one text, with digits and fraction."""
    if fold_text(trim_text(text)) in ("true", "false"):
        return ColumnType(Kind.BOOLEAN)
    if (number := numeric.parse(text)) is not None:
        return ColumnType(Kind.INTEGER if number.plain else Kind.DECIMAL, precision=number.precision, scale=number.scale)
    if (found := temporal.date_kind(text)) is not None:
        kind, digits = found
        return ColumnType(Kind.DATE) if kind == "date" else ColumnType(Kind.DATETIME, Zone(kind), fraction_digits=digits)
    return TEXT


def conforms(c: Column, type_: ColumnType) -> Column:
    """Whether a cell parses as the column's type."""
    match type_.kind:
        case Kind.BOOLEAN:
            return is_boolean(c)
        case Kind.INTEGER:
            return numeric.is_integer(c)
        case Kind.DECIMAL:
            return numeric.is_numeric(c)
        case Kind.DATE:
            return temporal.is_date(c)
        case Kind.DATETIME:
            return temporal.is_zoned(c) if type_.zone is Zone.ZONED else temporal.is_naive(c)
    return F.lit(True)


def order_key(c: Column, type_: ColumnType) -> Column:
    """The sort key of a conforming cell."""
    match type_.kind:
        case Kind.BOOLEAN:
            return F.substring(fold(trim(c)), 1, 1)  # false before true
        case Kind.INTEGER | Kind.DECIMAL:
            return numeric.exact_key(c)
        case Kind.DATE:
            return c
        case Kind.DATETIME:
            return temporal.datetime_key(c)
    return fold(c)
