"""Requests as Columns: whether a row matches, and in which column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import numeric
from tabulon.functions.text import fold, fold_text
from tabulon.spec import Mode, SearchRequest

_COMPARE = {Mode.LT: Column.__lt__, Mode.GT: Column.__gt__, Mode.LE: Column.__le__, Mode.GE: Column.__ge__}


def cell_match(request: SearchRequest, c: Column) -> Column:
    """Whether one cell (never null) matches."""
    if request.mode.ordering:
        number, compare = numeric.parse(request.value), _COMPARE[request.mode]
        exact = numeric.is_numeric(c) & compare(numeric.exact_key(c), F.lit(number.key))
        if (value := number.decimal()) is None:
            return exact
        # almost all numbers are short: those compare as decimals, which hold them and the value exactly
        return F.when(c.rlike(numeric.SHORT), compare(c.try_cast("decimal(38,18)"), F.lit(value))).otherwise(exact)
    value, text = (request.value, c) if request.case_sensitive else (fold_text(request.value), fold(c))
    if request.mode is Mode.TEXT:
        return text.contains(F.lit(value))
    return (text == F.lit(value)) if request.mode is Mode.EQ else (text != F.lit(value))


def columns_of(request: SearchRequest, column_count: int) -> list[int]:
    if request.mode is not Mode.TEXT:
        return [request.column]
    return list(range(column_count)) if request.scope is None else list(request.scope)


def matches(request: SearchRequest, cells: list[Column]) -> Column:
    return reduce(Column.__or__, (cell_match(request, cells[k]) for k in columns_of(request, len(cells))))


def match_column(request: SearchRequest, cells: list[Column]) -> Column:
    """The lowest matching column in scope, null if none matches."""
    return F.coalesce(*(F.when(cell_match(request, cells[k]), F.lit(k)) for k in columns_of(request, len(cells))))


def typed_equivalent(request: SearchRequest, typed: Column, kind: T.DataType) -> Column | None:
    """A predicate on the source's own value that holds for exactly the same rows, so that it can replace the text predicate
    and reach the scan; None where the two could differ."""
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if request.mode.ordering and (whole or isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))):
        number = numeric.parse(request.value)
        if whole:
            if number.digits and (number.scale > 0 or number.first > 17):
                return None
            value = int(number.digits or "0") * 10 ** max(0, number.first + 1 - len(number.digits)) if number.digits else 0
            return _COMPARE[request.mode](typed, F.lit(-value if number.negative else value).cast("bigint"))
        if isinstance(kind, T.DecimalType) and len(number.digits) <= 30 and -20 < number.first < 17:
            value = f"{'-' if number.negative else ''}{number.digits or '0'}E{number.first + 1 - len(number.digits) if number.digits else 0}"
            from decimal import Decimal

            return _COMPARE[request.mode](typed, F.lit(Decimal(value)))
        if isinstance(kind, T.DoubleType) and len(number.digits) <= 15 and -20 < number.first < 22:
            # the text is the shortest that gives the value back; up to 15 digits, order of texts and of values agree
            value = float(f"{'-' if number.negative else ''}{number.digits or '0'}e{number.first + 1 - len(number.digits) if number.digits else 0}")
            return _COMPARE[request.mode](typed, F.lit(value)) & ~F.isnan(typed) & (F.abs(typed) < F.lit(float("inf")))
    if request.mode is Mode.EQ and isinstance(kind, T.StringType) and request.case_sensitive and request.value:
        return typed == F.lit(request.value)
    return None
