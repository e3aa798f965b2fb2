"""Expressions against plain Python, at any precision."""

import itertools
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.functions import classify, display, numeric, output, render, temporal, text
from tabulon.spec import ColumnType, Kind, Zone

NUMBERS = [
    "0", "-0", "0.0", "00", "1", "+1", "1.0", "1e0", "10e-1", ".5", "5.", "-.5", "-5.", "1e400", "-1e400", "1e-400", "123456789012345678901234567890123456789012", "-123456789012345678901234567890123456789012.5",
    " 42\t", "\x0b7\r", "2", "2.0", "+2e0", "-1.2", "-1.23", "1.2", "1.23", "99999", "1e5", "100000", "0.001", "1E-3",
]
NOT_NUMBERS = ["", " ", "NaN", "inf", "1,000", "1e", "e5", "+", ".", "1 2", "\x1f1", "0x10", "1\n2", "１"]


def column(spark, values, *exprs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [tuple(r)[1:] for r in df.select("k", *(e(F.col("v")) for e in exprs)).orderBy("k").collect()]


def fraction(s):
    mantissa, _, exp = s.strip("\t\n\x0b\x0c\r ").lower().partition("e")
    return Fraction(mantissa + "0" if mantissa.endswith(".") else mantissa.replace("-.", "-0.").replace("+.", "+0.") if "." in mantissa else mantissa) * Fraction(10) ** int(exp or 0)


def test_numeric_grammar(spark):
    got = column(spark, NUMBERS + NOT_NUMBERS, numeric.is_numeric)
    assert [g[0] for g in got] == [True] * len(NUMBERS) + [False] * len(NOT_NUMBERS)
    assert all(numeric.parse(n) is not None for n in NUMBERS)
    assert all(numeric.parse(n) is None for n in NOT_NUMBERS)


def test_exact_key_orders_by_value(spark):
    rng = random.Random(5)
    more = [f"{rng.choice(['', '-', '+'])}{rng.randrange(10 ** rng.randrange(1, 30))}{rng.choice(['', '.', '.0', '.25', '.003'])}{rng.choice(['', 'e3', 'E-7', 'e+20'])}" for _ in range(300)]
    values = NUMBERS + more
    keys = [k for (k,) in column(spark, values, numeric.exact_key)]
    assert keys == [numeric.parse(v).key for v in values]
    for (a, ka), (b, kb) in itertools.combinations(list(zip(values, keys, strict=True))[:150], 2):
        fa, fb = fraction(a), fraction(b)
        assert (fa < fb, fa == fb) == (ka < kb, ka == kb), (a, b)


@given(st.text(max_size=12))
@settings(max_examples=300, deadline=None)
def test_python_grammar_is_strict(s):
    number = numeric.parse(s)
    if number is not None:
        assert set(s) <= set("0123456789+-.eE\t\n\x0b\x0c\r ")


def test_fold_and_trim(spark):
    got = column(spark, ["ABC Éé Zz", "\t x \x0b", " x"], text.fold, text.trim)
    assert got == [("abc Éé zz", "ABC Éé Zz"), ("\t x \x0b", "x"), (" x", " x")]


@pytest.mark.parametrize("most", [4, 5, 6, 7, 8])
def test_cap_cuts_at_code_points(spark, most):
    values = ["", "abc", "abcdefghijk", "ééééé", "日本語日本", "a😀😀😀", "😀😀"]
    got = column(spark, values, lambda c: text.cap(c, most))
    for v, (g,) in zip(values, got, strict=True):
        assert (g["text"], g["truncated"]) == text.cap_text(v, most)


DATES = {
    "2024-02-29": "date", "2023-02-29": "text", "1900-02-29": "text", "2000-02-29": "date", "0000-02-29": "date", "2024-13-01": "text", "2024-04-31": "text", " 2024-01-01": "text",
    "2024-01-01T00:00:00": "datetime_naive", "2024-01-01T23:59:59.123456789": "datetime_naive", "2024-01-01T24:00:00": "text", "2024-01-01T00:00:60": "text", "2024-01-01t00:00:00": "text",
    "2024-01-01T00:00:00Z": "datetime_zoned", "2024-01-01T00:00:00.5+05:30": "datetime_zoned", "2024-01-01T00:00:00+5:30": "text", "2024-01-01T00:00:00.1234567890": "text", "2024-01-01 00:00:00": "text",
    "TRUE": "boolean", " false ": "boolean", "yes": "text", "1": "integer", "1.": "decimal", "1e3": "decimal", "": "text", "2024-01-01\n": "text", "1\n": "integer",
}


def test_classify(spark):
    got = column(spark, list(DATES), classify.classify)
    assert [g[0] for g in got] == list(DATES.values())
    for v, want in DATES.items():
        t = classify.type_of(v)
        assert (f"datetime_{t.zone.value}" if t.kind is Kind.DATETIME else t.kind.value) == want


def test_datetime_key_is_chronological(spark):
    zoned = ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00+01:00", "2023-12-31T23:59:59.9Z", "2024-01-01T00:00:00.5Z", "2024-01-01T00:00:00.50Z", "0001-01-01T00:00:00-23:59", "9999-12-31T23:59:59Z"]
    k = [x for (x,) in column(spark, zoned, temporal.datetime_key)]
    assert k[0] == k[1] and k[3] == k[4] and k[5] < k[2] < k[0] < k[3] < k[6]
    naive = ["2024-01-01T00:30:00", "2024-01-01T00:29:59.999999999", "2024-01-01T00:30:00.000000001", "2024-01-01T10:11:12"]
    k = [x for (x,) in column(spark, naive, temporal.datetime_key)]
    assert k[1] < k[0] < k[2] < k[3]


CELLS = {"": "", "=1+1": "'=1+1", "@x": "'@x", "+5": "+5", "-5.25e-3": "-5.25e-3", "-.5": "'-.5", "-3.": "'-3.", "+a": "'+a", "-": "'-", "-1 ": "'-1 ", "-1\n": "'-1\n", "a=b": "a=b", "'=1": "'=1"}


def test_neutralize(spark):
    got = column(spark, list(CELLS), output.neutralize, lambda c: output.neutralize(output.neutralize(c)))
    assert [g[0] for g in got] == list(CELLS.values())
    assert [g[1] for g in got] == list(CELLS.values())


def test_tsv_quote(spark):
    values = ["a", "a\tb", 'x"y', "p\nq", "r\r", ""]
    assert [g[0] for g in column(spark, values, output.tsv_quote)] == ["a", '"a\tb"', '"x""y"', '"p\nq"', '"r\r"', ""]


def test_plain_double(spark):
    values = [0.0, 24.0, 7.25, -2.5, 12345678.5, 1e22, 1e-5, 123456789012345680.0, 5e-324, 0.1, -1e10, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r[1] for r in df.select("k", render.plain_double(F.col("v"))).orderBy("k").collect()]
    for v, g in zip(values[:-3], got, strict=False):
        assert "e" not in g.lower() and float(g) == v and not g.endswith(".0"), (v, g)
    assert got[:5] == ["0", "24", "7.25", "-2.5", "12345678.5"] and got[-3:] == ["nan", "inf", "-inf"]


def test_format_numbers():
    f = display.format_number
    assert f("1234567.5", True, None) == (display.Shown.FORMATTED, "1,234,567.5")
    assert f("0.125", False, 2)[1] == "0.12" and f("0.135", False, 2)[1] == "0.14" and f("999.995", True, 2)[1] == "1,000.00"
    assert f("-0.004", False, 2)[1] == "0.00" and f("1.50", True, None)[1] == "1.50" and f("2.5", False, 0)[1] == "2"
    assert f("1e3", True, None)[1] == "1,000" and f("1" * 39, True, None)[0] is display.Shown.UNAVAILABLE
    assert f("1e200", True, None)[0] is display.Shown.UNAVAILABLE and f("abc", True, None) == (display.Shown.UNAVAILABLE, "abc")


def test_format_cells(spark):
    D, I, Fm, P = ColumnType(Kind.DECIMAL), ColumnType(Kind.INTEGER), display.Format, display.Preset
    cell = display.format_cell
    assert cell("1234", I, Fm(grouping=True))[1] == "1,234" and cell("1234.0", I, Fm(grouping=True)) == (display.Shown.ORIGINAL, "1234.0")
    assert cell("1234", D, Fm(grouping=True))[1] == "1234" and cell("1.5", D, Fm(fraction_digits=39))[0] is display.Shown.UNAVAILABLE
    day, naive, zoned = ColumnType(Kind.DATE), ColumnType(Kind.DATETIME, Zone.NAIVE), ColumnType(Kind.DATETIME, Zone.ZONED)
    assert [cell("2024-03-05", day, Fm(preset=p))[1] for p in (P.SHORT, P.MEDIUM, P.LONG)] == ["03/05/24", "Mar  5, 2024", "Tuesday, March  5, 2024"]
    assert cell("2024-03-05T07:08:09.5", naive, Fm(preset=P.MEDIUM))[1] == "Mar  5, 2024, 07:08:09"
    assert cell("2024-03-05T07:08:09-02:30", zoned, Fm(preset=P.SHORT))[1] == "03/05/24 07:08 -02:30"
    assert cell("2024-03-05T07:08:09", zoned, Fm(preset=P.SHORT))[0] is display.Shown.ORIGINAL
    got = column(spark, ["1234567", "-0", "12", "x", "+1234"], display.grouped_integer, lambda c: display.formatted(c, I, Fm(grouping=True))["text"])
    assert got == [("1,234,567",) * 2, ("0",) * 2, ("12",) * 2, ("x",) * 2, ("1,234",) * 2]


def test_comparisons_are_exact(spark):
    """Every number against every other as the request's value, by decimals where they hold both and by keys elsewhere."""
    from tabulon.plans.predicate import cell_match
    from tabulon.spec import Mode, SearchRequest

    more = ["9999999999999999999", "10000000000000000000", "0.000000000000000001", "0.0000000000000000001", "-9999999999999999999.999999999999999999", "1.0000000000000000001"]
    values = [v for v in NUMBERS + more if "e4" not in v and "e-4" not in v]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values + NOT_NUMBERS)], "k int, v string")
    for mode, holds in ((Mode.LT, lambda a, b: a < b), (Mode.GE, lambda a, b: a >= b)):
        row = df.select("k", *(cell_match(SearchRequest(mode, w, 0), F.col("v")).alias(f"m{n}") for n, w in enumerate(values))).orderBy("k").collect()
        for v, r in zip(values, row, strict=False):
            assert [bool(x) for x in r[1:]] == [holds(fraction(v), fraction(w)) for w in values], (mode, v)
        assert not any(any(r[1:]) for r in row[len(values) :])
