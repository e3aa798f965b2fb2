"""Views over a small table with known answers."""

import pytest

from tabulon.errors import InvalidArgument, NoColumn
from tabulon.operators.view import Found
from tabulon.spec import Mode, SearchRequest
from tabulon.table import open_table

FIND = """name,qty,note
Kettle,3,made of copper
COPPER,40,heavy
copper,3.0,light
caliper,-7,Copper rivet
Chisel,5e2,hot
brûlé,0.25,BRÛLÉ
,8.,coppercopper
hammer,xyz,trim copper
"""


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("find") / "find.csv"
    path.write_text(FIND, encoding="utf-8")
    return open_table(spark, str(path))


def text(value, scope=None, case=False):
    return SearchRequest(Mode.TEXT, value, scope=scope, case_sensitive=case)


def order(view):
    return [r["source_row"] for r in view.numbered.select("view_row", "source_row").orderBy("view_row").collect()]


def test_shape(table):
    assert table.spec.labels == ("name", "qty", "note") and table.count() == 8


def test_text_filters(table):
    assert order(table.where(text("copper"))) == [0, 1, 2, 3, 6, 7]
    assert order(table.where(text("copper", (0,)))) == [1, 2]
    assert order(table.where(text("copper", (2,)))) == [0, 3, 6, 7]
    assert order(table.where(text("copper", (1,)))) == []
    assert order(table.where(text("Copper", case=True))) == [3]
    assert order(table.where(text("BRÛLÉ"))) == [5]


def test_comparisons(table):
    compare = lambda mode, value, column=1: order(table.where(SearchRequest(mode, value, column)))
    assert compare(Mode.EQ, "3.0") == [2] and compare(Mode.EQ, "3") == [0] and compare(Mode.EQ, "", 0) == [6]
    assert compare(Mode.GE, "3") == [0, 1, 2, 4, 6] and compare(Mode.LT, "3") == [3, 5]
    assert compare(Mode.LE, "3") == [0, 2, 3, 5] and compare(Mode.GT, "39.999999999999999999999") == [1, 4]
    assert compare(Mode.NE, "xyz") == [0, 1, 2, 3, 4, 5, 6]


def test_requests_are_checked(table):
    for bad in (text(""), text("x", ()), text("x", (9,)), SearchRequest(Mode.LT, "abc", 1), SearchRequest(Mode.EQ, "x")):
        with pytest.raises(InvalidArgument):
            table.where(bad)
    with pytest.raises(NoColumn):
        table.order_by(3)
    assert text("x", (2, 0, 1)).normalized(3) == text("x").normalized(3)


def test_find(table):
    find = table.view().find(text("copper"))
    assert find.total == 6
    first, last = find.next(0), find.previous(8)
    assert (first.row, first.column, first.position) == (0, 2, 1) and (last.row, last.column, last.position) == (7, 2, 6)
    assert find.previous(0).state is Found.EXHAUSTED and find.next(8).state is Found.EXHAUSTED
    assert find.wrapped(True, 8) == (first, True)
    assert [tuple(r) for r in find.ranked().orderBy("view_row").select("view_row", "position").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4), (6, 5), (7, 6)]


def test_find_under_filter_and_sort(table):
    view = table.where(SearchRequest(Mode.GE, "3", 1))
    find = view.find(text("copper"))
    assert find.total == 4 and [r[0] for r in find.matched.orderBy("view_row").select("view_row").collect()] == [0, 1, 2, 4]
    ordered = table.order_by(0)
    hit = ordered.find(text("copper")).next(1)
    assert (hit.row, hit.source_row, hit.position) == (2, 3, 2)


def test_sorts(table):
    up = table.order_by(0)
    assert order(up) == [6, 5, 3, 4, 1, 2, 7, 0]
    assert order(table.order_by(0, True)) == [0, 7, 2, 1, 4, 3, 5, 6]
    assert order(table.where(SearchRequest(Mode.GE, "3", 1)).order_by(0)) == [6, 4, 1, 2, 0]
    assert [r["source_row"] for r in up.prefix(3).orderBy("view_row").collect()] == [6, 5, 3]
    assert [r["c0"] for r in up.window(2, 3).orderBy("view_row").collect()] == ["caliper", "Chisel", "COPPER"]
    assert up.source_row(0) == 6 and up.source_row(99) is None


def test_jumps(table):
    view = table.where(text("copper"))
    assert (view.jump(4), view.jump(99), view.jump(0)) == (4, 5, 0)
    assert table.view().jump(99) == 7 and table.order_by(0).jump(6) == 0 and table.where(text("zzz")).jump(3) == 0
    assert view.order_by(0).jump(4) == 0  # the first kept row from 4 on is 6, which sorts first


def test_match_flags_and_copy(table):
    flags = table.view().match_flags(text("copper", (0, 2)), 0, 3, [0, 1, 2]).orderBy("view_row").collect()
    assert [tuple(r) for r in flags] == [(0, False, False, True), (1, True, False, False), (2, True, False, False)]
    got = table.view().copy(0, 2, [0, 1])
    assert (got.text, got.rows, got.capped) == ("Kettle\t3\nCOPPER\t40", 2, False)
    assert table.view().copy(0, 8, [0, 1], max_cells=3).text == "Kettle\t3\nCOPPER" and table.view().copy(0, 8, [0, 1], max_cells=3).capped
    assert table.view().copy(3, 1, [1]).text == "-7" and table.view().copy(0, 8, [0, 1], max_bytes=9).text == "Kettle\t3"


def test_equal_requests_share_a_count(table):
    table.totals.clear()
    assert table.view().find(text("copper")).total == table.order_by(0).find(text("copper", (0, 1, 2))).total == 6
    assert len(table.totals) == 1 and table.view().content_widths(0, 3, [0, 2]) == {0: 6, 2: 14}


def test_numeric_sort_with_groups(table):
    from tabulon.spec import ColumnType, Kind

    table.columns.override(1, ColumnType(Kind.DECIMAL))
    assert order(table.order_by(1)) == [3, 5, 0, 2, 6, 1, 4, 7]
    assert order(table.order_by(1, True)) == [7, 4, 1, 6, 2, 0, 5, 3]
    table.columns.sentinel(1, "3")
    assert order(table.order_by(1)) == [3, 5, 2, 6, 1, 4, 7, 0]
    table.columns.override(1, ColumnType(Kind.INTEGER))
    assert order(table.order_by(1)) == [3, 1, 5, 2, 4, 6, 7, 0]
    table.columns.sentinel(1, None)
    table.columns.override(1, None)
