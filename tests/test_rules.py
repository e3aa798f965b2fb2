import pytest

from tabulon.errors import InvalidArgument
from tabulon.operators import rules as R
from tabulon.operators.view import Copy, Found, Hit
from tabulon.spec import Mode, OpenOptions, SearchRequest


def test_dialect():
    carried = OpenOptions(separator=";")
    assert R.compose_dialect(carried, quote="'") == OpenOptions(separator=";", quote="'") and R.compose_dialect(carried, header=True).separator == ";"
    with pytest.raises(InvalidArgument):
        R.compose_dialect(carried, quote=";")
    for bad in ("", "ab", "\n", "é", "\x00"):
        with pytest.raises(InvalidArgument):
            R.custom_byte(bad)
    assert R.custom_byte("|") == "|"


def test_visible_columns():
    assert R.visible_columns((0, 2), 1, True, 3) == (0, 1, 2) and R.visible_columns((0, 2), 2, False, 3) == (0,) and R.visible_columns((0,), 0, False, 3) == (0,)
    assert R.carried_columns((1,), 3, 3) == (1,) and R.carried_columns((1,), 3, 2) == (0, 1)


def test_find_submit():
    assert R.find_request("", Mode.TEXT, None, (0, 1), 2) is None and R.find_request("x", Mode.GE, 1, (0,), 2) is None and R.find_request("5", Mode.GE, None, (0,), 2) is None
    assert R.find_request("x", Mode.TEXT, None, (1, 0), 2) == SearchRequest(Mode.TEXT, "x") and R.find_request("x", Mode.TEXT, None, (1,), 2).scope == (1,)
    assert R.find_request("", Mode.EQ, 0, (0,), 2) == SearchRequest(Mode.EQ, "", 0)


def test_told():
    none, some = Hit(Found.EXHAUSTED), Hit(Found.FOUND, 3, 0, 1)
    assert [R.notice(none, False, True, 0), R.notice(some, False, True, 5), R.notice(some, True, True, 5), R.notice(some, True, False, 5)] == list(R.Notice)[1:2] + [R.Notice.NONE, R.Notice.WRAPPED_TO_START, R.Notice.WRAPPED_TO_END]
    assert str(R.Banner(5, 1200)) == "5 of 1,200 rows" and str(R.Banner(5, 1200, True, 0.5)) == "5 of ~1,200 rows (50%)"


def test_jumps_and_copies():
    assert R.submit_jump(10, 10, True, False) is None and R.submit_jump(10, 10, False, False) == 10 and R.submit_jump(10, 10, True, True) == 10 and R.submit_jump(None, 1, True, False) is None
    assert not R.resolve_jump(5, 4, False) and R.resolve_jump(5, 4, True) and R.resolve_jump(5, 5, False) and not R.resolve_jump(5, None, True)
    assert R.copy_outcome(Copy("a", 1, False), 1, None) is R.CopyOutcome.COMPLETE
    assert R.copy_outcome(Copy("a", 1, True), 5, 10) is R.CopyOutcome.BYTES and R.copy_outcome(Copy("a", 1, True), 5, None) is R.CopyOutcome.CELLS
