"""Small decisions around requests: what a caller submits, and what it tells its user. Pure functions, no Spark."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from tabulon.errors import InvalidArgument
from tabulon.functions import numeric
from tabulon.operators.view import Copy, Found, Hit
from tabulon.spec import Mode, OpenOptions, SearchRequest


def compose_dialect(carried: OpenOptions, **changed) -> OpenOptions:
    """The carried options with one parameter forced. What was forced stays so, what was detected stays to be detected, and a
    byte that another forced parameter has is refused."""
    return carried.changed(**changed)


def custom_byte(text: str) -> str:
    """A separator or quote as typed: exactly one ASCII byte, no line end."""
    if len(text) != 1 or not 1 <= ord(text) <= 0x7F or text in "\r\n":
        raise InvalidArgument(f"{text!r} is not one ASCII character")
    return text


def visible_columns(shown: Sequence[int], column: int, visible: bool, column_count: int) -> tuple[int, ...]:
    """The ordered subset after showing or hiding one column; the last visible one stays."""
    if not 0 <= column < column_count:
        raise InvalidArgument(f"there is no column {column}")
    kept = {*shown, column} if visible else set(shown) - {column}
    return tuple(sorted(kept)) or tuple(shown)


def carried_columns(shown: Sequence[int], before: int, after: int) -> tuple[int, ...]:
    """Visible columns after opening again: kept where the number of columns is the same, else all."""
    return tuple(shown) if before == after else tuple(range(after))


def find_request(text: str, mode: Mode, column: int | None, shown: Sequence[int], column_count: int, case_sensitive: bool = False) -> SearchRequest | None:
    """What submitting a find means: nothing for an empty text search or an ordering by no number; all columns visible is no
    scope."""
    if mode is Mode.TEXT:
        if not text:
            return None
        scope = None if len(set(shown)) == column_count else tuple(sorted(set(shown)))
        return SearchRequest(mode, text, scope=scope, case_sensitive=case_sensitive)
    if column is None or mode.ordering and numeric.parse(text) is None:
        return None
    return SearchRequest(mode, text, column, case_sensitive=case_sensitive)


class Notice(Enum):
    NONE = "none"
    NO_MATCHES = "no matches"
    WRAPPED_TO_START = "continued from the start"
    WRAPPED_TO_END = "continued from the end"


def notice(hit: Hit, wrapped: bool, forward: bool, total: int) -> Notice:
    if hit.state is Found.EXHAUSTED and not total:
        return Notice.NO_MATCHES
    if not wrapped:
        return Notice.NONE
    return Notice.WRAPPED_TO_START if forward else Notice.WRAPPED_TO_END


@dataclass(frozen=True)
class Banner:
    """A filter's state in words."""

    matches: int
    rows: int
    estimated: bool = False
    progress: float | None = None

    def __str__(self) -> str:
        about = "~" if self.estimated else ""
        done = "" if self.progress is None else f" ({self.progress:.0%})"
        return f"{self.matches:,} of {about}{self.rows:,} rows{done}"


def submit_jump(row: int | None, count: int, exact: bool, filtered: bool) -> int | None:
    """A jump to a row that can't exist is refused, but under a filter it lands on what is kept."""
    if row is None or not filtered and exact and row >= count:
        return None
    return row


def resolve_jump(target: int, landed: int | None, filtered: bool) -> bool:
    """Whether a scan that ended at ``landed`` reached the target; if not, the viewport goes back."""
    return landed is not None and (filtered or landed >= target)


class CopyOutcome(Enum):
    COMPLETE = "complete"
    BYTES = "stopped at the byte budget"
    CELLS = "stopped at the cell cap"


def copy_outcome(copy: Copy, rows: int, max_bytes: int | None) -> CopyOutcome:
    if not copy.capped:
        return CopyOutcome.COMPLETE
    near = max_bytes is not None and copy.rows < rows and len(copy.text.encode()) <= max_bytes
    return CopyOutcome.BYTES if near else CopyOutcome.CELLS
