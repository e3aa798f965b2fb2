"""Column settings of one open table: inference from ordered evidence, overrides, sentinels, conflicts, label search."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from enum import Enum
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from tabulon import spec as S
from tabulon.errors import InvalidArgument, NoColumn, NoProposal
from tabulon.operators.evidence import Confidence, Conflict, Evidence, State
from tabulon.sources import delimited
from tabulon.spec import UNKNOWN, ColumnType, Kind, Zone

if TYPE_CHECKING:
    from tabulon.table import Table

HEAD_ROWS = 256
HEAD_BYTES = 4 << 20


@dataclass(frozen=True)
class Metadata:
    column: int
    label: str | None
    effective: ColumnType
    declared: ColumnType | None
    inferred: ColumnType | None
    override: ColumnType | None
    proposal: ColumnType | None
    sentinel: str | None
    state: State
    confidence: Confidence
    conflict: Conflict
    evidence: int
    rows: int
    bytes: int
    empty: int
    null: int
    conflicts: int
    conflict_row: int | None
    conflict_example: str | None
    conflict_truncated: bool


class Columns:
    """Session state of a table's columns; nothing of it is written anywhere."""

    def __init__(self, table: Table) -> None:
        self.table = table
        self.overrides: dict[int, ColumnType] = {}
        self.sentinels: dict[int, str] = {}
        self.evidence: dict[int, Evidence] = {}
        self.requested: set[int] = set()

    def _check(self, column: int) -> None:
        if not 0 <= column < self.table.spec.column_count:
            raise NoColumn(f"there is no column {column}")

    def metadata(self, column: int) -> Metadata:
        self._check(column)
        e = self.evidence.get(column, Evidence())
        declared = self.table.spec.declared[column] if self.table.spec.declared else None
        inferred = e.type if e.published else None
        odd = e.odd_first
        effective = self.overrides.get(column) or inferred or declared or UNKNOWN
        return Metadata(
            column, self.table.spec.labels[column], effective, declared, e.type, self.overrides.get(column), e.proposal, self.sentinels.get(column), e.state, e.confidence,
            e.conflict, e.agreeing, len(e.rows), e.bytes, e.empty, e.null, e.conflicts, odd and odd.row, odd and odd.example[0], odd is not None and odd.example[1],
        )

    def infer(self, columns: Iterable[int]) -> list[Metadata]:
        """Types of some columns from the first 256 rows (and 4 MiB), folded in source order. Declared types need nothing."""
        wanted = list(dict.fromkeys(columns))
        if not wanted or len(wanted) > S.BATCH_COLUMNS:
            raise InvalidArgument(f"1 to {S.BATCH_COLUMNS} columns can be asked for at once")
        for k in wanted:
            self._check(k)
        if self.table.spec.is_parquet:
            return [self.metadata(k) for k in wanted]
        self.requested.update(wanted)
        self._head(wanted)
        return [self.metadata(k) for k in wanted]

    def _head(self, columns: Sequence[int]) -> None:
        rows = delimited.head(self.table.spec, HEAD_ROWS + 1)
        size, taken = 0, 0
        for number, row in enumerate(rows[:HEAD_ROWS]):
            size += sum(len(row[k].encode()) for k in columns)
            if size > HEAD_BYTES and taken:
                break
            taken += 1
            for k in columns:
                self.evidence.setdefault(k, Evidence()).observe(number, row[k], self.sentinels.get(k), self.overrides.get(k))
        for k in columns:
            self.evidence.setdefault(k, Evidence()).settle(taken == len(rows))

    def observe(self, rows: Iterable[tuple[int, dict[int, str]]]) -> None:
        """Evidence from rows that a user looks at: (source row, {column: text}); only columns once inferred take it."""
        for row, cells in rows:
            for k, value in cells.items():
                if k in self.requested:
                    self.evidence[k].observe(row, value, self.sentinels.get(k), self.overrides.get(k))
        for k in self.requested:
            self.evidence[k].settle(False)

    def override(self, column: int, type_: ColumnType | None) -> None:
        """A type for a column, or none again. Date-times need a zone, nothing else takes parameters."""
        self._check(column)
        e = self.evidence.setdefault(column, Evidence())
        if type_ is None:
            if self.overrides.pop(column, None) is not None:
                e.forget_conflicts()
            return
        zoned = type_.kind is Kind.DATETIME
        if type_.kind in (Kind.UNKNOWN, Kind.UNSUPPORTED) or zoned == (type_.zone is Zone.NONE) or (type_.precision, type_.scale, type_.fraction_digits) != (None,) * 3:
            raise InvalidArgument(f"{type_} can't be an override")
        self.overrides[column] = type_
        e.hold_against(type_)

    def sentinel(self, column: int, text: str | None) -> None:
        """The text that stands for null, or none; evidence starts again."""
        self._check(column)
        if text is not None and len(text.encode()) > S.SENTINEL_BYTES:
            raise InvalidArgument(f"a sentinel has {S.SENTINEL_BYTES} bytes at most")
        if self.sentinels.get(column) == text:
            return
        if text is None:
            del self.sentinels[column]
        else:
            self.sentinels[column] = text
        self.evidence[column] = Evidence()
        if column in self.requested:
            self._head([column])

    def accept_proposal(self, column: int) -> None:
        self._check(column)
        e = self.evidence.get(column)
        if e is None or e.proposal is None:
            raise NoProposal(f"column {column} has no proposal")
        e.accept()

    def batch(self, columns: Sequence[int]) -> list[Metadata]:
        """Metadata in the caller's order, repeats allowed; all or nothing."""
        if len(columns) > S.BATCH_COLUMNS:
            raise InvalidArgument(f"at most {S.BATCH_COLUMNS} columns at once")
        return [self.metadata(k) for k in columns]


def stats(df, columns: Sequence[str]):
    """One pass over whole columns: per column the number of empty cells and of each kind, as one row a column."""
    from functools import reduce

    from tabulon.functions.classify import classify

    kinds = ("boolean", "integer", "decimal", "date", "datetime_naive", "datetime_zoned", "text")
    marked = df.select(*(F.when(F.col(c) == "", "empty").otherwise(classify(F.col(c))).alias(c) for c in columns))
    wide = marked.agg(*(F.count(F.when(F.col(c) == k, 1)).alias(f"{c}:{k}") for c in columns for k in ("empty", *kinds)))
    return reduce(lambda a, b: a.union(b), (wide.select(F.lit(c).alias("column"), *(F.col(f"`{c}:{k}`").alias(f"n_{k}") for k in ("empty", *kinds))) for c in columns))


# -- labels


def generic_name(column: int) -> str:
    """A, B, ... Z, AA, AB, ...: the name of a column without a label."""
    name, n = "", column + 1
    while n:
        n, digit = divmod(n - 1, 26)
        name = chr(ord("A") + digit) + name
    return name


def shown_name(labels: Sequence[str | None], column: int) -> str:
    return labels[column] or generic_name(column)


def search_labels(labels: Sequence[str | None], query: str, most: int = 10) -> tuple[list[int], bool]:
    """Columns whose label holds the query in any case, and whether there are more. ``#N`` is column N itself; a column without
    a label is searched as its generic name and number."""
    if query.startswith("#"):
        digits = query[1:]
        if digits.isascii() and digits.isdigit() and not digits.startswith("0") and int(digits) <= len(labels):
            return [int(digits) - 1], False
        return [], False
    wanted = query.casefold()
    found = [k for k, label in enumerate(labels) if wanted in (label or f"{generic_name(k)} {k + 1}").casefold()]
    return found[:most], len(found) > most


def keeps_settings(before: S.TableSpec, after: S.TableSpec, header_only: bool) -> bool:
    """Whether settings by column number survive opening again: always after a header change of equal width, else only where all
    labels are the same."""
    same_width = before.column_count == after.column_count
    return same_width if header_only else same_width and before.labels == after.labels


class Alignment(Enum):
    LEADING = "leading"
    CENTER = "center"
    TRAILING = "trailing"


def alignment(kind: Kind) -> Alignment:
    if kind is Kind.BOOLEAN:
        return Alignment.CENTER
    return Alignment.TRAILING if kind in (Kind.INTEGER, Kind.DECIMAL, Kind.DATE, Kind.DATETIME) else Alignment.LEADING
