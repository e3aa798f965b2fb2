"""Views: identity, filtered, sorted, or both; windows, jumps, finds and copies in view coordinates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from enum import Enum
from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon import spec as S
from tabulon.errors import InvalidArgument, NoColumn
from tabulon.functions.output import neutralize, tsv_row
from tabulon.functions.text import cap
from tabulon.plans import numbering, ordering, predicate

if TYPE_CHECKING:
    from tabulon.table import Table


class Found(Enum):
    FOUND = "found"
    EXHAUSTED = "exhausted"


class CellState(Enum):
    OK = "ok"
    NO_CELL = "no cell"


@dataclass(frozen=True)
class Hit:
    """Where a navigation ended: view row, column and 1-based rank among the matches."""

    state: Found
    row: int | None = None
    column: int | None = None
    position: int | None = None
    source_row: int | None = None


@dataclass(frozen=True)
class Copy:
    """What a copy gave: text, rows done, and whether a cap ended it."""

    text: str
    rows: int
    capped: bool


@dataclass(frozen=True, eq=False)
class View:
    """Immutable: each change gives another view. Row numbers are from 0 and of this view unless called source rows."""

    table: Table
    filter: S.SearchRequest | None = None
    sort: S.SortSpec | None = None

    # -- composition

    def where(self, request: S.SearchRequest | None) -> View:
        """One filter, replacing any before it; a sort stays."""
        return replace(self, filter=request and request.normalized(self.table.spec.column_count))

    def order_by(self, column: int | None, descending: bool = False) -> View:
        """One key, by the column's effective type and sentinel as they are now; a filter stays."""
        if column is None:
            return replace(self, sort=None)
        if not 0 <= column < self.table.spec.column_count:
            raise NoColumn(f"there is no column {column}")
        state = self.table.columns.metadata(column)
        return replace(self, sort=S.SortSpec(column, descending, state.effective, state.sentinel))

    # -- rows

    def _kept(self) -> DataFrame:
        rows = self.table.rows
        if self.filter is None:
            return rows
        typed = None
        if self.table.kinds and self.filter.mode is not S.Mode.TEXT:
            typed = predicate.typed_equivalent(self.filter, F.col(f"v{self.filter.column}"), self.table.kinds[self.filter.column])
        return rows.where(predicate.matches(self.filter, self.table.cells) if typed is None else typed)

    def _keys(self) -> list[tuple[str, Column]]:
        c = F.col(f"c{self.sort.column}")
        found = None
        if self.table.kinds:
            found = ordering.typed_keys(c, F.col(f"v{self.sort.column}"), self.table.kinds[self.sort.column], self.sort)
        return found or ordering.keys(c, self.sort)

    @cached_property
    def _ranks(self) -> DataFrame:
        """(source_row, rank) in ascending order; shared by both directions."""
        known = self.table.rank_tables
        key = (self.filter, replace(self.sort, descending=False))
        if key not in known:
            named = self._keys()
            narrow = self._kept().select("source_row", *(c.alias(n) for n, c in named))
            order = [F.col(n).asc_nulls_first() for n, _ in named] + [F.col("source_row").asc()]
            ranked = numbering.by_order(narrow, order, "rank").select("source_row", "rank")
            known[key] = (ranked, ranked.count())
        return known[key][0]

    def _numbers(self) -> DataFrame:
        """(source_row, view_row) of a sorted view; descending is the exact reverse."""
        ranks = self._ranks
        if not self.sort.descending:
            return ranks.withColumnRenamed("rank", "view_row")
        last = self.table.rank_tables[self.filter, replace(self.sort, descending=False)][1] - 1
        return ranks.select("source_row", (F.lit(last) - F.col("rank")).alias("view_row"))

    @property
    def numbered(self) -> DataFrame:
        """All rows with ``view_row`` and ``source_row``; lazy, so only the columns asked for are read."""
        if self.sort is not None:
            return self._kept().join(self._numbers(), "source_row")
        if self.filter is None:
            return self.table.rows.withColumn("view_row", F.col("source_row"))
        return numbering.by_position(self._kept(), "source_row", "view_row", self.table.spec.row_count)

    def count(self) -> int:
        if self.filter is None and self.table.spec.row_count is not None:
            return self.table.spec.row_count
        known, key = self.table.totals, (self.filter, None)
        if key not in known:
            known[key] = self._kept().count()
        return known[key]

    def content_widths(self, first: int, count: int, columns: Sequence[int]) -> dict[int, int]:
        """The most characters of each column's cells within a window."""
        got = self.window(first, count, columns).agg(*(F.max(F.char_length(f"c{k}")) for k in columns)).first()
        return {k: n or 0 for k, n in zip(columns, got, strict=True)}

    def window(self, first: int, count: int, columns: Sequence[int] | None = None) -> DataFrame:
        """view_row, source_row and the cells of up to 4,096 rows; other columns aren't read."""
        if first < 0 or count < 0:
            raise InvalidArgument("a window begins at a row and has a count")
        columns = range(self.table.spec.column_count) if columns is None else columns
        inside = F.col("view_row").between(first, first + min(count, S.WINDOW_ROWS) - 1)
        cells = [f"c{k}" for k in columns]
        if self.sort is None and self.filter is None:
            got = self.table.between(first, first + min(count, S.WINDOW_ROWS), list(columns))
            return got.select(F.col("source_row").alias("view_row"), "source_row", *cells)
        if self.sort is None:
            return self.numbered.where(inside).select("view_row", "source_row", *cells)
        # the window's rows are few, so the table is read once against a broadcast of them
        few = self._numbers().where(inside)
        return self.table.rows.join(F.broadcast(few), "source_row").select("view_row", "source_row", *cells)

    def displayed(self, first: int, count: int, columns: Sequence[int] | None = None) -> DataFrame:
        """The window with each cell cut for display: structs of text and truncated."""
        got = self.window(first, count, columns)
        return got.select("view_row", "source_row", *(cap(F.col(c), S.DISPLAY_BYTES).alias(c) for c in got.columns if c not in ("view_row", "source_row")))

    def prefix(self, most: int = S.PREFIX_ROWS) -> DataFrame:
        """The first rows of the sort by a top-k, without ranking all: view_row, source_row and cells."""
        if self.sort is None:
            raise InvalidArgument("only a sorted view has a prefix of its order")
        named = self._keys()
        rows = self._kept().select("source_row", *(f"c{k}" for k in range(self.table.spec.column_count)), *(c.alias(n) for n, c in named))
        names = [*(n for n, _ in named), "source_row"]
        order = [F.col(n).desc_nulls_last() if self.sort.descending else F.col(n).asc_nulls_first() for n in names]
        top = rows.orderBy(*order).limit(most)
        # the limit bounds the rows, so one task numbers them
        from pyspark.sql import Window

        return top.withColumn("view_row", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")).drop(*(n for n, _ in named))

    def source_row(self, view_row: int) -> int | None:
        got = (self._numbers() if self.sort is not None else self.numbered).where(F.col("view_row") == view_row).select("source_row").first()
        return got and got[0]

    def jump(self, target: int) -> int | None:
        """The view row for an original row: itself or the last (identity), the first kept row from it on or else the last
        kept (filter; 0 if there is none), its place (sort)."""
        if self.filter is None and self.sort is None:
            n = self.count()
            return min(target, n - 1) if n else 0
        if self.filter is None:
            n = self.count()
            got = self._numbers().where(F.col("source_row") == min(target, n - 1)).select("view_row").first() if n else None
            return got[0] if got else 0
        kept = self._kept().select("source_row")
        before, n, at, last = kept.agg(
            F.count(F.when(F.col("source_row") < target, 1)), F.count("*"), F.min(F.when(F.col("source_row") >= target, F.col("source_row"))), F.max("source_row")
        ).first()
        if not n:
            return 0
        if self.sort is None:
            return min(before, n - 1)
        return self._numbers().where(F.col("source_row") == (last if at is None else at)).select("view_row").first()[0]

    # -- find

    def find(self, request: S.SearchRequest) -> Find:
        return Find(self, request.normalized(self.table.spec.column_count))

    def match_flags(self, request: S.SearchRequest, first: int, count: int, columns: Sequence[int]) -> DataFrame:
        """view_row and a boolean per column, over the text as displayed; a column out of the request's scope is false."""
        request = request.normalized(self.table.spec.column_count)
        scope = set(predicate.columns_of(request, self.table.spec.column_count))
        got = self.window(first, count, columns)
        shown = lambda k: cap(F.col(f"c{k}"), S.DISPLAY_BYTES)["text"]
        return got.select("view_row", *((predicate.cell_match(request, shown(k)) if k in scope else F.lit(False)).alias(f"m{k}") for k in columns))

    # -- output

    def read_cell(self, view_row: int, column: int) -> tuple[CellState, str]:
        """A whole cell, made safe for a spreadsheet, and whether there is one."""
        got = self.cell(view_row, column)
        return (CellState.NO_CELL, "") if got is None else (CellState.OK, got)

    def oversized(self, first: int, count: int) -> DataFrame:
        """view_row and whether the source row's extent is over the limit, for a window; Parquet rows have no extent."""
        inside = F.col("view_row").between(first, first + min(count, S.WINDOW_ROWS) - 1)
        rows = self.numbered if "oversized" in self.table.rows.columns else self.numbered.withColumn("oversized", F.lit(False))
        return rows.where(inside).select("view_row", "oversized")

    def cell(self, view_row: int, column: int) -> str | None:
        """One whole cell, made safe for a spreadsheet; None if there is no such cell."""
        if not 0 <= column < self.table.spec.column_count:
            return None
        got = self.window(view_row, 1, [column]).select(neutralize(F.col(f"c{column}"))).first()
        return got and got[0]

    def tsv_rows(self, first: int, count: int, columns: Sequence[int]) -> DataFrame:
        """(view_row, line): framed rows of any number."""
        inside = F.col("view_row").between(first, first + count - 1)
        rows = self.numbered.where(inside)
        return rows.select("view_row", tsv_row([F.col(f"c{k}") for k in columns]).alias("line"))

    def copy(self, first: int, count: int, columns: Sequence[int], max_cells: int = S.COPY_CELLS, max_bytes: int | None = None) -> Copy:
        """Rows as one tab-separated text without a last line end. One cell alone is raw; cells beyond the cap, row by row, are
        left out."""
        columns = [k for k in columns if 0 <= k < self.table.spec.column_count]
        count = max(0, min(count, self.count() - first))
        if not columns or not count:
            return Copy("", 0, False)
        if len(columns) == 1 and count == 1:
            return Copy(self.cell(first, columns[0]) or "", 1, False)
        whole, part = divmod(max_cells, len(columns))
        lines, size, capped = [], 0, count > whole
        for line in self.lines(first, min(count, whole), columns):
            size += len(line.encode()) + 1
            if max_bytes is not None and size - 1 > max_bytes:
                return Copy("\n".join(lines), len(lines), True)
            lines.append(line)
        rows = len(lines)
        if capped and part:
            lines += self.lines(first + whole, 1, columns[:part])
        return Copy("\n".join(lines), rows, capped)

    def lines(self, first: int, count: int, columns: Sequence[int]) -> Iterator[str]:
        """Framed rows in order, as a stream: the driver holds a block of rows at a time. Blocks are made on the executors."""
        if count <= 0:
            return
        rows = self.tsv_rows(first, count, columns).orderBy("view_row").select("line")
        blocks = rows.mapInArrow(_blocks, "lines array<string>")
        for block in blocks.toLocalIterator(prefetchPartitions=True):
            yield from block[0]

    def copy_to(self, path: str, first: int, count: int, columns: Sequence[int]) -> None:
        """The same rows as text files at ``path``, in the order of their names; nothing passes through the driver."""
        self.tsv_rows(first, count, columns).orderBy("view_row").select("line").write.text(path)


def _blocks(batches):
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            offsets = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, batch.column(0))], names=["lines"])


@dataclass(frozen=True, eq=False)
class Find:
    """Matches of one request within one view."""

    view: View
    request: S.SearchRequest

    @property
    def matched(self) -> DataFrame:
        """view_row, source_row and the lowest matching column."""
        cells = self.view.table.cells
        rows = self.view.numbered
        return rows.where(predicate.matches(self.request, cells)).select("view_row", "source_row", predicate.match_column(self.request, cells).alias("match_column"))

    @property
    def total(self) -> int:
        """Counted without numbering, once for requests of equal meaning under one filter; sorts don't change it."""
        known, key = self.view.table.totals, (self.view.filter, self.request)
        if key not in known:
            known[key] = self.view._kept().where(predicate.matches(self.request, self.view.table.cells)).count()
        return known[key]

    def ranked(self) -> DataFrame:
        """``matched`` with the 1-based ``position`` among the matches."""
        return numbering.by_position(self.matched, "view_row", "before_", self.view.table.spec.row_count).withColumn("position", F.col("before_") + 1).drop("before_")

    def block_counts(self) -> DataFrame:
        """(block, matches): matches per 2,048 source rows; blocks without any are left out."""
        rows = self.view._kept().where(predicate.matches(self.request, self.view.table.cells))
        return rows.groupBy(F.floor(F.col("source_row") / S.BLOCK_ROWS).cast("long").alias("block")).agg(F.count("*").alias("matches"))

    def next(self, anchor: int) -> Hit:
        """The first match at or after the anchor."""
        return self._go(F.col("view_row") >= anchor, F.min, anchor, 1)

    def previous(self, anchor: int) -> Hit:
        """The last match before the anchor."""
        return self._go(F.col("view_row") < anchor, F.max, anchor, 0)

    def _go(self, ahead: Column, pick, anchor: int, more: int) -> Hit:
        place = F.struct("view_row", "source_row", "match_column")
        view, cells = self.view, self.view.table.cells
        matched = self.matched
        known, key = view.table.rank_tables, ("matches", view.filter, view.sort, self.request)
        if key in known:
            # navigated before: its matches are kept from now on, so that a step reads them alone
            if known[key] is None:
                path = numbering.new_path(view.table.spark, "matches")
                matched.write.parquet(path)
                known[key] = view.table.spark.read.schema(matched.schema).parquet(path)
            matched = known[key]
        elif view.filter is None and view.sort is None:
            # view rows are source rows: one pass without numbering
            matched = view.table.rows.where(predicate.matches(self.request, cells)).select(F.col("source_row").alias("view_row"), "source_row", predicate.match_column(self.request, cells).alias("match_column"))
        known.setdefault(key, None)
        before, at = matched.agg(F.count(F.when(F.col("view_row") < anchor, 1)), pick(F.when(ahead, place))).first()
        return Hit(Found.EXHAUSTED) if at is None else Hit(Found.FOUND, at["view_row"], at["match_column"], before + more, at["source_row"])

    def wrapped(self, forward: bool, anchor: int) -> tuple[Hit, bool]:
        """A navigation that starts again at the other end; the flag says whether it did."""
        hit = self.next(anchor) if forward else self.previous(anchor)
        if hit.state is Found.FOUND or not self.total:
            return hit, False
        return (self.next(0) if forward else self.previous(self.view.count())), True
