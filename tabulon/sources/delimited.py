"""Delimited text as a Spark data source: Arrow batches of text cells with their source rows.

Plain files in encodings whose ASCII bytes stand for themselves are split: candidate splits lie after line ends, and since
such a line end may lie within a quoted field, each candidate's records are counted both ways, in parallel; going through the
counts in order tells which way is right, where splits can begin, and each one's first source row. Gzip files and UTF-16 are
read by one task as a stream.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulon.sources import encoding, storage
from tabulon.sources.lexer import fitted, records
from tabulon.spec import OVERSIZED_ROW_BYTES, TableSpec

NAME = "tabulon_delimited"
SPLIT_BYTES = 32 << 20
BATCH_CHARS = 4 << 20
BATCH_ROWS = 8192
GZIP = b"\x1f\x8b"
#: Rows up to here are read from the file's begin if the splits aren't known yet.
NEAR_ROWS = 1 << 16


def inflated(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Concatenated gzip members. Where the stream is cut or damaged, what could be decoded before is all there is."""
    member, started, held = zlib.decompressobj(31), False, b""
    for piece in pieces:
        data = held + piece
        held = b""
        while data:
            if not started and len(data) < 2:
                held = data
                break
            if not started and data[:2] != GZIP:
                return
            started = True
            try:
                out = member.decompress(data)
            except zlib.error:
                return
            if out:
                yield out
            if not member.eof:
                break
            data, member, started = member.unused_data, zlib.decompressobj(31), False


def decoded(pieces: Iterable[bytes], name: str) -> Iterator[str]:
    step = encoding.decoder(name)
    for piece in pieces:
        if text := step.decode(piece):
            yield text
    if text := step.decode(b"", final=True):
        yield text


def skipped(pieces: Iterable[bytes], n: int) -> Iterator[bytes]:
    for piece in pieces:
        if n >= len(piece):
            n -= len(piece)
            continue
        yield piece[n:]
        n = 0


def text_of(path: str, gzip: bool, name: str, start: int, stop: int) -> Iterator[str]:
    """Text from byte ``start``, of the inflated bytes if the file is gzip."""
    raw = skipped(inflated(storage.pieces(path, 0, stop)), start) if gzip else storage.pieces(path, start, stop)
    return decoded(raw, name)


class Split(InputPartition):
    def __init__(self, start: int, stop: int, first_row: int) -> None:
        self.start, self.stop, self.first_row = start, stop, first_row


class DelimitedSource(DataSource):
    """Options: ``plan``, a JSON object of the file, its dialect, the splits and the columns to read."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        columns = json.loads(self.options["plan"])["columns"]
        return ", ".join(["source_row long", "oversized boolean", *(f"c{k} string" for k in columns)])

    def reader(self, schema) -> DelimitedReader:
        return DelimitedReader(json.loads(self.options["plan"]))


class DelimitedReader(DataSourceReader):
    def __init__(self, plan: dict) -> None:
        self.plan = plan

    def partitions(self) -> list[Split]:
        return [Split(*s) for s in self.plan["splits"]]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split is None:  # no split was asked for
            return
        p, row = self.plan, split.first_row
        names = ["source_row", "oversized", *(f"c{k}" for k in p["columns"])]
        rows: list[list[str]] = []
        large: list[bool] = []
        held = 0

        def batch() -> pa.RecordBatch:
            cells = list(zip(*rows, strict=True)) or [()] * p["width"]
            first = row - len(rows)
            return pa.RecordBatch.from_arrays([pa.array(range(first, row), pa.int64()), pa.array(large, pa.bool_()), *(pa.array(cells[k], pa.string()) for k in p["columns"])], names=names)

        for fields, _, chars in records(text_of(p["path"], p["gzip"], p["encoding"], split.start, split.stop), p["separator"], p["quote"]):
            rows.append(fitted(fields, p["width"]))
            # no character has over 4 bytes, so short records need no count
            large.append(chars * 4 > OVERSIZED_ROW_BYTES and (chars > OVERSIZED_ROW_BYTES or sum(len(f.encode()) for f in fields) + len(fields) > OVERSIZED_ROW_BYTES))
            row += 1
            held += chars
            if held >= BATCH_CHARS or len(rows) >= BATCH_ROWS:
                yield batch()
                rows, large, held = [], [], 0
            if row >= p["stop_row"]:
                break
        if rows:
            yield batch()


def _line_starts(path: str, low: int, high: int, step: int) -> list[int]:
    """Candidate splits: the first byte after a line end at or after every ``step`` bytes."""
    out = []
    with storage.opened(path) as f:
        at = low + step
        while at < high:
            f.seek(at - 1)
            found, base = -1, at - 1
            while found < 0 and base < high and (piece := f.read(1 << 16)):
                found, base = piece.find(b"\n"), base + len(piece)
            if found < 0:
                break
            begin = base - len(piece) + found + 1
            if begin >= high:
                break
            out.append(begin)
            at = begin + step
    return out


def _unquoted(path: str, quote: str, start: int, stop: int) -> int | None:
    """Records of a range without a quote, by its line ends alone; None where there is one."""
    n, last, mark = 0, b"", quote.encode("ascii")
    for piece in storage.pieces(path, start, stop):
        if mark and mark in piece:
            return None
        # a line end that two pieces share counts once
        n += piece.count(b"\n") + piece.count(b"\r") - piece.count(b"\r\n") - (last == b"\r" and piece[:1] == b"\n")
        last = piece[-1:]
    return n + (last not in (b"", b"\n", b"\r"))


def _count(path: str, name: str, separator: str, quote: str, start: int, stop: int, inside: bool) -> tuple[int, bool]:
    """Records that end in [start, stop), and whether the range ends within a quoted field."""
    if (n := _unquoted(path, quote, start, stop)) is not None:
        return (0, True) if inside else (n, False)
    n, last_open, tail = 0, False, ""
    for fields, opened, _ in records(text_of(path, False, name, start, stop), separator, quote, inside):
        n += 1
        last_open, tail = opened, fields[-1]
    # the range ends with a line end, so a last record that holds it is one whose quote is open
    unfinished = last_open and tail.endswith("\n")
    return n - unfinished, unfinished


def splits(spark: SparkSession, spec: TableSpec, step: int = SPLIT_BYTES) -> list[tuple[int, int, int]]:
    """(start, stop, first source row) of each split."""
    d, high = spec.dialect, spec.size_bytes
    whole = [(spec.data_start, high, 0)]
    if spec.gzip or not encoding.single_byte_marks(d.encoding) or high - spec.data_start <= step:
        return whole
    edges = [spec.data_start, *_line_starts(spec.path, spec.data_start, high, step), high]
    if len(edges) == 2:
        return whole
    ranges = list(zip(edges, edges[1:], strict=False))

    def run(batches):
        for batch in batches:
            for at, start, stop in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out = [_count(spec.path, d.encoding, d.separator, d.quote, start, stop, bool(d.quote) and inside) for inside in (False, True)]
                yield pa.RecordBatch.from_pydict({"at": [at], "n0": [out[0][0]], "open0": [out[0][1]], "n1": [out[1][0]], "open1": [out[1][1]]})

    asked = spark.createDataFrame([(k, *r) for k, r in enumerate(ranges)], "at long, start long, stop long").repartition(len(ranges))
    counted = sorted(asked.mapInArrow(run, "at long, n0 long, open0 boolean, n1 long, open1 boolean").collect())
    out, row, inside = [], 0, False
    for (start, stop), (_, n0, open0, n1, open1) in zip(ranges, counted, strict=True):
        if inside:  # the record that is open here belongs to the split before
            out[-1] = (out[-1][0], stop, out[-1][2])
        else:
            out.append((start, stop, row))
        row, inside = row + (n1 if inside else n0), open1 if inside else open0
    return out


FAR = 1 << 62


def known_splits(spark: SparkSession, spec: TableSpec, step: int = SPLIT_BYTES) -> list[tuple[int, int, int]]:
    """The splits, found once for a table."""
    if ("splits", step) not in spec.extra:
        spec.extra["splits", step] = splits(spark, spec, step)
    return spec.extra["splits", step]


def load(spark: SparkSession, spec: TableSpec, columns: list[int] | None = None, step: int = SPLIT_BYTES, rows: tuple[int, int] | None = None) -> DataFrame:
    """source_row, oversized and the cells of the wanted columns; with ``rows`` (first, stop), of these rows.

    Rows near the begin are read from there on up to the last one wanted. Others need the splits, of which those that hold
    some of the rows are read.
    """
    columns = list(range(spec.column_count)) if columns is None else columns
    d, stop = spec.dialect, FAR
    if rows is None:
        parts = known_splits(spark, spec, step)
    else:
        stop = rows[1]
        near = ("splits", step) not in spec.extra and stop <= NEAR_ROWS
        parts = [(spec.data_start, spec.size_bytes, 0)] if near else known_splits(spark, spec, step)
        ends = [*(p[2] for p in parts[1:]), FAR]
        parts = [p for p, end in zip(parts, ends, strict=True) if p[2] < stop and end > rows[0]]
    plan = {
        "path": spec.path, "gzip": spec.gzip, "encoding": d.encoding, "separator": d.separator, "quote": d.quote,
        "width": spec.column_count, "columns": columns, "splits": parts, "stop_row": stop,
    }
    spark.dataSource.register(DelimitedSource)
    found = spark.read.format(NAME).option("plan", json.dumps(plan)).load()
    return found if rows is None else found.where(found["source_row"].between(rows[0], rows[1] - 1))


def head(spec: TableSpec, most: int) -> list[list[str]]:
    """The first rows, read by the driver from the begin of the file alone."""
    out = []
    for fields, _, _ in records(text_of(spec.path, spec.gzip, spec.dialect.encoding, spec.data_start, spec.size_bytes), spec.dialect.separator, spec.dialect.quote):
        out.append(fitted(fields, spec.column_count))
        if len(out) == most:
            break
    return out
