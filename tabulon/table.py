"""Opening a table: head probe, shape, and the rows as a DataFrame. No Spark job runs before an action."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from itertools import islice
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import ReadFailed, UnsupportedSchema
from tabulon.functions import numeric
from tabulon.operators.columns import Columns
from tabulon.operators.view import View
from tabulon.sources import delimited, encoding, http, parquet, storage
from tabulon.sources.lexer import records
from tabulon.sources.sniff import sniff
from tabulon.spec import MAX_COLUMNS, ColumnType, Dialect, OpenOptions, SearchRequest, TableSpec

HEAD_BYTES = 4 << 20
PARQUET_MARKS = (b"PAR1", b"PARE")


class Table:
    """One open table: a frozen shape, its rows (``source_row``, text cells ``c0``...), and its columns' session settings.

    ``rows`` is made when first asked for: finding the splits of a large text takes a pass over it, which opening doesn't.
    """

    def __init__(self, spark: SparkSession, spec: TableSpec, rows: Callable[[], DataFrame], kinds: tuple = (), between: Callable[[int, int, list[int]], DataFrame] | None = None) -> None:
        self.spark, self.spec, self.kinds = spark, spec, kinds
        self._make, self._between = rows, between
        self.columns = Columns(self)
        self.rank_tables: dict = {}
        self.totals: dict = {}
        self.cells: list[Column] = [F.col(f"c{k}") for k in range(spec.column_count)]

    @cached_property
    def rows(self) -> DataFrame:
        return self._make()

    def between(self, first: int, stop: int, columns: list[int]) -> DataFrame:
        """source_row and some cells of a range of source rows, reading the part of the source that holds them."""
        if self._between is not None:
            return self._between(first, stop, columns)
        return self.rows.where(F.col("source_row").between(first, stop - 1)).select("source_row", *(f"c{k}" for k in columns))

    @cached_property
    def estimated_count(self) -> tuple[int, bool]:
        """(rows, whether that is exact) by the head alone, without a job."""
        spec = self.spec
        if spec.row_count is not None:
            return spec.row_count, True
        if spec.is_parquet:
            return View(self).count(), True
        if spec.gzip or not encoding.single_byte_marks(spec.dialect.encoding):
            rows = delimited.head(spec, delimited.NEAR_ROWS)
            return len(rows), len(rows) < delimited.NEAR_ROWS
        stop = min(spec.size_bytes, spec.data_start + HEAD_BYTES)
        text = delimited.text_of(spec.path, False, spec.dialect.encoding, spec.data_start, stop)
        rows = sum(1 for _ in records(text, spec.dialect.separator, spec.dialect.quote))
        # the record that the head cuts isn't counted as scanned
        whole = stop == spec.size_bytes
        return (rows, True) if whole else (estimated_rows(spec.size_bytes - spec.data_start, max(1, rows - 1), stop - spec.data_start), False)

    def view(self) -> View:
        return View(self)

    def where(self, request: SearchRequest) -> View:
        return View(self).where(request)

    def order_by(self, column: int, descending: bool = False) -> View:
        return View(self).order_by(column, descending)

    def count(self) -> int:
        return View(self).count()


def header_of(first: list[str], forced: bool | None) -> bool:
    """Record 1 is a header unless all its cells are numbers."""
    return not all(numeric.parse(c) is not None for c in first) if forced is None else forced


def estimated_rows(total_bytes: int, rows: int, scanned: int) -> int:
    """Rows by the bytes scanned so far; never fewer than seen, and at least one while bytes remain."""
    if not scanned:
        return 1 if total_bytes else rows
    return max(rows, total_bytes * rows // scanned, 1 if total_bytes > scanned else 0)


def probe(path: str, options: OpenOptions = OpenOptions()) -> TableSpec:
    """The shape of delimited text by its head alone: encoding, dialect, header, width."""
    raw, size = storage.head(path, HEAD_BYTES), storage.size(path)
    gzip = raw[:2] == delimited.GZIP
    sample = b""
    if gzip:
        for piece in delimited.inflated([raw]):
            sample += piece
            if len(sample) >= HEAD_BYTES:
                break
    else:
        sample = raw
    name, bom = encoding.resolve(sample[: encoding.SAMPLE], options.encoding)
    decode = lambda data, final: encoding.decoder(name).decode(data, final)
    body = sample[bom:]
    separator, quote = sniff(decode(body[: encoding.SAMPLE], True), options)
    whole = len(sample) == (size if not gzip else -1) or gzip and size <= HEAD_BYTES and len(sample) < HEAD_BYTES
    text = decode(body, whole)
    first = next(records([text], separator, quote), None)
    if first is None:
        dialect = Dialect(separator, quote, name, bom, False)
        return TableSpec(path, (), dialect, (), size, 0, gzip, bom)
    fields, _, chars = first
    if chars == len(text) and not whole:
        # record 1 is longer than the head: read on to its end
        fields, _, chars = next(islice(records(delimited.text_of(path, gzip, name, bom, size), separator, quote), 1))
        text = ""
    if len(fields) > MAX_COLUMNS:
        raise UnsupportedSchema(f"{len(fields)} columns, where {MAX_COLUMNS} are the most")
    has_header = header_of(fields, options.header)
    encoded = len(text[:chars].encode(encoding.PYTHON[name], "replace")) if text and _lossless(name) else None
    if has_header and encoded is None:
        encoded = _record_bytes(path, gzip, name, bom, size, separator, quote)
    dialect = Dialect(
        separator, quote, name, bom, has_header,
        options.separator is not None, options.quote is not None, options.encoding is not None, options.header is not None,
    )
    labels = tuple(f or None for f in fields) if has_header else (None,) * len(fields)
    return TableSpec(path, labels, dialect, (), size, None, gzip, bom + (encoded or 0 if has_header else 0))


def _lossless(name: str) -> bool:
    return name == "latin-1"


def _record_bytes(path: str, gzip: bool, name: str, bom: int, size: int, separator: str, quote: str) -> int:
    """Source bytes of record 1. Structural characters survive decoding, so it is read as bytes one to one (or in units of two)."""
    if name.startswith("utf-16"):
        fields = next(records(delimited.text_of(path, gzip, name, bom, size), separator, quote))
        # without surrogates a character is one unit; those beyond are two
        text = "".join(islice(_characters(delimited.text_of(path, gzip, name, bom, size)), fields[2]))
        return sum(4 if ord(c) > 0xFFFF else 2 for c in text)
    return next(records(delimited.text_of(path, gzip, "latin-1", bom, size), separator, quote))[2]


def _characters(pieces):
    for piece in pieces:
        yield from piece


def open_table(spark: SparkSession, path: str, options: OpenOptions = OpenOptions(), spool: str | None = None) -> Table:
    """Opens delimited text (plain or gzip, by content) or Parquet. Addresses are read in place where the server serves ranges,
    else fetched to a file in ``spool`` first."""
    remote = urlparse(path).scheme in ("http", "https")
    if remote and not http.serves_ranges(path):
        return open_table(spark, http.Fetch(path, spool).result(), options)
    try:
        mark = storage.head(path, 4)
    except ReadFailed:
        # a folder of Parquet files, or a store that only Spark reads
        try:
            return _parquet(spark, path, native=True)
        except UnsupportedSchema:
            raise
        except Exception as e:
            raise ReadFailed(f"{path} is neither a file nor a Parquet table") from e
    if mark in PARQUET_MARKS:
        if mark == b"PARE":
            raise UnsupportedSchema(f"{path} is encrypted")
        footer = parquet.footer(path)
        return _parquet(spark, path, native=not remote and not parquet.needs_fallback(footer), row_count=footer.num_rows)
    spec = probe(path, options)
    if not spec.labels:
        return Table(spark, spec, lambda: spark.createDataFrame([], "source_row long, oversized boolean"))
    part = lambda first, stop, columns: delimited.load(spark, spec, columns, rows=(first, stop))
    return Table(spark, spec, lambda: delimited.load(spark, spec), (), part)


def _parquet(spark: SparkSession, path: str, native: bool, row_count: int | None = None) -> Table:
    got = parquet.open_native(spark, path) if native else parquet.open_text(spark, path)
    rows, part = row_count if got.row_count is None else got.row_count, None
    if rows is not None:  # a single file whose row groups are known
        part = lambda first, stop, columns: parquet.load_text(spark, path, got.labels, columns, (first, stop))
    types: tuple[ColumnType, ...] = got.declared
    return Table(spark, TableSpec(path, tuple(x or None for x in got.labels), None, types, 0, rows), lambda: got.rows, got.kinds, part)
