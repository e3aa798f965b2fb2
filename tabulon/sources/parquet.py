"""Parquet tables: by Spark's own reader where it can, else row group by row group through Arrow; and footer facts."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulon.errors import UnsupportedSchema
from tabulon.functions.render import declared, render
from tabulon.sources import storage
from tabulon.spec import TEXT, ColumnType, Kind, Zone

NAME = "tabulon_parquet_text"
CODECS = ("UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW")
LABEL_BYTES = 127
MOST_PRECISION = 76
#: A table of the files' first rows is broadcast up to here.
FEW_FILES = 100_000


@dataclass(frozen=True)
class FileInfo:
    bytes: int
    rows: int
    row_groups: int
    columns: int
    version: str
    codecs: tuple[str, ...]
    codec_mask: int
    created_by: str


@dataclass(frozen=True)
class ColumnInfo:
    column: int
    label: str
    physical: str
    logical: str
    nullable: bool


@dataclass(frozen=True)
class RowGroupInfo:
    group: int
    first_row: int
    rows: int
    compressed: int
    uncompressed: int


def footer(path: str) -> pq.FileMetaData:
    with storage.opened(path) as f:
        try:
            return pq.ParquetFile(f).metadata
        except (pa.ArrowInvalid, OSError) as e:
            raise UnsupportedSchema(f"{path}: {e}") from e


def codecs_of(m: pq.FileMetaData) -> tuple[str, ...]:
    found = {m.row_group(g).column(c).compression for g in range(m.num_row_groups) for c in range(m.num_columns)}
    return tuple(sorted(found, key=lambda c: CODECS.index(c) if c in CODECS else len(CODECS)))


def file_info(path: str) -> FileInfo:
    m = footer(path)
    codecs = codecs_of(m)
    mask = sum(1 << CODECS.index(c) for c in codecs if c in CODECS)
    return FileInfo(storage.size(path), m.num_rows, m.num_row_groups, m.num_columns, m.format_version, codecs, mask, m.created_by or "")


def column_info(path: str) -> list[ColumnInfo]:
    m = footer(path)
    out = []
    for k in range(m.num_columns):
        c = m.schema.column(k)
        logical = str(c.logical_type) if c.logical_type.type != "NONE" else c.converted_type if c.converted_type != "NONE" else ""
        out.append(ColumnInfo(k, c.name, c.physical_type, logical.encode()[:LABEL_BYTES].decode("utf-8", "ignore"), c.max_definition_level > 0))
    return out


def row_groups(path: str) -> list[RowGroupInfo]:
    m, first, out = footer(path), 0, []
    for g in range(m.num_row_groups):
        r = m.row_group(g)
        columns = [r.column(c) for c in range(r.num_columns)]
        out.append(RowGroupInfo(g, first, r.num_rows, sum(c.total_compressed_size for c in columns), sum(c.total_uncompressed_size for c in columns)))
        first += r.num_rows
    return out


def arrow_type(kind: pa.DataType, label: str) -> ColumnType:
    """The declared column type; raises for what can't be explored."""
    t = pa.types
    if t.is_boolean(kind):
        return ColumnType(Kind.BOOLEAN)
    if t.is_integer(kind):
        return ColumnType(Kind.INTEGER)
    if t.is_floating(kind):
        return ColumnType(Kind.DECIMAL)
    if t.is_decimal(kind) and kind.precision <= MOST_PRECISION:
        return ColumnType(Kind.DECIMAL, precision=kind.precision, scale=kind.scale)
    if t.is_date(kind):
        return ColumnType(Kind.DATE)
    if t.is_timestamp(kind):
        return ColumnType(Kind.DATETIME, Zone.ZONED if kind.tz else Zone.NAIVE, fraction_digits={"s": 0, "ms": 3, "us": 6, "ns": 9}[kind.unit])
    if t.is_time(kind) or t.is_string(kind) or t.is_large_string(kind) or t.is_binary(kind) or t.is_large_binary(kind) or t.is_fixed_size_binary(kind) or t.is_null(kind):
        return TEXT
    if isinstance(kind, pa.BaseExtensionType):
        return arrow_type(kind.storage_type, label)
    raise UnsupportedSchema(f"column {label!r} of type {kind} can't be explored")


def needs_fallback(m: pq.FileMetaData) -> bool:
    """Whether Spark's reader can't read the file as it is: some codecs, times, nanoseconds, wide decimals, UUIDs, labels that
    differ in case alone or not at all."""
    labels = [m.schema.column(k).name.lower() for k in range(m.num_columns)]
    if len(set(labels)) < len(labels) or "BROTLI" in codecs_of(m):
        return True
    for k in range(m.num_columns):
        c = m.schema.column(k)
        if c.physical_type == "INT96":  # moments without a zone, to the nanosecond
            return True
        logical = json.loads(c.logical_type.to_json())
        if logical.get("Type") in ("Time", "UUID", "Float16") or logical.get("timeUnit") == "nanoseconds" or logical.get("precision", 0) > 38:
            return True
    return False


@dataclass(frozen=True)
class Opened:
    rows: DataFrame  #: source_row, c0.. (text) and, by Spark's reader, v0.. (values)
    labels: tuple[str, ...]
    declared: tuple[ColumnType, ...]
    kinds: tuple[T.DataType, ...]  #: empty where only text is at hand
    row_count: int | None


def open_native(spark: SparkSession, path: str) -> Opened:
    raw = spark.read.parquet(path)
    types = tuple(declared(f.dataType) for f in raw.schema.fields)
    kinds = tuple(f.dataType for f in raw.schema.fields)
    values = [F.col(f"`{f.name}`") for f in raw.schema.fields]
    files = raw.inputFiles()
    index = F.col("_metadata.row_index").cast("long")
    cells = [*(render(v, k).alias(f"c{n}") for n, (v, k) in enumerate(zip(values, kinds, strict=True))), *(v.alias(f"v{n}") for n, v in enumerate(values))]
    if len(files) <= 1:
        rows = raw.select(index.alias("source_row"), *cells)
    else:
        # row numbers restart in each file; one row a file tells where it begins, files in order of their whole paths, as base
        # names repeat over the folders of a partitioned table
        before = Window.partitionBy(F.lit(0)).orderBy("file_").rowsBetween(Window.unboundedPreceding, -1)
        sizes = raw.groupBy(F.col("_metadata.file_path").alias("file_")).agg(F.count("*").alias("n_"))
        starts = sizes.select("file_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
        rows = raw.select(F.col("_metadata.file_path").alias("file_"), index.alias("at_"), *cells)
        rows = rows.join(F.broadcast(starts) if len(files) <= FEW_FILES else starts, "file_")
        rows = rows.withColumn("source_row", F.col("start_") + F.col("at_")).drop("file_", "at_", "start_")
    return Opened(rows, tuple(f.name for f in raw.schema.fields), types, kinds, None)


def open_text(spark: SparkSession, path: str) -> Opened:
    with storage.opened(path) as f:
        file = pq.ParquetFile(f)
        schema, m = file.schema_arrow, file.metadata
        types = tuple(arrow_type(c.type, c.name) for c in schema)
        labels = tuple(schema.names)
        if m.num_columns != len(labels):
            raise UnsupportedSchema(f"{path} has nested columns")
    return Opened(load_text(spark, path, labels), labels, types, (), m.num_rows)


def load_text(spark: SparkSession, path: str, labels: tuple[str | None, ...], columns: list[int] | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """source_row and text cells of the wanted columns, by row groups; with ``rows`` (first, stop), of the groups that hold
    some of these rows, and of these rows alone."""
    columns = list(range(len(labels))) if columns is None else columns
    groups = [(g.group, g.first_row, g.rows) for g in row_groups(path)]
    if rows is not None:
        groups = [g for g in groups if g[1] < rows[1] and g[1] + g[2] > rows[0]]
    # columns are named to the reader, so repeated labels are read whole
    unique = len(set(labels)) == len(labels) and None not in labels
    plan = {"path": path, "groups": [g[:2] for g in groups], "columns": columns, "labels": [labels[k] for k in columns] if unique else None, "rows": rows}
    spark.dataSource.register(ParquetTextSource)
    return spark.read.format(NAME).option("plan", json.dumps(plan)).load()


class Group(InputPartition):
    def __init__(self, group: int, first_row: int) -> None:
        self.group, self.first_row = group, first_row


class ParquetTextSource(DataSource):
    """One partition a row group; columns by position, rendered as text. Option ``plan``: path, groups, columns and rows."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(["source_row long", *(f"c{k} string" for k in json.loads(self.options["plan"])["columns"])])

    def reader(self, schema) -> ParquetTextReader:
        return ParquetTextReader(json.loads(self.options["plan"]))


class ParquetTextReader(DataSourceReader):
    def __init__(self, plan: dict) -> None:
        self.plan = plan

    def partitions(self) -> list[Group]:
        return [Group(*g) for g in self.plan["groups"]]

    def read(self, group: Group) -> Iterator[pa.RecordBatch]:
        if group is None:  # no row group was asked for
            return
        p, row = self.plan, group.first_row
        low, high = p["rows"] or (0, 1 << 62)
        names = ["source_row", *(f"c{k}" for k in p["columns"])]
        with storage.opened(p["path"]) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=4096, row_groups=[group.group], columns=p["labels"]):
                first, row = row, row + batch.num_rows
                a, b = max(low, first), min(high, row)
                if a >= b:
                    if first >= high:
                        break
                    continue
                part = batch.slice(a - first, b - a)
                columns = [part.column(part.schema.get_field_index(x)) for x in p["labels"]] if p["labels"] else [part.column(k) for k in p["columns"]]
                cells = [pa.array([cell_text(v) for v in values(c)], pa.string()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), *cells], names=names)


def values(column: pa.Array) -> list:
    """Python values; nanosecond stamps and times as (kind, count, zoned), as Python's own types end at microseconds."""
    kind = column.type
    if isinstance(kind, pa.BaseExtensionType):
        return [None if v is None else v.bytes if hasattr(v, "bytes") else v for v in column.to_pylist()] if "uuid" not in str(kind) else [None if v is None else ("uuid", v) for v in column.to_pylist()]
    if pa.types.is_timestamp(kind) or pa.types.is_time(kind):
        per = {"s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}[kind.unit]
        wide = pa.int32() if pa.types.is_time32(kind) else pa.int64()
        zoned = pa.types.is_timestamp(kind) and kind.tz is not None
        name = "stamp" if pa.types.is_timestamp(kind) else "time"
        return [None if v is None else (name, v * per, zoned) for v in column.cast(wide).to_pylist()]
    if pa.types.is_float32(kind):
        import numpy as np

        return [None if v is None else np.float32(v) for v in column.to_pylist()]
    return column.to_pylist()


def _clock(nanos: int) -> str:
    seconds, rest = divmod(nanos, 10**9)
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{rest:09d}"


def cell_text(v) -> str:
    """A value's text; null is the empty string."""
    match v:
        case None:
            return ""
        case bool():
            return "true" if v else "false"
        case ("stamp", n, zoned):
            day, rest = divmod(n, 86_400 * 10**9)
            return f"{(datetime(1970, 1, 1) + timedelta(days=day)).date().isoformat()}T{_clock(rest)}{'Z' if zoned else ''}"
        case ("time", n, _):
            return _clock(n)
        case ("uuid", u):
            return str(u)
        case Decimal():
            return f"{v:f}"
        case str():
            return v
        case bytes():
            return v.decode("utf-8", "replace")
        case datetime() | date() | time():
            return v.isoformat()
        case int():
            return str(v)
    text = repr(v.item() if hasattr(v, "item") and not hasattr(v, "dtype") else float(str(v)))
    if text in ("nan", "inf", "-inf"):
        return text
    plain = f"{Decimal(text):f}"
    return plain.rstrip("0").rstrip(".") if "." in plain else plain
