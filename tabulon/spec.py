"""Frozen descriptions: options, dialects, column types, requests and table shapes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

from tabulon.errors import InvalidArgument

MAX_COLUMNS = 1_048_576
DISPLAY_BYTES = 4096
EXAMPLE_BYTES = 256
SENTINEL_BYTES = 256
OVERSIZED_ROW_BYTES = 1 << 20
WINDOW_ROWS = 4096
BLOCK_ROWS = 2048
PREFIX_ROWS = 4096
COPY_CELLS = 10_000_000
BATCH_COLUMNS = 1024

ENCODINGS = ("utf-8", "utf-16-le", "utf-16-be", "latin-1", "windows-1252")


def _check_byte(name: str, value: str) -> None:
    if len(value) != 1 or not 1 <= ord(value) <= 0x7F or value in "\r\n":
        raise InvalidArgument(f"{name} must be one ASCII character other than CR and LF, not {value!r}")


@dataclass(frozen=True)
class OpenOptions:
    """What is forced; ``None`` is detected. ``quote=""`` means that no quote is used."""

    separator: str | None = None
    quote: str | None = None
    encoding: str | None = None
    header: bool | None = None

    def __post_init__(self) -> None:
        if self.separator is not None:
            _check_byte("separator", self.separator)
        if self.quote:
            _check_byte("quote", self.quote)
        if self.separator is not None and self.separator == self.quote:
            raise InvalidArgument("separator and quote must differ")
        if self.encoding is not None and self.encoding not in ENCODINGS:
            raise InvalidArgument(f"encoding must be one of {', '.join(ENCODINGS)}")

    def changed(self, **forced) -> OpenOptions:
        """The same with one more parameter forced; what was forced stays, what was detected stays to be detected."""
        return replace(self, **forced)


@dataclass(frozen=True)
class Dialect:
    separator: str
    quote: str  #: empty for none
    encoding: str
    bom_bytes: int
    has_header: bool
    separator_forced: bool = False
    quote_forced: bool = False
    encoding_forced: bool = False
    header_forced: bool = False


class Kind(Enum):
    UNKNOWN = "unknown"
    UNSUPPORTED = "unsupported"
    TEXT = "text"
    BOOLEAN = "boolean"
    INTEGER = "integer"
    DECIMAL = "decimal"
    DATE = "date"
    DATETIME = "datetime"


class Zone(Enum):
    NONE = "none"
    NAIVE = "naive"
    ZONED = "zoned"


@dataclass(frozen=True)
class ColumnType:
    kind: Kind
    zone: Zone = Zone.NONE
    precision: int | None = None
    scale: int | None = None
    fraction_digits: int | None = None


UNKNOWN, TEXT = ColumnType(Kind.UNKNOWN), ColumnType(Kind.TEXT)


class Mode(Enum):
    TEXT = "text"
    EQ = "="
    NE = "!="
    LT = "<"
    GT = ">"
    LE = "<="
    GE = ">="

    @property
    def ordering(self) -> bool:
        return self in (Mode.LT, Mode.GT, Mode.LE, Mode.GE)


@dataclass(frozen=True)
class SearchRequest:
    """TEXT looks for ``value`` in the columns of ``scope`` (None: all); the other modes compare ``column``."""

    mode: Mode
    value: str
    column: int | None = None
    scope: tuple[int, ...] | None = None
    case_sensitive: bool = False

    def normalized(self, column_count: int) -> SearchRequest:
        """Validated, and equal for requests of equal meaning: a scope of all columns is none, ordering ignores case."""
        from tabulon.functions.numeric import parse

        if self.mode is Mode.TEXT:
            if not self.value:
                raise InvalidArgument("a text search needs a text")
            scope = None
            if self.scope is not None:
                if not self.scope or not all(0 <= c < column_count for c in self.scope):
                    raise InvalidArgument("a scope needs columns that exist")
                scope = tuple(sorted(set(self.scope)))
                scope = None if len(scope) == column_count else scope
            return replace(self, column=None, scope=scope)
        if self.column is None or not 0 <= self.column < column_count:
            raise InvalidArgument("a comparison needs a column that exists")
        if self.mode.ordering and parse(self.value) is None:
            raise InvalidArgument(f"{self.value!r} is not a number")
        return replace(self, scope=None, case_sensitive=self.case_sensitive and not self.mode.ordering)


@dataclass(frozen=True)
class SortSpec:
    """One key, with the column's type and null sentinel as they were when the sort was made."""

    column: int
    descending: bool = False
    type: ColumnType = UNKNOWN
    sentinel: str | None = None


@dataclass(frozen=True)
class TableSpec:
    """A table's fixed shape."""

    path: str
    labels: tuple[str | None, ...]
    dialect: Dialect | None  #: None for Parquet
    declared: tuple[ColumnType, ...] = ()
    size_bytes: int = 0
    row_count: int | None = None  #: where the source declares it
    gzip: bool = False
    data_start: int = 0  #: bytes before the first data record, in the source's own encoding
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def column_count(self) -> int:
        return len(self.labels)

    @property
    def is_parquet(self) -> bool:
        return self.dialect is None
