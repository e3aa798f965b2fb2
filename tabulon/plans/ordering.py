"""Sort keys of one column: three groups, a typed key, then raw text and source row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.classify import conforms, order_key
from tabulon.functions.text import fold
from tabulon.spec import Kind, SortSpec


def group(c: Column, spec: SortSpec) -> Column:
    """0: conforms to the type; 1: doesn't; 2: null by the sentinel."""
    own = F.when(conforms(c, spec.type), 0).otherwise(1)
    return own if spec.sentinel is None else F.when(c == F.lit(spec.sentinel), 2).otherwise(own)


def keys(c: Column, spec: SortSpec) -> list[tuple[str, Column]]:
    """Named key columns, ascending, without the source row that comes last."""
    grp = group(c, spec)
    text_like = spec.type.kind in (Kind.TEXT, Kind.UNKNOWN, Kind.UNSUPPORTED)
    typed = order_key(c, spec.type)
    key = F.when(grp == 2, F.lit("")).when(grp == 0, typed).otherwise(fold(c))
    # typed keys tie by source row; texts first by their raw bytes
    raw = F.when((grp == 1) | (grp == 0) & F.lit(text_like), c).otherwise(F.lit(""))
    return [("k_group", grp), ("k_key", key), ("k_raw", raw)]


def typed_keys(c: Column, typed: Column, kind: T.DataType, spec: SortSpec) -> list[tuple[str, Column]] | None:
    """The same order from the source's own numbers, where a null, NaN or infinity (whose text is no number) goes to the group
    that doesn't conform; None where the text has to be used. Negative zero equals zero in both."""
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if not (whole and spec.type.kind in (Kind.INTEGER, Kind.DECIMAL) or isinstance(kind, T.DoubleType) and spec.type.kind is Kind.DECIMAL) or spec.sentinel not in (None, ""):
        return None
    odd = typed.isNull() if whole else typed.isNull() | F.isnan(typed) | (F.abs(typed) == F.lit(float("inf")))
    grp = F.when(typed.isNull() & F.lit(spec.sentinel == ""), 2).when(odd, 1).otherwise(0)
    number = F.when(grp == 0, typed if whole else typed + F.lit(0.0))
    return [("k_group", grp), ("k_key", number), ("k_raw", F.when(grp == 1, c).otherwise(F.lit("")))]
