"""Shared plumbing of the training-data operators: shared tables, Arrow column appending, document tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.plans.numbering import new_path

#: Rows and bytes of texts of one kernel call; a batch from Spark is cut to these, so that one call's Python objects stay small.
KERNEL_ROWS, KERNEL_BYTES = 256, 8 << 20
#: Rows of an Arrow batch between the JVM and Python, unless the session sets its own number: whole documents are large rows.
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(id_col: str, modulus: int) -> Column:
    """crc32 of the decimal id, modulo ``modulus``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def hash_share(seed: str, *cols: str) -> Column:
    """A deterministic number in [0, 2**20) for a row's key."""
    return F.pmod(F.xxhash64(F.lit(seed), *(F.col(c) for c in cols)), F.lit(1 << 20))


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batch to BATCH_ROWS where it is still Spark's default of 10,000."""
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def cuts(batch: pa.RecordBatch, reads: Sequence[str]) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of a batch with at most KERNEL_ROWS rows and KERNEL_BYTES of strings; one row may be larger."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in reads:
        column = batch.column(batch.schema.get_field_index(c))
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + KERNEL_BYTES, "right"))
        n = max(1, min(KERNEL_ROWS, most - at, batch.num_rows - at))
        yield at, n
        at += n


def append_columns(
    df: DataFrame,
    reads: Sequence[str],
    make: Callable[[], Callable[..., Iterable[Sequence]]],
    fields: Sequence[tuple[str, T.DataType]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` columns of ``df`` (all by default) and ``fields`` computed from ``reads``.

    ``make()`` runs once a task and gives the kernel; the kernel takes one list per column of ``reads`` and gives one
    sequence per field; a ``close`` attribute of it is called when the task ends. An input column named like a new field (in any case) gives way to it. Memory is one Arrow batch and
    the kernel's own state.
    """
    bound_batches(df.sparkSession)
    new = {name.lower() for name, _ in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    reads = list(reads)
    extra = [c for c in dict.fromkeys(reads) if c not in keep]
    source = df.select(*(F.col(f"`{c}`") for c in [*keep, *extra]))
    schema = T.StructType([*(source.schema[c] for c in keep), *(T.StructField(n, t) for n, t in fields)])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(t) for _, t in fields]
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        try:
            for whole in batches:
                for at, n in cuts(whole, reads):
                    batch = whole.slice(at, n)
                    got = kernel(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in reads))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(batch.schema.get_field_index(c)) for c in keep),
                            *(pa.array(x, type=kind) for x, kind in zip(got, kinds, strict=True)),
                        ],
                        names=[*keep, *names],
                    )
        finally:
            getattr(kernel, "close", bool)()

    return source.mapInArrow(run, schema)
