"""Gapless row numbers over distributed data, without sorting everything in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.errors import InvalidArgument

#: Rows of a block of source rows that is numbered by one task; blocks grow where there would be more than MOST of them.
BLOCK = 1 << 16
MOST = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder of ``setCheckpointDir``. A temporary folder only where neither is set and all
    executors run on this machine."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tabulon_folder", None)
    if not where:
        found = context._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not context.master.startswith("local"):
            raise InvalidArgument("spark.checkpoint.dir must name a folder that driver and executors share")
        where = context._tabulon_folder = "file://" + tempfile.mkdtemp(prefix="tabulon-")
    return where.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, remembered for ``clear``."""
    context = spark.sparkContext
    if not hasattr(context, "_tabulon_paths"):
        context._tabulon_paths = []
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    context._tabulon_paths.append(path)
    return path


def clear(spark: SparkSession, keep: str | None = None) -> None:
    """Deletes what this session has written to the shared folder, but for ``keep``. Frames that read it end with it, so it is
    for the caller to say when."""
    context = spark.sparkContext
    paths, conf = getattr(context, "_tabulon_paths", []), context._jsc.hadoopConfiguration()
    context._tabulon_paths = [p for p in paths if p == keep]
    for p in paths:
        if p != keep:
            path = context._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def by_position(df: DataFrame, position: str, name: str, rows: int | None = None) -> DataFrame:
    """``name``: the rank from 0 by a unique long ``position``.

    Positions fall into blocks; a rank is the count of the blocks before plus the rank within the block. The counts are one
    small row a block, so the running sum over them is cheap, and a block's rows are a bounded part of the table.
    """
    size = BLOCK if rows is None else max(BLOCK, -(-rows // MOST))
    block = F.floor(F.col(position) / size).cast("long")
    marked = df.withColumn("block_", block)
    before = Window.partitionBy(F.lit(0)).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("block_").agg(F.count("*").alias("n_")).select("block_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    within = Window.partitionBy("block_").orderBy(position)
    ranked = marked.withColumn("at_", F.row_number().over(within) - 1)
    # at most MOST rows, so this side may be broadcast
    joined = ranked.join(F.broadcast(starts) if rows is not None else starts, "block_")
    return joined.withColumn(name, (F.col("start_") + F.col("at_")).cast("long")).drop("block_", "at_", "start_")


def by_order(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``name``: the rank from 0 by ``keys`` (a total order).

    The rows are range-partitioned and sorted once, and written: each file is one range in order. A rank is the rows of the
    files before plus the row's place in its file, so reading needs neither a sort nor the same range bounds again.
    """
    spark = df.sparkSession
    path = new_path(spark, "order")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", 0).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file_"), F.col("_metadata.row_index").alias("at_"))
    # one row a range partition; part files are named by partition
    sizes = sorted((r[0], r[1]) for r in kept.groupBy("file_").count().collect())
    starts, total = [], 0
    for file, n in sizes:
        starts.append((file, total))
        total += n
    table = spark.createDataFrame(starts, "file_ string, start_ long")
    return kept.join(F.broadcast(table), "file_").withColumn(name, (F.col("start_") + F.col("at_")).cast("long")).drop("file_", "at_", "start_")
