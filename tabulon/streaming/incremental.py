"""A folder of Parquet files as a stream under the same predicates: matches are appended as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabulon.functions.render import render
from tabulon.plans import predicate
from tabulon.spec import SearchRequest


def cells(raw: DataFrame) -> DataFrame:
    """Text cells c0.. of a frame's columns, with the file and row that each comes from."""
    kinds = [(F.col(f"`{f.name}`"), f.dataType) for f in raw.schema.fields]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").cast("long").alias("file_row")]
    return raw.select(*place, *(render(c, k).alias(f"c{n}") for n, (c, k) in enumerate(kinds)))


def matching(spark: SparkSession, folder: str, schema: T.StructType, request: SearchRequest, files_per_batch: int = 16) -> DataFrame:
    """A streaming frame of the rows that match, with the matching column."""
    request = request.normalized(len(schema.fields))
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    rows = cells(raw)
    own = [F.col(f"c{k}") for k in range(len(schema.fields))]
    return rows.where(predicate.matches(request, own)).withColumn("match_column", predicate.match_column(request, own))


def counts(matches: DataFrame) -> DataFrame:
    """Running totals per file."""
    return matches.groupBy("file").agg(F.count("*").alias("matches"))


def write(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now and ends; the checkpoint makes each file count once, also after a failure."""
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
