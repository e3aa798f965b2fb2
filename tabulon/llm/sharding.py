"""Sharding by longest-processing-time scheduling of groups that must stay together.

Rows with equal texts are a group; a group's load is its rows' bytes. Groups in order of their load, largest first, go to the
least loaded shard through a heap. Groups of at least 1 / ``HEAVY`` of one shard's fair load are scheduled one by one by their
exact loads: there can be no more than shards x HEAVY of them. The lighter ones are counted by size class: loads up to
2 ** ``EXACT`` are classes of their own, larger ones are kept to ``EXACT`` leading bits (0.2 %). A class's groups are equal to
the heap, which hands the whole class out by how many groups each shard takes; a class's groups, numbered, find their shard by
that. So all groups are scheduled in size order, at any input size and by the same rule, while the
driver holds at most shards x HEAVY loads and 2 ** EXACT x 28 classes. A shard ends within one group of the others.

Numbers (of a class's groups, of a shard's rows) come from buckets: rows are numbered within a bucket and moved up by the counts
of the buckets before.

Defined cases: null texts form one group of their own (size 8 a row, crc32 null), empty texts another (crc32 0); repeated rows
keep a slot each; an empty table gives an empty result; other columns of the input are left alone and not returned.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import written

HEAVY = 1024
EXACT = 9
BUCKET_ROWS = 20_000
OVERHEAD = 8


def size_class(load: int) -> int:
    """The load itself, or with all bits but the leading ones cleared."""
    return load >> (drop := max(0, load.bit_length() - EXACT)) << drop


def _class_of(load: Column) -> Column:
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(load)) - EXACT, F.lit(0))).cast("long")
    return load - load % unit


def schedule(heavy: list[tuple[int, str]], classes: dict[int, tuple[int, int]], shards: int) -> tuple[dict[str, int], dict[int, list[int]]]:
    """Longest first to the least loaded shard (ties: the smaller number). ``heavy``: loads and names; ``classes``: of each class
    its number of groups and their sum of loads. Gives each name's shard, and of each class how many groups a shard takes."""
    loads, names, taken = [0.0] * shards, {}, {}
    order = [(-load, 0, name) for load, name in heavy] + [(-c, 1, c) for c in classes]
    for load, kind, key in sorted(order, key=lambda x: (x[0], x[1], x[2])):
        if kind == 0:
            s = min(range(shards), key=lambda k: (loads[k], k))
            names[key], loads[s] = s, loads[s] - load
            continue
        n, total = classes[key]
        each = total / n
        taken[key] = spread(loads, n, each)
        loads = [x + each * k for x, k in zip(loads, taken[key], strict=True)]
    return names, taken


def spread(loads: list[float], n: int, each: float) -> list[int]:
    """How many of ``n`` equal groups each shard gets when one after another goes to the least loaded."""
    low, high, base = min(loads), max(loads) + each * (n / len(loads) + 1), np.array(loads)
    count = lambda level: np.maximum(0, np.floor((level - base) / each)).astype(np.int64)
    if n > len(loads):
        # a level that all shards may be filled to without using up the groups; the heap does the rest
        for _ in range(50):
            middle = (low + high) / 2
            if count(middle).sum() <= n - len(loads):
                low = middle
            else:
                high = middle
        out = count(low)
    else:
        out = np.zeros(len(loads), np.int64)
    heap = [(x + each * int(k), s) for s, (x, k) in enumerate(zip(loads, out, strict=True))]
    heapq.heapify(heap)
    for _ in range(n - int(out.sum())):
        load, s = heap[0]
        out[s] += 1
        heapq.heapreplace(heap, (load + each, s))
    return out.tolist()


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: gapless numbers from 0 within ``group``, by buckets in order (``bucket`` column) and ``order`` within them."""
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*group, "bucket").agg(F.count("*").alias("n")).select(*group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(*group, "bucket").orderBy(*order)
    return rows.withColumn("at", F.row_number().over(within) - 1).join(starts, [*group, "bucket"]).withColumn(name, (F.col("start") + F.col("at")).cast("long")).drop("at", "start", "bucket")


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: ``id_col``, ``size``, ``text_crc32``, ``shard`` and ``slot``."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    rows = written(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.coalesce(F.substring(F.sha2(text, 256), 1, 32), F.lit("null")).alias("digest"),
            # spreads rows that agree in id and text, as they may be many
            (F.monotonically_increasing_id() % 1024).alias("salt"),
        ),
        "sized",
    )
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("load"), F.count("*").alias("copies")).withColumn("class", _class_of(F.col("load"))), "groups")
    total, n_rows, n_groups = groups.agg(F.coalesce(F.sum("load"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    heavy = F.col("load") * (shards * HEAVY) >= total
    alone = [(r["load"], r["digest"]) for r in groups.where(heavy).select("load", "digest").collect()]
    classes = {r["class"]: (r["n"], r["load"]) for r in groups.where(~heavy).groupBy("class").agg(F.count("*").alias("n"), F.sum("load").alias("load")).collect()}
    names, taken = schedule(alone, classes, shards)
    # both tables have a fixed bound, so they are broadcast
    by_group = spark.createDataFrame(list(names.items()) or [("", 0)], "digest string, own int")
    ends = [(c, np.cumsum(n).tolist()) for c, n in taken.items()]
    by_class = spark.createDataFrame(ends or [(0, [0])], "class long, ends array<long>")
    light = groups.where(~heavy).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(max(1, -(-n_groups // BUCKET_ROWS)))))
    light = numbered(light.select("digest", "class", "bucket"), ["class"], ["digest"], "number").join(F.broadcast(by_class), "class")
    light = light.select(F.col("digest"), F.size(F.filter("ends", lambda x: x <= F.col("number"))).alias("own"))
    # a heavy group may hold a third of all rows: its rows meet a broadcast; the rows of light ones are dealt by their digest
    many = F.broadcast(by_group)
    found = rows.join(many, "digest").unionByName(rows.join(many.select("digest"), "digest", "left_anti").join(light, "digest"))
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    found = found.select("id", "size", "text_crc32", "digest", "salt", F.col("own").alias("shard"))
    dealt = written(found.withColumn("bucket", F.pmod(F.xxhash64("id", "digest", "salt"), F.lit(buckets))), "dealt")
    got = numbered(dealt, ["shard"], ["id", "digest"], "slot")
    return got.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
