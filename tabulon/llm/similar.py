"""Similar texts by their sets of word shingles: MinHash bands retrieve pairs, exact Jaccard similarity verifies them.

A-Z lower-cased, words between white space, distinct shingles of ``SHINGLE`` words (a shorter text is one shingle). A MinHash
signature is cut into ``BANDS`` bands of ``ROWS`` values and an equal band makes two rows meet; a pair of similarity s never
meets with chance (1 - s ** ROWS) ** BANDS, at s = ``LEAST`` 1.2 in a million and less above. Rows are named by (null id last,
id, hash of the text).

Each round compares the rows of a band with its least row (with its ``PIVOTS`` least after ``ROUNDS`` rounds); those that are
similar go, and the least have met all others of their band and leave it. The first round looks at ``FIRST`` bands only, which
is where most of a large group of copies goes. Rounds end when no band has two rows. Within the join sets whose sizes differ by
more than a similarity of LEAST allows are passed over, and so are rows that agree in fewer than ``AGREE`` of ``SKETCH`` MinHash
values of a byte each: at similarity LEAST 102 agree, 4.5 more or less, so that happens with chance 3 in ten million there, and
nearly always below 0.5. So groups of texts that are alike but not similar cost no texts read. No two rows that stay meet and
are similar, and a row that goes is linked over similar rows to a smaller one that stays.

Null, empty and blank texts are similar to nothing.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import append_columns, bound_batches, written

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 45, 6
FIRST, ROUNDS, PIVOTS = 4, 3, 256
SKETCH, AGREE = 128, 80
_RNG = np.random.default_rng(5)
FLIP, TIMES, MIX = (_RNG.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, BANDS * ROWS))


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes, ascending."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    parts = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SHINGLE)), np.uint64, n))


def band_keys(text: str | None) -> tuple[list[int], int, list[int]]:
    """The bands' keys, the number of distinct shingles, and the sketch, eight bytes a number."""
    hashes = shingles(text)
    if not len(hashes):
        return [], 0, []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 128):
        np.minimum(least, ((hashes[at : at + 128, None] ^ FLIP) * TIMES).min(axis=0), out=least)
    mixed = least * MIX
    sketch = (mixed[:SKETCH] >> np.uint64(56)).astype(np.uint8).view(np.int64)
    return mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64).tolist(), len(hashes), sketch.tolist()


def agreeing(a: Column, b: Column) -> Column:
    """How many bytes two sketches share: the bits of each byte of the difference are gathered in its lowest."""
    total = F.lit(SKETCH)
    for k in range(SKETCH // 8):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for n in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def row_of(id_col: str, text_col: str) -> Column:
    """A row's name, without nulls inside; its order is that of the ids."""
    i = F.col(f"`{id_col}`")
    return F.struct(i.isNull().alias("missing"), F.coalesce(i, F.lit(0)).cast("long").alias("id"), F.xxhash64(F.lit("row"), F.col(f"`{text_col}`")).alias("hash"))


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (row, other) those whose texts are similar."""
    one, two = texts, texts.select(F.col("row").alias("other"), F.col("text").alias("text2"))
    met = pairs.join(one, "row").join(two, "other").select("row", "other", "text", "text2")

    def run(batches):
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            held, keep = {}, []
            for x, y in zip(a, b, strict=True):
                for t in (x, y):
                    if t not in held:
                        held[t] = shingles(t)
                keep.append(jaccard(held[x], held[y]) >= LEAST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["row", "other"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, pairs.select("row", "other").schema)


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are similar to a smaller one."""
    bound_batches(docs.sparkSession)
    texts = docs.select(row_of(id_col, text_col).alias("row"), F.col(f"`{text_col}`").alias("text"))
    fields = [("keys", T.ArrayType(T.LongType())), ("size", T.IntegerType()), ("sketch", T.ArrayType(T.LongType()))]
    keyed = written(append_columns(texts, ["text"], lambda: lambda ts: list(zip(*map(band_keys, ts), strict=True)) or ([], [], []), fields, keep=["row"]), "keyed")
    bands = written(keyed.select("row", F.posexplode("keys").alias("band", "key")).distinct(), "bands")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    bands = bands.join(shared, "key").join(keyed.select("row", "size", "sketch").dropDuplicates(["row"]), "row")
    bands = written(bands.select("key", "band", "row", "size", "sketch"), "bands")
    held = written(texts.join(bands.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"]), "similar-texts")
    gone, met, n = [], [], 0
    while not bands.isEmpty():
        here = bands.where(F.col("band") < FIRST) if n == 0 else bands
        least = here.groupBy("key").agg(F.min(F.struct("row", "size", "sketch")).alias("x"), F.count("*").alias("n")).where("n > 1")
        least = least.select("key", F.col("x.row").alias("other"), F.col("x.size").alias("other_size"), F.col("x.sketch").alias("other_sketch"))
        if n >= ROUNDS:
            place = F.row_number().over(Window.partitionBy("key").orderBy("row"))
            least = bands.withColumn("place", place).where(F.col("place") <= PIVOTS).select("key", F.col("row").alias("other"), F.col("size").alias("other_size"), F.col("sketch").alias("other_sketch")).join(least.select("key"), "key", "left_semi")
        least = written(least, "least")
        alike = F.least("size", "other_size") >= LEAST * F.greatest("size", "other_size")
        alike = alike & (agreeing(F.col("sketch"), F.col("other_sketch")) >= AGREE)
        pairs = here.join(least, "key").where((F.col("row") > F.col("other")) & alike).select("row", "other").distinct()
        for before in met:
            pairs = pairs.join(before, ["row", "other"], "left_anti")
        met.append(written(pairs, "met"))
        gone.append(written(_similar(met[-1], held), "similar"))
        if n:  # bands without two rows are done
            bands = bands.join(least.select("key").distinct(), "key", "left_semi")
        bands = bands.join(least.select("key", F.col("other").alias("row")), ["key", "row"], "left_anti")
        bands = written(bands.join(gone[-1].select("row").distinct(), "row", "left_anti").select("key", "band", "row", "size", "sketch"), "bands")
        n += 1
    name = row_of(id_col, text_col)
    for found in gone:
        docs = docs.withColumn("_similar_row", name).join(found.select(F.col("row").alias("_similar_row")).distinct(), "_similar_row", "left_anti").drop("_similar_row")
    return docs
