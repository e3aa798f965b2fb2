"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius by vantage-point trees.

*Fingerprints.* A-Z lower-cased, words between white space, shingles of ``SHINGLE`` words with repeats, XXH64 with seed 42;
a bit is set if over half the hashes have it.

*Links.* The 64 bits are cut into ``BLOCKS`` halves: two fingerprints within ``RADIUS`` bits are within RADIUS // BLOCKS bits
in one of them, and Hamming distance within a half is a metric of its own. For each half a vantage-point tree, fitted on a
bounded sample of the distinct fingerprints, deals all of them into shards: a node compares the distance to its vantage with
the median, and by the triangle bound a fingerprint nearer than the radius to that median ball's boundary is also sent,
as a visitor, to the other side. Every pair within the radius therefore meets in a shard that is home to one of the two.
Shards of over ``MOST`` fingerprints are split again by trees of their own, fitted on a sample of each: by the same half, or by
the whole fingerprint where the half doesn't tell them apart. What no tree splits lies within a few bits, a ball of which
holds a limited number of distinct fingerprints whatever the number of rows (43,745 within 3 bits of one).
Inside a shard an exact search compares full fingerprints and keeps one link to a local root for each fingerprint reached, so
the links grow with the fingerprints and not with the pairs.

*Components.* Links are contracted by alternating large and small stars over tables in the shared folder until nothing
changes; equal fingerprints are one node, named by the smallest id that carries it.

Defined cases: null, empty and blank texts have fingerprint zero, which is linked like any other; ids may repeat (each row
keeps its own fingerprint and the component of that fingerprint); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import append_columns, hash_share, written

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS = 2
#: Distinct fingerprints that a shard is home to, on average, and the most that are sampled to fit the trees.
HOME = 1500
SAMPLE = 1 << 16
#: Fingerprints of a shard, visitors included, beyond which it is split again, and the shards that one round splits at most.
MOST = 24_000
SPLITS = 1024
#: Fingerprint comparisons held at once by a shard's search.
CELLS = 1 << 18
#: The most of a node's fingerprints that a split may send to both sides; a worse split isn't made.
CROSSING = 0.45
#: The largest part of a shard that is split again, as a share of its rows.
SMALLER = 0.7
FIELDS = (("fingerprint_bits", T.LongType()),)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    total, set_bits = len(words) - shingle + 1, np.zeros(64, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, total)
    for at in range(0, total, 1 << 15):
        part = hashes[at : at + (1 << 15)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > total, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text_col: str = "text", keep=None, shingle: int = SHINGLE) -> DataFrame:
    """``fingerprint_bits`` of every whole text, as a signed long."""

    def make():
        return lambda texts: ([signed(fingerprint(t, shingle)) for t in texts],)

    return append_columns(docs, [text_col], make, FIELDS, keep)


class VantageTree:
    """Splits one half of the fingerprints. Leaves are shards."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        """sample: distinct values, in an order that doesn't depend on them."""
        self.depth = depth
        self.vantage = np.zeros((1 << depth) - 1, sample.dtype)
        self.median = np.full((1 << depth) - 1, 99, np.int16)  # an unsplit node: all inside, nothing sent out
        groups = {0: sample}
        for node in range(len(self.vantage)):
            mine = groups.pop(node, sample[:0])
            if len(mine) < 2:
                continue
            # of some candidates, the one whose boundary the fewest are near
            best = None
            for v in mine[:8]:
                d = np.bitwise_count(mine ^ v).astype(np.int16)
                for m in {int(np.median(d)), int(np.median(d)) - 1}:
                    near, inside = np.mean((d >= m) & (d <= m + 1)), np.mean(d <= m)
                    if near <= CROSSING and 0.1 < inside < 0.9 and (best is None or near + abs(inside - 0.5) < best[0]):
                        best = (near + abs(inside - 0.5), v, m, d)
            if best is None:
                groups[2 * node + 1] = mine
                continue
            _, self.vantage[node], self.median[node], d = best
            groups[2 * node + 1], groups[2 * node + 2] = mine[d <= self.median[node]], mine[d > self.median[node]]

    @property
    def splits(self) -> bool:
        return bool((self.median < 99).any())

    def shards(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number, shard, and whether it is the row's home, for every shard that each row is sent to."""
        row, node, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
        for _ in range(self.depth):
            d, m = np.bitwise_count(values[row] ^ self.vantage[node]).astype(np.int16), self.median[node]
            inside = d <= m
            also = np.where(inside, d + radius > m, d - radius <= m)
            here = 2 * node + np.where(inside, 1, 2)
            there = (2 * node + np.where(inside, 2, 1))[also]
            row, node, home = np.concatenate([row, row[also]]), np.concatenate([here, there]), np.concatenate([home, np.zeros(len(there), bool)])
        return row, node - ((1 << self.depth) - 1), home


def half(values: np.ndarray, block: int) -> np.ndarray:
    return ((values >> np.uint64(32 * block)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def local_links(values: np.ndarray, home: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect every pair of a home row and another row within the radius.

    Rows are sorted by the distance to one vantage of the shard; by the triangle bound a row is compared only with those whose
    distance differs by the radius at most.
    """
    d = np.bitwise_count(values ^ values[0]).astype(np.int16)
    order = np.argsort(d, kind="stable")
    values, home, nodes, d = values[order], home[order], nodes[order], d[order]
    n = len(values)
    parent = label = np.arange(n)
    for distance in np.unique(d[home]):
        ask = np.flatnonzero(home & (d == distance))
        low, high = np.searchsorted(d, [distance - radius, distance + radius + 1])
        step = max(1, CELLS // (high - low))
        for k in range(0, len(ask), step):
            part = ask[k : k + step]
            i, j = np.nonzero(np.bitwise_count(values[part][:, None] ^ values[low:high][None, :]) <= radius)
            x, y = label[part[i]], label[low + j]
            apart = x != y
            if not apart.any():
                continue
            for pair in np.unique(np.minimum(x, y)[apart] * n + np.maximum(x, y)[apart]):
                x, y = divmod(int(pair), n)
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            label = parent.copy()
    linked = np.flatnonzero(np.bincount(label, minlength=n)[label] > 1)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label[linked], nodes[linked])
    roots = least[label[linked]]
    keep = nodes[linked] != roots
    return nodes[linked][keep], roots[keep]


DEALT = T.StructType([T.StructField("shard", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("node", T.LongType()), T.StructField("home", T.BooleanType())])


def deal(nodes: DataFrame, radius: int) -> DataFrame:
    """(shard, fp, node, home) by one tree a half; a shard's number modulo BLOCKS is its half."""
    total = nodes.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / HOME)))
    share = min(1.0, SAMPLE / max(1, total))
    sample = nodes.where(hash_share("vantage", "fp") < share * (1 << 20)).select("fp").orderBy(F.xxhash64("fp"), "fp").limit(2 * SAMPLE).toArrow().column(0).to_numpy().view(np.uint64)
    # a leaf keeps about 8 of the sample at least; what is too large then is split again
    depth = min(depth, max(0, int(math.log2(max(1, len(sample)) / 8))))
    trees = nodes.sparkSession.sparkContext.broadcast([VantageTree(half(sample, b), depth) for b in range(BLOCKS)])

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 20_000):
                batch = whole.slice(low, 20_000)
                fp, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
                for b, tree in enumerate(trees.value):
                    row, shard, home = tree.shards(half(fp.view(np.uint64), b), radius // BLOCKS)
                    yield pa.RecordBatch.from_arrays([pa.array(shard * BLOCKS + b), pa.array(fp[row]), pa.array(node[row]), pa.array(home)], names=DEALT.names)

    return nodes.select("fp", "node").mapInArrow(run, DEALT)


def split_again(dealt: DataFrame, radius: int) -> DataFrame:
    """Splits shards of over MOST rows by trees of their own, round by round, until none is left that a tree can split."""
    spark, final, following = dealt.sparkSession, set(), 1 << 40
    while True:
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > MOST).orderBy(F.desc("n"), "shard").limit(SPLITS + len(final)).collect()
        large = {r["shard"]: r["n"] for r in sizes if r["shard"] not in final}
        if not large:
            return dealt
        named = F.broadcast(spark.createDataFrame([(k,) for k in large], "shard long"))
        share = min(1.0, SAMPLE / sum(large.values()))
        rows = dealt.join(named, "shard").where(hash_share("again", "shard", "fp") < share * (1 << 20)).select("shard", "fp").orderBy(F.xxhash64("shard", "fp")).limit(2 * SAMPLE)
        got = rows.toArrow()
        shards, prints = got.column(0).to_numpy(), got.column(1).to_numpy().view(np.uint64)
        trees: dict[int, tuple[VantageTree, int, int, int]] = {}  # shard: tree, block (BLOCKS: whole), radius, first new number
        for k, n in large.items():
            mine, block = prints[shards == k], k % BLOCKS
            depth = max(1, min(math.ceil(math.log2(n / HOME)), int(math.log2(max(2, len(mine)) / 8)) if len(mine) >= 16 else 1))
            for values, which, reach in ((half(mine, block), block, radius // BLOCKS), (mine, BLOCKS, radius)):
                tree = VantageTree(values, depth)
                # worth it only if every part is clearly smaller, visitors included; so the rounds end
                if tree.splits and np.bincount(tree.shards(values, reach)[1]).max() <= SMALLER * len(values):
                    trees[k] = (tree, which, reach, following)
                    following += BLOCKS << depth
                    break
            else:
                final.add(k)
        if not trees:
            return dealt
        dealt = written(_dealt_again(dealt, trees), "dealt")


def _dealt_again(dealt: DataFrame, trees: dict) -> DataFrame:
    shared = dealt.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 20_000):
                batch = whole.slice(low, 20_000)
                shard, fp, node, home = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                known = np.isin(shard, list(shared.value))
                yield batch.filter(pa.array(~known))
                for k in np.unique(shard[known]).tolist():
                    tree, which, reach, first = shared.value[k]
                    own = np.flatnonzero(shard == k)
                    values = fp[own].view(np.uint64)
                    row, leaf, at_home = tree.shards(values if which == BLOCKS else half(values, which), reach)
                    row = own[row]
                    number = first + leaf * BLOCKS + k % BLOCKS
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(fp[row]), pa.array(node[row]), pa.array(home[row] & at_home)], names=DEALT.names)

    return dealt.select(DEALT.names).mapInArrow(run, DEALT)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) with b < a over ``nodes`` (fp long, node long; fp distinct): enough to connect every pair within the radius."""
    dealt = split_again(written(deal(nodes, radius), "dealt"), radius)

    def search(part: pa.Table) -> pa.Table:
        fp, node, home = (part.column(c).to_numpy() for c in ("fp", "node", "home"))
        a, b = local_links(fp.view(np.uint64), home, node, radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): the smallest node that it is connected with.

    Large star: a node's larger neighbours move to its smallest one. Small star: a node and its smaller neighbours do. Both
    keep what is connected; when nothing moves, every node hangs on its component's smallest. The least neighbour is a
    pre-aggregated minimum that is joined back, so a node with many links isn't gathered anywhere.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = written(large, "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = written(
            large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct(),
            "links",
        )
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    own = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return own.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``id_col``, ``keep`` columns, ``fingerprint_bits``, ``component_id`` and ``component_bits`` of every row. The last is a
    fingerprint that names the component alone, as different components may share an id."""
    keep = keep or []
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *keep)
    prints = written(fingerprints(source, keep=["id", *keep], shingle=shingle), "fingerprints")
    nodes = written(prints.groupBy(F.col("fingerprint_bits").alias("fp")).agg(F.min("id").alias("node")), "nodes")
    # nodes are positions of their own, as an id may be null or shared by rows of different texts
    named = nodes.select("fp", F.col("fp").alias("node"))
    found = components(links(named, radius))
    firsts = nodes.join(found.withColumnRenamed("node", "fp"), "fp").select("fp", "component", F.col("node").alias("id"))
    least = firsts.groupBy("component").agg(F.min("id").alias("least"))
    classes = firsts.join(least, "component").select(F.col("fp").alias("fingerprint_bits"), "least", "component")
    every = nodes.select(F.col("fp").alias("fingerprint_bits"), F.col("node").alias("own")).join(classes, "fingerprint_bits", "left")
    component = F.coalesce("component", "fingerprint_bits").alias("component_bits")
    # written, so that the join's sides are plain shuffles, whose hot fingerprints Spark can split
    every = written(every.select("fingerprint_bits", F.coalesce("least", "own").alias("component_id"), component), "components")
    return prints.join(every, "fingerprint_bits").select(F.col("id").alias(id_col), *keep, "fingerprint_bits", "component_id", "component_bits")
