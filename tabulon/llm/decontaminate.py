"""Benchmark decontamination by template canonicalisation, with DataFrame functions alone.

A text becomes tokens: words (runs of letters and marks; in scripts without spaces each letter), numbers, and sentence ends
(one token ``.``). Numbers become ``<num>``, unit words after a number ``<unit>``, and capitalised words within a sentence
``<name>``; other words are lower-cased. A word that opens a sentence may be a name or not, so a text has two templates, with
such openers as words and as names; windows of the second are asked only where it differs. Windows of ``WINDOW`` template
tokens that hold a literal word are hash-joined between the benchmark and the documents: all windows of both.

A hit is an item's window at a place of a document; the difference of both positions is its alignment. Alignments of an item
that follow each other by up to ``GAP`` tokens (half an item's length, if less) are one copy with insertions or deletions. Each
alignment is judged alone and each such copy as a whole: a document leaks an item if the item's windows that it finds are at
least ``COVERAGE`` of the item's, or ``RUN`` of them, and its slots are consistent. Each slot of a window found pairs a value of
the item (a number, unit or name) with the document's value at that place. A pair is at odds if the item's value also faces
another value, or, of names, if the document's name also faces another name; at least ``CONSISTENT`` of the distinct pairs must
not be. So re-parameterised copies are caught, and texts that merely share a template's shape are not.

The item windows are broadcast where their count is at most ``BROADCAST``; otherwise both sides are shuffled by the window. The
rows are the same either way: documents are told apart by id (null counts as a value) and hash of the text.

Defined cases: null and empty texts leak nothing. A text under WINDOW tokens is one window, so a short item is found where it
is a document's whole template. An item whose windows hold no literal word is never matched. Repeated items are told apart by
item id, a null one included; an item's windows that a document holds many times count once; repeated rows give one row a pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import written

WINDOW = 5
COVERAGE = 0.5
#: Agreeing windows that are evidence however long the item is: those of 13 tokens in a row.
RUN = 9
CONSISTENT = 0.9
#: The most tokens inserted or left out between two parts of a copy.
GAP = 8
BROADCAST = 500_000
# Blocks of scripts that are written without spaces; unit words.
SPACELESS = r"฀-໿က-႟ក-៿⺀-꓏豈-﫿\x{20000}-\x{3ffff}"
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros degree degrees meter meters metre metres kilometer kilometers kilometre kilometres"
).split()
TOKENS = (
    rf"[a-zA-Z]++(?![\p{{L}}\p{{M}}])|[{SPACELESS}&&[\p{{L}}\p{{M}}]]|[\p{{L}}\p{{M}}&&[^{SPACELESS}]]++"
    r"|\p{Nd}++(?:[.,]\p{Nd}++)*+|[.!?。！？]++"
)
#: From a text to its template: numbers, sentence ends, letters of scripts without spaces, what lies between tokens.
REWRITES = (
    (r"\p{Nd}++(?:[.,]\p{Nd}++)*+", " 0 "),
    (r"[.!?。！？]++", " . "),
    (rf"([{SPACELESS}&&[\p{{L}}\p{{M}}]])", " $1 "),
    (r"[^a-zA-Z\p{L}\p{M}0.]++", " "),
)
#: And then, between single spaces: units, openers, names.
MARKS = (
    (rf"0 (?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?= |\z)", "0 1"),
    (r"\. \p{Lu}(?!\p{Lu})[^ ]*+", ". 3"),
    (r"\A\p{Lu}(?!\p{Lu})[^ ]*+", "3"),
    (r" \p{Lu}(?!\p{Lu})[^ ]*+", " 2"),
)


def tokens(text: Column) -> Column:
    """Raw tokens: words, numbers, sentence ends."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0))


def template(text: Column) -> Column:
    """The template tokens, one for each raw token, between single spaces. No number is left, so digits are the marks: ``0`` a
    number, ``1`` a unit, ``2`` a name, and ``3`` a capitalised word that opens a sentence."""
    s = F.coalesce(text, F.lit(""))
    for pattern, put in REWRITES:
        s = F.regexp_replace(s, pattern, put)
    s = F.trim(s)
    for pattern, put in MARKS:
        s = F.regexp_replace(s, pattern, put)
    return F.lower(s)


def windows(parts: Column, hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """The windows of a template's tokens; a short text is one window."""
    last = F.greatest(F.size(parts) - WINDOW, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: hashed(F.slice(parts, i + 1, WINDOW)))


def _as_opener(n: int) -> Callable[[Column, Column], Column]:
    return lambda x, k: F.when((x == "2") & (k == n), "3").otherwise(x)


def item_windows(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """key, item, length (tokens), total (windows with a literal word), ipos, and the window's slots (place, value, kind).

    A window has a key for each way in which a document may hold it: its sentence openers as openers, as names, or as plain
    words; and its names as openers.
    """
    text = F.col(f"`{item_text_col}`")
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), tokens(text).alias("v"), F.split(template(text), " ").alias("t")).where(F.size("v") > 0)
    each = items.select("*", F.posexplode(windows(F.col("t"), lambda w: w)).alias("ipos", "w"))
    each = each.where(F.exists("w", lambda x: ~x.isin("0", "1", "2", "3", ".")))
    raw = lambda k: F.lower(F.get(F.col("v"), F.col("ipos") + k))
    ways = [
        F.col("w"),
        F.transform("w", lambda x: F.when(x == "3", "2").otherwise(x)),
        F.transform("w", lambda x, k: F.when(x == "3", raw(k)).otherwise(x)),
        *(F.transform("w", _as_opener(n)) for n in range(WINDOW)),
    ]
    slots = F.transform("w", lambda x, k: F.struct(k.alias("k"), F.get(F.col("v"), F.col("ipos") + k).alias("a"), F.when(x == "3", "2").otherwise(x).alias("kind")))
    slots = F.filter(slots, lambda s: s["kind"].isin("0", "1", "2"))
    keys = F.array_distinct(F.array(*(F.xxhash64(w) for w in ways)))
    each = each.select("item", F.size("v").alias("length"), "ipos", slots.alias("slots"), F.explode(keys).alias("key"))
    total = each.groupBy("item").agg(F.countDistinct("ipos").alias("total")).withColumnRenamed("item", "counted")
    return each.join(total, F.col("item").eqNullSafe(F.col("counted"))).drop("counted").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """id, hash, pos and the item window that is found there."""
    keys = written(item_windows(benchmark, item_col, item_text_col), "item-windows")
    small = keys.count() <= BROADCAST
    text = F.col(f"`{text_col}`")
    # a column of its own at each step, as a generator evaluates what it repeats; the outer form, as else a filter is inferred
    # that makes all windows again
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), F.split(template(text), " ").alias("t"))
    asked = found.select("id", "hash", F.posexplode_outer(windows(F.col("t"))).alias("pos", "key"))
    return written(asked.join(F.broadcast(keys) if small else keys, "key").drop("key"), "hits")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc id, item id, coverage, slots, slots_changed) of every document and item that it leaks."""
    found = leaking(docs, benchmark, id_col, text_col, item_col, item_text_col)
    # rows of one id may carry different texts: the one that covers more speaks for the id
    best = F.max(F.struct("coverage", "slots", "slots_changed")).alias("best")
    found = found.groupBy("id", "item").agg(best)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.coverage", "best.slots", "best.slots_changed")


def leaking(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """id, hash, item, coverage, slots and slots_changed of the best copy of each item in each text."""
    found = hits(docs, benchmark, id_col, text_col, item_col, item_text_col)
    # a copy can't have more of an item's windows than the whole text has, so most texts need no closer look
    pair = ["id", "hash", "item"]
    enough = lambda n: (n >= COVERAGE * F.col("total")) | (n >= RUN)
    likely = found.groupBy(*pair).agg(F.countDistinct("ipos").alias("n"), F.first("total").alias("total")).where(enough(F.col("n")))
    likely = written(likely.select(*(F.col(c).alias(f"l_{c}") for c in pair)), "likely")
    found = found.distinct().join(likely, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("hash") == F.col("l_hash")) & F.col("item").eqNullSafe(F.col("l_item")), "left_semi")
    # the other texts give their values: they are tokenised again
    own = likely.select(F.col("l_id").alias("own_id"), F.col("l_hash").alias("own_hash")).distinct()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    same = rows["id"].eqNullSafe(own["own_id"]) & (F.xxhash64(rows["text"]) == own["own_hash"])
    values = rows.join(own, same, "left_semi").select(F.col("id").alias("own_id"), F.xxhash64("text").alias("own_hash"), "text").dropDuplicates(["own_id", "own_hash"])
    values = values.select("own_id", "own_hash", tokens(F.col("text")).alias("v"))
    placed = found.join(values, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash")))
    pairs = F.transform("slots", lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("a"), F.get(F.col("v"), F.col("pos") + s["k"]).alias("b")))
    key = ["id", "hash", "item", "length", "total"]
    placed = placed.select(*key, "ipos", (F.col("pos") - F.col("ipos")).alias("offset"), pairs.alias("pairs"))
    by = Window.partitionBy("id", "hash", "item").orderBy("offset")
    near = F.least(F.lit(GAP), F.expr("length div 2"))
    first = F.coalesce(F.col("offset") - F.lag("offset").over(by) > near, F.lit(True)).cast("int")
    placed = placed.withColumn("first", first)
    placed = placed.withColumn("copy", F.sum("first").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    # each alignment alone, and the copy that it belongs to
    key = [*key, "copy", "alone"]
    scoped = written(placed.select(*key[:-1], F.explode(F.array(F.lit(None).cast("int"), F.col("offset"))).alias("alone"), "ipos", "pairs"), "placed")
    n = scoped.groupBy(*key).agg(F.countDistinct("ipos").alias("n"))
    n = n.where(enough(F.col("n")))
    each = scoped.select(*key, F.explode("pairs").alias("p")).select(*key, "p.kind", "p.a", "p.b").distinct()
    facing, faced = Window.partitionBy(*key, "kind", "a"), Window.partitionBy(*key, "kind", "b")
    odd = (F.count("*").over(facing) > 1) | (F.col("kind") == "2") & (F.count("*").over(faced) > 1)
    judged = each.withColumn("odd", odd).groupBy(*key).agg(F.count("*").alias("slots"), F.count(F.when(F.col("odd"), 1)).alias("odd"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("slots_changed"))
    names = ["id", "item", "alone"]
    rest = [k for k in key if k not in names]
    judged = judged.select(*(F.col(k).alias(f"j_{k}") for k in key), "slots", "odd", "slots_changed")
    match = F.lit(True)
    for k in key:
        match = match & (F.col(k).eqNullSafe(F.col(f"j_{k}")) if k in names else F.col(k) == F.col(f"j_{k}"))
    whole = n.join(judged, match, "left").select(*names, *rest, "n", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("slots", "odd", "slots_changed")))
    kept = whole.where(F.col("odd") <= (1 - CONSISTENT) * F.col("slots"))
    best = F.max(F.struct((F.col("n") / F.col("total")).alias("coverage"), "slots", "slots_changed")).alias("best")
    return kept.groupBy("id", "hash", "item").agg(best).select("id", "hash", "item", "best.coverage", "best.slots", "best.slots_changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text leaks an item, whatever their id."""
    bad = leaking(docs, benchmark, id_col, text_col, item_col, item_text_col).select(F.col("id").alias("bad_id_"), F.col("hash").alias("bad_hash_")).distinct()
    same = docs[f"`{id_col}`"].eqNullSafe(bad["bad_id_"]) & (F.xxhash64(docs[f"`{text_col}`"]) == bad["bad_hash_"])
    return docs.join(bad, same, "left_anti")
