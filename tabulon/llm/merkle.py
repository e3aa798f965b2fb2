"""Document fingerprints: Merkle trees over pieces, paragraphs and sections, by built-in functions alone.

A text's lines are its paragraphs. A paragraph is cut into pieces, the leaves, where its own words say so: a piece has at least
``LEAST`` words and ends with the first word after them that ends with a character of ``ENDS``, or with the ``MOST``th word; so
behind an edit the cuts soon fall where they did before. A leaf's hash is SHA-256 of the piece, white space included; a
paragraph's that of its length in bytes and its leaves' hashes; sections are runs of paragraphs that end with one whose hash
begins with ``0`` (16 paragraphs on average), so inserted lines move no other section; a section's hash is that of its
paragraphs' hashes, and the root's that of the sections'. The root is the fingerprint: equal roots mean equal texts.

Two trees are compared from the root down: below a section that the other tree has too nothing differs, so only the other
sections are entered. Their paragraphs that the other tree lacks locate the edit, and their leaves that it lacks are counted:
the likeness is the share of distinct leaves that both trees have, twice the common ones over the sum of both.

Null texts count as empty; the empty text has one paragraph and no leaf; two texts without leaves have likeness 1. Texts are
hashed whole. Ids may be null or repeated; rows of equal id are ordered by a hash of the text; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the fingerprint: white space, characters at whose words pieces end, and the words of a piece.
BLANK = r"\x09\x0B-\x0D\x20"
WORD = r"[^\x09-\x0D\x20]"
ENDS = "aenst.!?,;:"
LEAST, MOST = 3, 8
PIECE = rf"(?:{WORD}+[{BLANK}]+){{0,{LEAST - 1}}}(?:{WORD}*[^\x09-\x0D\x20{ENDS}][{BLANK}]+){{0,{MOST - LEAST}}}{WORD}+[{BLANK}]*"
#: Sections that are told apart one by one; trees of more are compared by all their leaves, with the same result.
PRUNED = 4096
#: Parts pieces; where a text holds it, it cuts too, and the paragraph's length tells such texts apart.
MARK = "\x1f"
#: Bytes of text in a bucket of neighbouring ids, and the most buckets (their table is broadcast).
BUCKET_BYTES = 16 << 20
BUCKETS = 1 << 16
CELLS = 4096


def leaves(text: Column) -> Column:
    """Hashes of the pieces of each paragraph: an array of arrays."""
    cut = F.regexp_replace(text, PIECE, f"$0{MARK}")
    pieces = lambda line: F.filter(F.split(line, MARK, -1), lambda p: p != "")
    return F.transform(F.split(cut, "\n", -1), lambda line: F.transform(pieces(line), lambda p: F.sha2(p, 256)))


def paragraphs(text: Column, leaf: Column) -> Column:
    """Hashes of the paragraphs over their leaves."""
    sizes = F.transform(F.split(text, "\n", -1), lambda line: F.octet_length(line).cast("string"))
    return F.zip_with(sizes, leaf, lambda n, own: F.sha2(F.concat(n, F.array_join(own, "")), 256))


def cuts(paragraph: Column) -> Column:
    """Where sections begin (from 0), and behind them the number of paragraphs."""
    n = F.size(paragraph)
    inner = F.filter(F.sequence(F.lit(1), n), lambda i: (i < n) & F.get(paragraph, i - 1).startswith("0"))
    return F.concat(F.array(F.lit(0)), inner, F.array(n))


def runs(paragraph: Column, cut: Column) -> Column:
    """Of each section: hash, first paragraph (from 0) and number of paragraphs."""
    one = lambda i: F.struct(
        F.sha2(F.array_join(F.slice(paragraph, F.get(cut, i) + 1, F.get(cut, i + 1) - F.get(cut, i)), ""), 256).alias("hash"),
        F.get(cut, i).alias("first"),
        (F.get(cut, i + 1) - F.get(cut, i)).alias("n"),
    )
    return F.transform(F.sequence(F.lit(0), F.size(cut) - 2), one)


def root(section: Column) -> Column:
    return F.sha2(F.array_join(section["hash"], ""), 256)


def tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``_leaf, ``name``_par and ``name``_sec: the tree of column ``text``, each level a column made once."""
    df = df.withColumn(f"{name}_leaf", leaves(F.col(text)))
    df = df.withColumn(f"{name}_par", paragraphs(F.col(text), F.col(f"{name}_leaf")))
    df = df.withColumn(f"{name}_cut", cuts(F.col(f"{name}_par")))
    return df.withColumn(f"{name}_sec", runs(F.col(f"{name}_par"), F.col(f"{name}_cut"))).drop(f"{name}_cut")


def entered(a: str, b: str) -> Column:
    """Numbers (from 0) of the paragraphs of tree ``a`` below sections that tree ``b`` lacks."""
    sec = F.col(f"{a}_sec")
    lacked = F.array_except(sec["hash"], F.col(f"{b}_sec")["hash"])
    below = F.filter(sec, lambda s: F.array_contains(lacked, s["hash"]))
    inside = lambda found: F.flatten(F.transform(found, lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))
    return F.when(F.size(lacked) == 0, F.array().cast("array<int>")).when(F.size(sec) > PRUNED, inside(sec)).otherwise(inside(below))


def lacked_paragraphs(a: str, b: str, places: Column) -> Column:
    """Distinct hashes of the paragraphs of ``a``, among ``places``, that ``b`` lacks, in order."""
    return F.array_except(F.transform(places, lambda i: F.get(F.col(f"{a}_par"), i)), F.col(f"{b}_par"))


def likeness(a: str, b: str, places: Column) -> Column:
    """0 to 1; ``places``: the paragraphs of ``a`` that may hold leaves that ``b`` lacks."""
    own, other = (F.size(F.array_distinct(F.flatten(f"{t}_leaf"))) for t in (a, b))
    lacked = F.size(F.array_except(F.flatten(F.transform(places, lambda i: F.get(F.col(f"{a}_leaf"), i))), F.flatten(f"{b}_leaf")))
    return F.when(own + other == 0, 1.0).otherwise(2.0 * (own - lacked) / (own + other))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, next): each row's text and that of the next row by id; after the last comes the first.

    Ids are cut into buckets of neighbours: a histogram over equal cells of the id range shows how many buckets each cell
    needs. Each bucket's first row is also sent, as a guest, to the bucket before, so one shuffle of the texts and a window
    within buckets are enough. Null ids come first, ties are ordered by the text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n, size, low, high = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min("id"), F.max("id")).first()
    if not n:
        return rows.withColumn("next", F.col("text"))
    wanted = min(BUCKETS, -(-size // BUCKET_BYTES) or 1)
    low, high = low or 0, high or 0
    width = max(1, -(-(high - low + 1) // CELLS))
    cell = F.expr(f"cast((id - {low}L) div {width}L as int)")
    cells = [(int(r[0]), -(-r[1] * wanted // n)) for r in rows.where("id is not null").groupBy(cell.alias("cell")).count().orderBy("cell").collect()]
    table, base = [], 1
    for c, parts in cells:
        table.append((c, base, max(1, -(-width // parts))))
        base += parts
    plan = spark.createDataFrame(table or [(0, 1, 1)], "cell int, base int, part long")
    placed = rows.withColumn("cell", cell).join(F.broadcast(plan), "cell", "left")
    placed = placed.select("id", "text", F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.expr(f"cast(base + (id - {low}L - cell * {width}L) div part as int)")).alias("bucket"))
    by_id = F.struct(F.col("id").isNotNull(), F.col("id"), F.xxhash64("text"))
    firsts = [(r[0], r[1]) for r in placed.groupBy("bucket").agg(F.min(by_id).alias("first")).orderBy("bucket").collect()]
    # the bucket before; the first bucket's first row is the guest of the last bucket
    guests = spark.createDataFrame(
        [(b, f[1], f[2], firsts[k - 1][0]) for k, (b, f) in enumerate(firsts)], "bucket int, first_id long, first_hash long, to int"
    )
    sent = placed.join(F.broadcast(guests), "bucket", "left")
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_hash"))
    places = F.when(is_first, F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")), F.struct(F.col("to").alias("b"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")))
    )
    dealt = sent.select("id", "text", F.explode(places).alias("place")).select("id", "text", "place.b", "place.guest")
    order = Window.partitionBy("b").orderBy("guest", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return dealt.withColumn("next", F.lead("text").over(order)).where("not guest").select("id", "text", "next")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (its last half replaced by the start of the next document), the likeness
    of its tree to the edited text's and the next document's, and where the edited tree differs: how many distinct paragraphs, and
    the first (from 0, null if none)."""
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), "text", "next", edited.alias("edited"))
    rows = tree(rows, "text", "a").select("id", "n_chars", "edited", "next", "a_leaf", "a_par", "a_sec")
    rows = tree(rows, "edited", "b").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    rows = rows.withColumn("places", entered("a", "b")).withColumn("near_edited", likeness("a", "b", F.col("places"))).withColumn("places", entered("b", "a"))
    rows = rows.withColumn("lacked", lacked_paragraphs("b", "a", F.col("places"))).withColumn("first_edited", F.array_position("b_par", F.get("lacked", F.lit(0))) - 1)
    rows = rows.withColumn("edited_fingerprint", root(F.col("b_sec"))).drop("b_leaf", "b_par", "b_sec")
    rows = tree(rows, "next", "c").withColumn("beside", entered("a", "c"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        root(F.col("a_sec")).alias("fingerprint"),
        "edited_fingerprint",
        "near_edited",
        likeness("a", "c", F.col("beside")).alias("near_next"),
        F.size("lacked").cast("long").alias("edited_paragraphs"),
        F.col("first_edited").cast("long").alias("first_edited"),
    )
