"""The corpus pipeline: five stages from raw documents to token ids, each over all that the stage before kept.

Rows are documents (doc_id, text, lang, source, n_chars) and whatever other columns the table has. Language identification
rejects texts in no known language; of near-duplicates one document stays; documents that leak a benchmark item go; secrets are
replaced by a mark (``n_chars`` follows the text); what is left is encoded, and decoded again as a test of each row.

A row is named by its id (null counts as a value) and its text: rows of one id with different texts are different documents,
and rows that agree in both are one, of which near-duplicate removal keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, decontaminate, langid, secret_scan, similar, simhash
from tabulon.llm.common import table, written
from tabulon.llm.queries import VOCABULARY

#: A column of the stages' own, whose name no table has.
ROW = "_pipeline_row"
#: A text that the best language model codes no shorter than as plain bytes is in no known language.
BITS_PER_BYTE = 8.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with a letter that a language model codes in under 8 bits a byte."""
    model = langid.fit(docs, ~langid.held_out_split())
    found = langid.predict(docs.withColumn(ROW, F.struct(*docs.columns)), model, keep=[ROW, "text"])
    kept = found.where((F.col("lang_pred") != langid.UND) & (F.col("bits_per_byte") < BITS_PER_BYTE))
    return kept.select(f"{ROW}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (5-word shingles, 3 bits) the row with the smallest id stays (null ids last). Texts whose sets of
    5-word shingles are 0.8 similar may differ in many more bits, so what stays is searched for those too, verified exactly."""
    named = docs.withColumn(ROW, similar.row_of("doc_id", "text"))
    groups = simhash.cluster(named, shingle=similar.SHINGLE, keep=[ROW])
    first = groups.groupBy("component_bits").agg(F.min(ROW).alias(ROW)).select(ROW)
    kept = written(named.join(first, ROW, "left_semi").dropDuplicates([ROW]).drop(ROW), "pipeline-simhash")
    return similar.without_similar(kept)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak an item of the benchmark table."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; no document is dropped."""
    clean = secret_scan.redact(docs, secret_scan.fit(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (decimal, comma-joined), n_tokens, and whether decoding gives the text back."""
    return bpe.encode_checked(docs, VOCABULARY, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]
#: Trained models and tokenization aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's result a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
