"""Contract queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tabulon.llm import bpe, decontaminate, langid, license_scan, merkle, secret_scan, sharding, simhash, toxicity, warc
from tabulon.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, keep=["doc_id"])


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~langid.held_out_split())
    found = langid.predict(docs.drop("lang"), model, keep=["doc_id"])
    return found.select("doc_id", langid.held_out_split().alias("held_out"), "lang_pred", "score")


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak, with the items that each leaks."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0")).alias("fingerprint"), "component_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.find(docs, secret_scan.fit(docs), keep=["doc_id"])


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("doc_id", (~toxicity.learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


OPERATORS = (op1_sharding, op2_bpe, op3_language, op4_merkle, op5_decontaminate, op6_licenses, op7_simhash, op8_secrets, op9_warc, op10_toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


_PIECE = r"(?:[^\x09-\x0D\x20]+[\x09\x0B-\x0D\x20]+){{0,2}}(?:[^\x09-\x0D\x20]*[^\x09-\x0D\x20aenst.!?,;:][\x09\x0B-\x0D\x20]+){{0,5}}[^\x09-\x0D\x20]+[\x09\x0B-\x0D\x20]*"
_LEAVES = f"list_transform(string_split(regexp_replace({{}}, '{_PIECE}', '\\0' || chr(31), 'g'), chr(10)), lambda x: list_transform(list_filter(string_split(x, chr(31)), lambda p: p <> ''), lambda p: sha256(p)))"
_PARAGRAPHS = "list_transform(list_zip(string_split({0}, chr(10)), {1}), lambda x: sha256(strlen(x[1])::varchar || array_to_string(x[2], '')))"
_CUTS = "list_concat([0], list_filter(range(1, len({0})), lambda i: starts_with({0}[i], '0')), [len({0})])"
_SECTIONS = "list_transform(range(1, len({1})), lambda i: sha256(array_to_string({0}[{1}[i] + 1 : {1}[i + 1]], '')))"
_LIKE = "case when len({0}) + len({1}) = 0 then 1.0 else 2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1})) end"
_CHANGED = "list_filter(range(0, len(p2)), lambda i: not list_contains(p1, p2[i + 1]))"
#: What SQL can express: the Merkle fingerprints (likeness by flat sets of leaves) and the archives' index.
SQL = {
    "op4_merkle": f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select *, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next, length(text) as n_chars, length(text) // 2 as h from d),
e as (select *, left(text, n_chars - h) || left(next, h) as edited from n),
l as (select *, {_LEAVES.format('text')} as v1, {_LEAVES.format('edited')} as v2, {_LEAVES.format('next')} as v3 from e),
p as (select *, {_PARAGRAPHS.format('text', 'v1')} as p1, {_PARAGRAPHS.format('edited', 'v2')} as p2 from l),
c as (select *, {_CUTS.format('p1')} as c1, {_CUTS.format('p2')} as c2, list_distinct(flatten(v1)) as l1, list_distinct(flatten(v2)) as l2, list_distinct(flatten(v3)) as l3, {_CHANGED} as places from p)
select doc_id, n_chars, sha256(edited) as edited_sha256, sha256(array_to_string({_SECTIONS.format('p1', 'c1')}, '')) as fingerprint,
  sha256(array_to_string({_SECTIONS.format('p2', 'c2')}, '')) as edited_fingerprint, ({_LIKE.format('l1', 'l2')})::double as near_edited, ({_LIKE.format('l1', 'l3')})::double as near_next,
  len(list_distinct(list_transform(places, lambda i: p2[i + 1]))) as edited_paragraphs, list_min(places) as first_edited
from c""",
    "op9_warc": """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) end as last from p)
select page_id, payload_bytes, payload_digest, case when last <> page_id then 'revisit' else 'response' end as record_type, case when last <> page_id then last end as refers_to from m""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
