"""Sharding, BPE, Merkle fingerprints, WARC conversion and the shared plumbing."""

import glob
import gzip
import hashlib
import os
import random
import re
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tabulon.llm import bpe, merkle, queries, sharding, warc
from tabulon.llm.common import append_columns

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "a", "a", "é" * 50, "x " * 20000, "tail\n", "\n\n", None, "日本語\nabc", "=" * 3000]


def documents(spark, texts, schema=DOCS):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def by_id(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("doc_id").collect()]


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b", "kept", 2.5)], "doc_id long, text string, N_Tokens string, `odd name` double")
    got = bpe.encode_decode(df, queries.VOCABULARY)
    assert got.columns == ["doc_id", "text", "odd name", "ids", "n_tokens", "decoded"] and got.first()["decoded"] == "a b"
    twice = append_columns(df, ["text"], lambda: lambda t: ([x + x for x in t],), [("text", T.StringType())])
    assert twice.columns == ["doc_id", "N_Tokens", "odd name", "text"] and twice.first()["text"] == "a ba b"
    assert append_columns(df.where("false"), ["text"], lambda: lambda t: (t,), [("y", T.StringType())]).count() == 0


def plain_longest_first(loads, shards):
    totals = [0] * shards
    for load in sorted(loads, reverse=True):
        totals[totals.index(min(totals))] += load
    return sorted(totals)


@pytest.mark.parametrize(("heavy", "exact"), [(sharding.HEAVY, sharding.EXACT), (2, 40), (0, 40), (0, 4)])
def test_sharding(spark, monkeypatch, heavy, exact):
    """All groups one by one, some by class, all by class; classes of one load each give exactly what plain scheduling gives."""
    monkeypatch.setattr(sharding, "HEAVY", heavy)
    monkeypatch.setattr(sharding, "EXACT", exact)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rng = random.Random(3)
    texts = [*ODD[:6], *("w" * rng.randrange(400) for _ in range(300)), *["same text"] * 80, None]
    rows = by_id(sharding.assign(documents(spark, texts).withColumn("shard", F.lit("x")), 7), "doc_id", "size", "text_crc32", "shard", "slot")
    assert [r[1] for r in rows] == [len((t or "").encode()) + 8 for t in texts]
    assert [r[2] for r in rows] == [None if t is None else zlib.crc32(t.encode()) for t in texts]
    loads, slots, homes = [0] * 7, [set() for _ in range(7)], {}
    for (_, size, _, shard, slot), t in zip(rows, texts, strict=True):
        loads[shard] += size
        slots[shard].add(slot)
        assert homes.setdefault(t, shard) == shard
    assert [s == set(range(len(s))) for s in slots] == [True] * 7 and sum(map(len, slots)) == len(texts)
    groups = {}
    for t in texts:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 8
    plain = plain_longest_first(groups.values(), 7)
    if exact == 40 or heavy == 1024:
        assert sorted(loads) == plain
    assert max(loads) <= plain[-1] * 1.05


def test_schedule_is_longest_first():
    assert sharding.schedule([(1, "d"), (5, "a"), (4, "b"), (3, "c")], {}, 2)[0] == {"a": 0, "b": 1, "c": 1, "d": 0}
    rng = random.Random(8)
    for _ in range(30):
        loads = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 300))]
        classes = {x: (loads.count(x), x * loads.count(x)) for x in set(loads)}
        taken = sharding.schedule([], classes, 5)[1]
        assert sorted(sum(x * n[s] for x, n in taken.items()) for s in range(5)) == plain_longest_first(loads, 5)


def test_sharding_of_nothing(spark):
    assert sharding.assign(documents(spark, []), 3).collect() == []


def test_bpe(spark):
    t = Tokenizer.from_file(queries.VOCABULARY)
    rng = random.Random(2)
    texts = [*ODD, "<|endoftext|>a <|endoftext|>", *("".join(rng.choice("ab the'sré 12\n\t  .!日😀\u0085\U0001e5d0࢏") for _ in range(rng.randrange(50))) for _ in range(300))]
    df = documents(spark, texts)
    for row, text in zip(by_id(bpe.encode_decode(df, queries.VOCABULARY), "ids", "n_tokens", "decoded"), texts, strict=True):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert row == (",".join(map(str, want)), len(want), t.decode(want, skip_special_tokens=False)), text
    short = by_id(bpe.digests(df, queries.VOCABULARY, keep=["doc_id"]), "n_tokens", "ids_sha256", "decoded_sha256")
    assert short[0] == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_bpe_arrays_and_heap_agree():
    c, rng = bpe.codec(queries.VOCABULARY), random.Random(4)
    for _ in range(400):
        ids = [c.byte_ids[b] for b in "".join(rng.choice("aeinrst hé") for _ in range(rng.randrange(40))).encode()]
        assert c._scan(list(ids)) == c._heap(list(ids))


def test_merkle_compare(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET_BYTES", 200)
    texts = ["one two three four five six\nseven eight", "alpha beta gamma delta epsilon zeta", *ODD, *("p%d q r s t u v w\n" % k * 30 for k in range(40))]
    rows = by_id(merkle.compare_edits(documents(spark, texts)), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    full = [t or "" for t in texts]
    for k, (row, a) in enumerate(zip(rows, full, strict=True)):
        b, h = full[(k + 1) % len(full)], len(a) // 2
        edited = a[: len(a) - h] + b[:h]
        assert row[:2] == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert (row[2] == row[3]) == (a == edited) and 0 <= row[4] <= 1 and 0 <= row[5] <= 1 and (a != edited or row[4] == 1)
    prints = {}
    for row, a in zip(rows, full, strict=True):
        assert prints.setdefault(a, row[2]) == row[2]
    assert len(set(prints.values())) == len(prints)


@pytest.mark.parametrize("ids", [[7], [5, 5, None, -3, 1 << 50], []])
def test_merkle_next_of_odd_ids(spark, ids):
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], DOCS)
    got = {(r["id"], r["text"]): r["next"] for r in merkle.with_next(df, "doc_id", "text").collect()}
    ordered = sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(ids) and set(got.values()) == {t for _, t in ordered}
    for (i, t), after in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        assert i == 5 or after[0] == 5 or got[i, t] == after[1]


def test_merkle_locates_edits(spark, monkeypatch):
    lines = [f"line {k} of one text" for k in range(300)]
    other = [*lines]
    other[40], other[77] = "changed", ""
    moved = ["inserted before all", *lines]
    word = " ".join(f"w{k}{'abcdefghnst'[k % 11]}" for k in range(400))
    for pruned in (merkle.PRUNED, 0):
        monkeypatch.setattr(merkle, "PRUNED", pruned)
        df = spark.createDataFrame([("\n".join(lines), "\n".join(other)), ("\n".join(lines),) * 2, ("\n".join(lines), "\n".join(moved)), (word, word.replace("w200", "more words w200"))], "a string, b string")
        df = merkle.tree(merkle.tree(df, "a", "a"), "b", "b").withColumn("places", merkle.entered("b", "a"))
        got = df.select("places", "b_par", merkle.lacked_paragraphs("b", "a", F.col("places")).alias("lacked"), merkle.likeness("b", "a", F.col("places")).alias("like")).collect()
        assert [[r["b_par"].index(x) for x in r["lacked"]] for r in got] == [[40, 77], [], [0], [0]]
        assert got[1]["like"] == 1 and all(0.95 < got[k]["like"] < 1 for k in (0, 2, 3))
        # only sections around the edits are entered
        assert pruned == 0 or len(got[0]["places"]) < 200 and len(got[2]["places"]) < 150 and not got[1]["places"]


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, name):
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df, want = queries.queries()[name](spark, SF), c.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, df.select(columns).collect())) == sorted(key(tuple(r[want.columns.index(x)] for x in columns)) for r in want.fetchall())


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    same = "s" * 1000
    payloads = [None, "", same, same, "s" * 999, "s" * 999, "WARC/1.0\r\n\r\n\r\n\r\nWARC/1.0\r\n", "é" * 600, "é" * 600, same, "\n", "\r\n\r\n", "x\n" * 5000, "\x00"]
    rows = [(k, f"http://h/{k} a\nb" if k % 2 else None, p) for k, p in enumerate(payloads)]
    got = {r["page_id"]: r for r in warc.round_trip(pages(spark, [*rows, (None, "u", "null id")])).collect()}
    assert len(got) == len(rows) + 1
    for k, p in enumerate(payloads):
        raw = (p or "").encode()
        last = max(j for j, q in enumerate(payloads) if (q or "") == (p or ""))
        other = last if len(raw) >= 1000 and last != k else None
        assert (got[k]["payload_bytes"], got[k]["payload_digest"], got[k]["record_type"], got[k]["refers_to"]) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other is not None else "response", other)
    assert warc.round_trip(pages(spark, [])).count() == 0
    twice = warc.round_trip(pages(spark, [(1, "u", same)] * 3 + [(1, "v", "other"), (0, "u", same), (None, "n", same), (None, "n", "a")]).withColumn("digest", F.lit(1))).collect()
    assert len(twice) == len({r["record_id"] for r in twice}) == 7
    assert sorted(r["record_type"] for r in twice) == ["response"] * 5 + ["revisit"] * 2 and {r["refers_to"] for r in twice} == {None, 1}


@pytest.mark.parametrize("version", [1, 2])
def test_arc(version):
    """Files of several records, plain and by gzip members; bodies with and without an HTTP head; wrong lengths, dates, versions."""
    body, answer = b"<html>\nx y\n</html>", b"HTTP/1.0 404 Gone\r\nServer: s\r\n\r\nlost\r\n\r\nhere"
    one = warc.arc_file(version, "http://a b/c", body)
    two = warc.arc_file(version, "http://d", answer, date="19990102030405").split(b"\n", 4)[-1].lstrip(b"\n") if version == 1 else None
    (head, got), = warc.arc_records(one)
    assert got == body and head["url"] == "http://a b/c" and head["date"] == warc.ARC_DATE and (version == 1) == ("checksum" not in head)
    if two:
        two = two[two.index(b"http://d") :]
        for raw in (one + two, one + b"\n" + two, gzip.compress(one) + gzip.compress(two)):
            assert [(h["url"], b) for h, b in warc.arc_records(raw)] == [("http://a b/c", body), ("http://d", answer)]
    for block, payload, http in ((answer, b"lost\r\n\r\nhere", b"HTTP/1.0 404 Gone"), (body, body, b"HTTP/1.1 200 OK")):
        (head, got), = warc.arc_records(warc.arc_file(version, "http://d", block, date="19990102030405"))
        (fields, out), = warc.records(warc.convert(head, got, "7", None))
        assert out.startswith(http) and out.count(b"HTTP/") == 1 and warc.payload_of(fields, out) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert fields["warc-date"] == "1999-01-02T03:04:05Z" and fields["warc-type"] == "response"
    for bad in (b"http://x 1.2.3.4\n", one[:-5], warc.arc_file(version, "u", body, date="2024"), warc.arc_file(version, "u", body).replace(b"%d 0" % version, b"7 0")):
        with pytest.raises(ValueError):
            list(warc.arc_records(bad))


def test_warc_members():
    """Gzip members one after another, plain archives, and archives that are cut."""
    one, two = (warc.convert(*next(warc.arc_records(warc.arc_file(1, "u", b"body%d" % k))), str(k), None) for k in range(2))
    for raw in (one + two, gzip.compress(one) + gzip.compress(two), gzip.compress(one + two), warc.member(one) + warc.member(two)):
        assert [f["x-source-key"] for f, _ in warc.records(raw)] == ["0", "1"]
    with pytest.raises(ValueError):
        list(warc.records((one + two)[:-10]))
    assert warc.member(b"x" * ((1 << 24) + 5)).endswith(b"\0") and gzip.decompress(warc.member(b"x" * ((1 << 24) + 5))) == b"x" * ((1 << 24) + 5)


def test_llm_is_apart():
    """Nothing else in the library imports this subpackage."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for path in glob.glob(f"{top}/tabulon/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path, encoding="utf-8") as f:
                assert not re.search(r"^\s*(from|import)\b.*\bllm\b", f.read(), re.M), path


def test_vocabulary_is_a_parameter():
    assert queries.VOCABULARY == public_tokenizers.path("byte_bpe_50k.json")
