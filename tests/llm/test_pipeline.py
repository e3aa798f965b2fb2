"""The pipeline's stages on a small table, each held against a plain version of itself."""

import re

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tabulon.llm import queries, simhash
from test_model_operators import plain_base, plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage wrote, the documents first."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        df = stage(spark, docs, SF)
        df.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        out[name] = {r["doc_id"]: r for r in rows}
        assert len(out[name]) == len(rows)
    return out


def test_language(stages):
    kept = stages["language"]
    assert set(kept) == {i for i, r in stages["documents"].items() if r["text"] and re.search(r"[^\W\d_]", r["text"])}
    assert all(tuple(r) == tuple(stages["documents"][i]) for i, r in kept.items())


def test_near_duplicates(stages):
    before = stages["language"]
    ids = sorted(before)
    kept, gone = stages["near_duplicates"], []
    least = set(plain_components([plain_fingerprint(before[i]["text"], 5) for i in ids], ids))
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})(before[i]["text"].lower().split()) for i in sorted(least)}
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert set(kept) <= least
    for i in sorted(least):
        if i not in kept:
            assert any(alike(i, j) for j in least if j < i)
        else:
            gone += [(i, j) for j in kept if j < i and alike(i, j)]
    assert not gone


def test_decontamination(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(stages["near_duplicates"]) - set(stages["decontamination"])
    assert {i for i, r in stages["near_duplicates"].items() if any(t in r["text"] for t in items)} <= gone
    assert len(gone) < 0.1 * len(stages["near_duplicates"])


def test_secrets(stages):
    before, after = stages["decontamination"], stages["secrets"]
    assert set(before) == set(after)
    for i, r in after.items():
        assert not plain_base(r["text"]) and r["n_chars"] == len(r["text"])
        assert ("[SECRET]" in r["text"]) == bool(plain_base(before[i]["text"])) or r["text"] != before[i]["text"]


def test_encoding(stages):
    t = Tokenizer.from_file(queries.VOCABULARY)
    for i, r in stages["encoding"].items():
        want = t.encode(stages["secrets"][i]["text"], add_special_tokens=False).ids
        assert r["ids"] == ",".join(map(str, want)) and r["n_tokens"] == len(want) and r["round_trip"]


def test_run_is_the_stages(spark, stages):
    got = {r["doc_id"]: tuple(r) for r in entry.queries()["pipeline"](spark, SF).collect()}
    assert got == {i: tuple(r) for i, r in stages["encoding"].items()}


def test_odd_rows(spark):
    """Nulls in any column, repeated rows, empty texts, extra columns; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    text = "the cat and the dog sat on the mat " * 4
    rows = [(1, text, "en", "s", 3, "x"), (1, text, "en", "s", 3, "x"), (2, None, None, None, None, None), (3, "", "en", "s", 0, ""), (4, "123 456", "en", None, 1, None), (None, "another document stands here alone with some words token=0123456789abcdefffff", None, None, None, None), (5, "un chat et un chien " * 5, "fr", "s", 1, "")]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = simhash.written(stage(spark, docs, SF), name)
            if name != "encoding":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
        # the two equal rows are one; the null id's text is another document
        assert sorted((r["doc_id"] for r in docs.collect()), key=repr) == ([1, 5, None] if given else [])


def test_rows_of_one_id(spark):
    """Different texts under one id, and a null id: three documents, and a leak among them goes alone."""
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    unlike = lambda c: " ".join(f"{c}{k}w" for k in range(60))
    docs = spark.createDataFrame([(1, unlike("a"), "en", "s", 1), (1, unlike("b"), "en", "s", 1), (None, unlike("c"), "en", "s", 1), (None, leak, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert kept.count() == 4
    clean = dict(corpus_pipeline.STAGES)["decontamination"](spark, kept, SF)
    assert {(r["doc_id"], r["text"][0]) for r in clean.collect()} == {(1, "a"), (1, "b"), (None, "c")}


def test_every_operator_is_registered():
    assert [f"op{n}" for n in range(1, 11)] == sorted((k.split("_")[0] for k in entry.queries() if re.match(r"op\d+_", k)), key=lambda k: int(k[2:]))
