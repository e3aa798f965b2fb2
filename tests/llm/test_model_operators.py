"""Language identification, SimHash, decontamination, license and secret scans, toxicity."""

import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, langid, license_scan, secret_scan, simhash, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "\n", "a", "a", "12 34", "é" * 50, "x " * 20000, "日本語"]


def documents(spark, texts, schema=DOCS):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def by_id(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("doc_id").collect()]


# -- language identification


def plain_ppm(training, text):
    """Code length by prediction by partial matching with escapes, straight from the counts."""
    counts = [defaultdict(lambda: defaultdict(int)) for _ in range(langid.ORDER + 1)]
    for t in training:
        raw = langid.PAD + t.encode()
        for i in range(langid.ORDER, len(raw)):
            for k in range(langid.ORDER + 1):
                counts[k][raw[i - k : i]][raw[i]] += 1
    raw, bits = langid.PAD + text.encode(), 0.0
    for i in range(langid.ORDER, len(raw)):
        for k in range(langid.ORDER, -1, -1):
            seen = counts[k].get(raw[i - k : i])
            if not seen:
                continue
            total, distinct = sum(seen.values()), len(seen)
            if raw[i] in seen:
                bits -= math.log2(seen[raw[i]] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


TRAINING = {"aa": ["the cat sat on the mat", "a cat", "mat"], "bb": ["der hund saß auf", "hund der Hunde", ""]}


def trained(spark):
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, ts in TRAINING.items() for t in ts)]
    df = spark.createDataFrame([*rows, (98, None, "aa"), (99, "unknown", None)], "doc_id long, text string, lang string")
    return langid.fit(df, F.lit(True))


def test_code_lengths(spark, monkeypatch):
    monkeypatch.setattr(langid, "SLICE", 64)
    model = trained(spark)
    assert model.languages == ["aa", "bb"]
    texts = ["the cat", "der Hund", "zzz é", "x", "the mat saß " * 40, "cat", ""]
    got = langid.Scorer(model).bits([t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, [plain_ppm(TRAINING[lang], t) for lang in ("aa", "bb")]), t


def test_language_predictions(spark):
    texts = [*ODD, "the cat on the mat", "hund der hund"]
    rows = by_id(langid.predict(documents(spark, texts), trained(spark)), "lang_pred", "score")
    for t, (lang, score) in zip(texts, rows, strict=True):
        assert 0 <= score <= 1 and (lang == "und") == (t is None or not any(c.isalpha() for c in t)) and (lang != "und" or score == 0)
    assert [r[0] for r in rows[-2:]] == ["aa", "bb"]
    blank = langid.fit(spark.createDataFrame([(1, "", "aa"), (2, "", "bb"), (3, None, "aa")], "doc_id long, text string, lang string"), F.lit(True))
    assert blank.languages == [] and {r[0] for r in by_id(langid.predict(documents(spark, texts), blank), "lang_pred")} == {"und"}
    model = trained(spark)
    assert langid.Scorer(model).predict(["²½Ⅷ 3", "½"])[0] == ["und"] * 2
    many = [f"the cat {k}" * (k + 1) for k in range(20)]
    alone = [langid.Scorer(model).predict([t])[1][0] for t in many]
    assert langid.Scorer(model).predict(many)[1] == alone  # bit for bit, whatever stands beside
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"), F.lit(True))
    assert {r[0] for r in by_id(langid.predict(documents(spark, texts), empty), "lang_pred")} == {"und"}


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, ~langid.held_out_split())
    found = langid.predict(docs, model).where(langid.held_out_split()).agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert found > 0.98


# -- SimHash


def plain_fingerprint(text, size=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, ids, radius=3):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius and root(i) != root(j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, k in enumerate(ids):
        least[root(i)] = min(least.get(root(i), k), k)
    return [least[root(i)] for i in range(len(prints))]


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [*ODD, "A B", "One Two Three", "É É É É", "\x1ca b\x85c d", *(" ".join(rng.choice("abcdef") for _ in range(rng.randrange(40))) for _ in range(50))]
    got = by_id(simhash.fingerprints(documents(spark, texts)), "fingerprint_bits")
    assert [g[0] % (1 << 64) for g in got] == [plain_fingerprint(t) for t in texts]
    assert spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0] % (1 << 64) == plain_fingerprint("a b c")


@pytest.mark.parametrize("home", [1500, 40])
def test_links_are_complete(spark, monkeypatch, home):
    """Random fingerprints with chains of near ones, in one shard and in many, against all pairs."""
    monkeypatch.setattr(simhash, "HOME", home)
    monkeypatch.setattr(simhash, "CELLS", 2000)
    rng = random.Random(home)
    values = {rng.getrandbits(64) for _ in range(500)}
    for v in list(values)[:60]:
        for _ in range(8):
            for _ in range(3):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    ids = [simhash.signed(v) for v in values]
    nodes = spark.createDataFrame([(i, i) for i in ids], "fp long, node long").repartition(3)
    found = dict(simhash.components(simhash.links(nodes)).collect())
    want = plain_components(values, ids)
    groups = defaultdict(int)
    for w in want:
        groups[w] += 1
    assert found == {i: w for i, w in zip(ids, want, strict=True) if groups[w] > 1}


def test_large_shards_are_split(spark, monkeypatch):
    """A tiny sample leaves large shards; they are split as far as a tree can tell them apart, and no link is lost."""
    monkeypatch.setattr(simhash, "HOME", 30)
    monkeypatch.setattr(simhash, "SAMPLE", 400)
    monkeypatch.setattr(simhash, "MOST", 400)
    rng = random.Random(5)
    shared = rng.getrandbits(32)
    # a third agrees in its lower half, which the tree of that half can't tell apart
    values = {rng.getrandbits(64) for _ in range(3000)} | {(rng.getrandbits(32) << 32) | shared for _ in range(1500)}
    for v in list(values)[:200]:
        values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(values)
    ids = [simhash.signed(v) for v in values]
    nodes = spark.createDataFrame([(i, i) for i in ids], "fp long, node long").repartition(3)
    first = simhash.written(simhash.deal(nodes, 3), "d")
    dealt = simhash.split_again(first, 3)
    sizes = lambda df: sorted((r["count"] for r in df.groupBy("shard").count().collect()), reverse=True)
    before, after = sizes(first), sizes(dealt)
    assert sum(n > 400 for n in before) > 10 and before[0] > 2000
    # only what shares a half stays together, as no ball of 3 bits around a vantage tells random halves apart
    assert sum(n > 400 for n in after) < sum(n > 400 for n in before) / 2 and after[0] <= 1500
    found = dict(simhash.components(simhash.links(nodes)).collect())
    want = plain_components(values, ids)
    assert all(found.get(i, i) == w for i, w in zip(ids, want, strict=True))


def test_components_of_chains(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 101), (101, 100), (7, 200)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, 200: 0, 100: 100, 101: 100}


def test_clusters(spark):
    base = " ".join(f"w{k}" for k in range(400))
    texts = [*ODD, base, base, base.replace("w200 ", "other "), base.upper(), "q " + base, *(" ".join(f"{k}v{j}" for j in range(60)) for k in range(30))]
    rows = by_id(simhash.cluster(documents(spark, texts)), "fingerprint_bits", "component_id")
    prints = [plain_fingerprint(t) for t in texts]
    assert [r[0] % (1 << 64) for r in rows] == prints
    assert [r[1] for r in rows] == plain_components(prints, range(len(texts)))
    assert simhash.cluster(documents(spark, [])).collect() == []
    odd = simhash.cluster(spark.createDataFrame([(3, base), (3, "x"), (None, base), (2, base)], DOCS)).collect()
    assert sorted((r[2] for r in odd), key=repr) == [2, 2, 2, 3]


# -- decontamination

ITEM = "A train leaves Boston at 40 miles per hour and travels toward Denver for 3 hours before it meets Alice who asked how far it went in 3 hours."
OTHER = "what is the capital of the largest northern country that borders the sea on two sides and has five lakes"


def leaked(spark, texts, **options):
    benchmark = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, OTHER), (4, "too short"), (5, None), (6, "")], "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(documents(spark, texts), benchmark, **options).collect()}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST, 0])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST", limit)
    filler = "some words that stand before and after the passage without any tie to it. " * 5
    again = ITEM.replace("Boston", "Lima").replace("Denver", "Quito").replace("Alice", "Bob").replace("40", "55").replace("3", "7")
    mixed = again.replace("7 hours before", "8 hours before").replace("Lima", "Oslo")
    half = " ".join(ITEM.split()[:8]) + " and nothing else of it"
    texts = [*ODD, filler + ITEM + filler, again, mixed, half, filler, OTHER.upper(), f"{OTHER} {OTHER}", OTHER.replace("capital", "biggest town"), filler + OTHER.replace(" ", "\n"), ITEM.lower()]
    got, n = leaked(spark, texts), len(ODD)
    assert set(got) == {(n, 1), (n + 1, 1), (n + 9, 1), *((n + k, i) for k in (5, 6, 7, 8) for i in (2, 3))}
    assert got[n, 1]["coverage"] == 1.0 and got[n, 1]["slots_changed"] == 0 and got[n + 1, 1]["slots_changed"] >= 4
    assert all(0 < r["coverage"] <= 1 for r in got.values())


def test_decontamination_of_a_part(spark):
    """13 words of a long item are evidence, 12 aren't."""
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("an", "el", "iv", "or", "ud", "yst")]
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = [" ".join(["x y", *words[20 : 20 + n], "z"]) for n in (12, 13, 30)]
    assert sorted(r["doc_id"] for r in decontaminate.leaks(documents(spark, texts), benchmark).collect()) == [1, 2]


def test_decontamination_of_nothing(spark):
    assert leaked(spark, []) == {}
    docs = spark.createDataFrame([(1, OTHER, "x"), (2, "clean text of its own", "y"), (None, OTHER, "z"), (1, OTHER, "x")], "doc_id long, text string, item_id string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.without_leaks(docs, empty).count() == 4
    kept = decontaminate.without_leaks(docs, spark.createDataFrame([(9, OTHER)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(kept.collect(), key=repr) == sorted(docs.where("doc_id = 2").collect(), key=repr)


def test_decontamination_of_planted_passages(spark):
    docs, benchmark = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "benchmark"))
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    planted = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in (r["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert planted <= got and len(got - planted) <= 0.05 * len(planted) + 2
    sql = decontaminate.leaks(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in sql and "Arrow" not in sql and "CartesianProduct" not in sql and "NestedLoop" not in sql


# -- licenses


def plain_licenses(text):
    """Templates with a span of their own length that holds 0.8 of their shingles, by sliding over every word."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    out = set()
    for name, notices in license_scan.TEMPLATES.items():
        for notice in notices:
            w = re.findall(r"[a-z0-9]+", notice.lower())
            size = min(5, len(w))
            own = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
            n = len(w) - size + 1
            for s in range(max(1, len(words) - size + 1)):
                held = {tuple(words[k : k + size]) for k in range(s, min(s + n, len(words) - size + 1))}
                if len(own & held) / len(own) >= 0.8:
                    out.add(name)
    return out


def test_licenses(spark):
    rng = random.Random(6)
    notices = [(n, t) for n, ts in license_scan.TEMPLATES.items() for t in ts]
    texts = [t or "" for t in ODD[:5]]
    for _ in range(60):
        name, notice = rng.choice(notices)
        words = notice.split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        filler = [rng.choice(("the", "license", "of", "software", "word", "version")) for _ in range(rng.randrange(60))]
        texts.append(" ".join([*filler, *words, *filler]))
    got = by_id(license_scan.find(documents(spark, texts)), "licenses", "containment", "n_licenses")
    for t, (names, share, n) in zip(texts, got, strict=True):
        want = plain_licenses(t)
        assert bool(names) == bool(want) and set(filter(None, names.split(","))) <= want, t
        assert (share >= 0.8) == bool(want) == (n > 0)
    rows = by_id(license_scan.find(documents(spark, [None, "", "x " * 30000 + "Released under the MIT License."])), "licenses", "license_spans")
    assert rows[:2] == [("", ""), ("", "")] and rows[2] == ("MIT", "MIT:60000:60030")


# -- secrets


def plain_base(text):
    found = []
    for kind, pattern, flags in ((0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), (1, "AKIA[A-Z0-9]+", 0), (2, "[0-9a-f]+", 0)):
        for m in re.finditer(pattern, text, flags):
            if kind == 0 and len(m[2]) >= 12 or kind == 1 and len(m[0]) >= 18 or kind == 2 and len(m[0]) >= 16:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans():
    rng = random.Random(8)
    parts = ["password", "Token", "API_KEY", "apikey", "ſecret", "=", ": ", "  = '", '"', "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef" * 3, "é", " ", "x.y/z+w_-=12", "\n", "A1", "secret=secret=abcdefghijkl"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(10)))
        assert secret_scan.base_spans(text) == plain_base(text), text


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    model = secret_scan.Model(rng.normal(size=(secret_scan.N_FEATURES, 3)), secret_scan.untrained().transition + rng.normal(size=(3, 3)))
    for n in range(1, 7):
        rows = [tuple(int(o) + int(rng.integers(w)) for o, w in zip(secret_scan.OFFSETS, np.diff(secret_scan.OFFSETS))) for _ in range(n)]
        score = model.emission[np.array(rows)].sum(axis=1)

        def total(path, score=score):
            steps = sum(model.transition[a, b] for a, b in zip((0, *path), (*path, 0), strict=True))
            return steps + sum(s[p] for s, p in zip(score, path, strict=True))

        assert total(model.decode(rows)) == pytest.approx(max(total(p) for p in itertools.product(range(3), repeat=n)))


def secret_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    code = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = []
    for k in range(600):
        words = [word() for _ in range(30)]
        if k % 3 == 0:
            words.insert(rng.randrange(30), rng.choice((f"token = \"{code(40, '0123456789abcdef')}\"", f"password={code(18, '0123456789abcdef')}", f"api_key: {code(24, 'ABCabc0123xyzXYZ')}")))
        if k % 2:
            words.insert(rng.randrange(30), rng.choice(("call 555-0100", "on 2024-05-06", "costs 12.50", "room 42", "10.0.0.1:80", "ratio: 3")))
        texts.append(" ".join(words))
    return texts


def planted_secrets():
    """Secrets that no pattern covers, (text, start, length), and texts with what looks like them."""
    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    code = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets, clean = [], []
    for _ in range(150):
        x = rng.choice((code(36, every), "ghp_" + code(36, every), code(40, every + "+/"), code(32, "0123456789ABCDEF"), "sk-" + code(40, every), code(30, every.lower() + "0123456789") + "A9"))
        before = " ".join([word() for _ in range(rng.randrange(4))] + ([rng.choice(("bearer", "credential", "private key is"))] if rng.random() < 0.5 else [word()])) + " "
        secrets.append((before + x + " " + word(), len(before), len(x)))
        y = rng.choice((f"{word()}.{word()}34@mail7.{word()}.com", "97.51.17.173", word().title() + word().title(), f"{word()}_{word()}_{word()}", f"https://{word()}.{word()}.org/{word()}/{word()}", "2024-05-06T07:08:09", word() + word() + word() + word(), "+1-555-010-2030", f"{word()}/{word()}/{word()}.html", "1,234,567.89"))
        clean.append(f"{word()} {word()} {y} {word()}")
    return secrets, clean


def test_secret_scan(spark):
    texts = [*(ODD[:-1]), *secret_texts()]
    docs = documents(spark, texts)
    model = secret_scan.fit(docs)
    rows = by_id(secret_scan.find(docs, model), "n_assign", "n_access", "n_hex", "spans")
    for t, (a, b, c, spans) in zip(texts, rows, strict=True):
        base = plain_base(t or "")
        assert [a, b, c] == [sum(k == x for _, k, _ in base) for x in range(3)]
        told = [s for s in spans.split(",") if s]
        assert [s for s in told if not s.startswith("crf")] == [f"{secret_scan.KINDS[k]}:{x}:{y}" for x, k, y in base]
        assert base or not told, (t, told)  # clean documents stay clean
    secrets, clean = planted_secrets()
    caught = [any(k == "crf" and a <= at and b >= at + n for a, k, b in secret_scan.scan(t, model)) for t, at, n in secrets]
    false = [t for t in clean if secret_scan.scan(t, model)]
    assert np.mean(caught) >= 0.9, [t for (t, _, _), c in zip(secrets, caught, strict=True) if not c][:5]
    assert len(false) <= 0.1 * len(clean), false[:5]
    # an assignment that no pattern covers, as its key word isn't among the patterns'
    found = secret_scan.scan("some credential = \"9f8e7d6c5b4a39281716f\" and words", model)
    assert found and secret_scan.redacted("é token=0123456789abcdef0123 end", model) == "é [SECRET] end"
    hidden = "the auth key: Zx81kQ0aLz8Rt5mN then words"
    assert [hidden[a:b] for a, k, b in secret_scan.scan(hidden, model) if k == "crf"] == ["Zx81kQ0aLz8Rt5mN"]


def test_secret_scan_without_training(spark):
    empty = documents(spark, [])
    model = secret_scan.fit(empty)
    assert secret_scan.find(empty, model).collect() == [] and secret_scan.scan("auth = A1b2C3d4E5f6G7h8", model) == []
    out = secret_scan.redact(spark.createDataFrame([(1, None, "k"), (2, "token=abcdefghijklmnop", "k")], "doc_id long, text string, spans string"), model)
    assert out.columns == ["doc_id", "text", "spans"] and [r["text"] for r in out.orderBy("doc_id").collect()] == [None, "[SECRET]"]


# -- toxicity


def toxic_tables(spark):
    rng = random.Random(10)
    texts, labels = [], []
    for k in range(1200):
        sentences = [" ".join(rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(6)) for _ in range(rng.randrange(1, 9))]
        bad = rng.random() < 0.2
        if bad:
            sentences[rng.randrange(len(sentences))] += rng.choice((" vile", " rotten", " Awful"))
        texts.append(". ".join(sentences) + ".")
        labels.append((k, int(bad)))
    labels += [(5000, 1), (None, 0), (3, None)]
    return texts, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    texts, labels = toxic_tables(spark)
    docs = documents(spark, [*texts, *ODD])
    model = toxicity.fit(docs, labels)
    assert set(model.weights) == {"vile", "rotten", "awful"}
    assert toxicity.distinct_signs([("rott~", (5, 1)), ("rotten", (5, 1)), ("rotte~", (5, 1)), ("lowe~", (9, 0)), ("lowei~", (9, 0)), ("loweian", (2, 0)), ("lott~", (5, 1))]) == ["rotten", "lowei~", "loweian", "lott~"]
    rows = by_id(toxicity.score(docs, model), "score", "offending")
    for t, (score, where) in zip([*texts, *ODD], rows, strict=True):
        bad = [w for w in ("vile", "rotten", "awful") if w in (t or "").lower()]
        assert 0 <= score <= 1 and (score >= 0.5) == bool(bad) == bool(where)
        assert all(any(w in s.lower() for w in bad) for s in where) and all(s in t for s in where)


def test_toxicity_is_noisy_or():
    model = toxicity.Model({"bad": 2.0, "worse": 1.5}, -1.0, -3.0)
    score, found = model.score("Bad one. Fine here. bad and WORSE!\nworse")
    p = [1 / (1 + math.exp(-z)) for z in (1.0, 2.5, 0.5)]
    assert score == pytest.approx(1 - (1 - 1 / (1 + math.exp(3))) * math.prod(1 - x for x in p)) and [z for z, _, _ in found] == [1.0, 2.5, 0.5]
    assert model.score("badly İ embadded")[1] == []
    stems = toxicity.Model({"rott~": 3.0, "rotten": 1.0}, -1.0, -3.0)
    assert [z for z, _, _ in stems.score("Rotting. rotten rotten rotted! rott")[1]] == [2.0, 3.0]


def test_toxicity_without_labels(spark):
    docs = documents(spark, ODD)
    for rows in ([], [(1, 0)], [(1, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert all(0 <= r[0] <= 1 for r in by_id(toxicity.score(docs, model), "score"))
    assert toxicity.score(documents(spark, []), model).collect() == []


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(~toxicity.learnable())
    right = found.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()[0]
    assert right > 0.9
