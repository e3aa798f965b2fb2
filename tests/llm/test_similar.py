"""Similar texts against all pairs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import similar


def plain_similar(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in (a, b)))
    return len(x & y) / len(x | y) >= 0.8


@pytest.mark.parametrize("rounds", [0, similar.ROUNDS])
def test_similar_texts(spark, monkeypatch, rounds):
    """A text changed at places apart, in groups and chains; texts that share a half; odd rows."""
    rng = random.Random(7)
    texts = []
    for k in range(12):
        words = [f"w{k}v{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(6):
            texts.append(" ".join(words))
            words[rng.randrange(200)] = "changed"
            words[rng.randrange(200)] = f"other{k}"
    common = " ".join(f"c{j}" for j in range(100))
    texts += [common + " " + " ".join(f"u{k}x{j}" for j in range(60)) for k in range(20)]
    rows = [*enumerate(texts), (900, None), (901, ""), (None, texts[0] + " end"), (None, "a text of its own without any id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    kept = [(r["doc_id"], r["text"]) for r in similar.without_similar(docs).collect()]
    part = {i: i for i in range(len(texts))}
    for i, j in itertools.combinations(range(len(texts)), 2):
        if plain_similar(texts[i], texts[j]) and part[i] != part[j]:
            low, high = sorted((part[i], part[j]))
            part = {k: low if v == high else v for k, v in part.items()}
    ids = {i for i, _ in kept if i is not None and i < 900}
    assert not any(plain_similar(texts[i], texts[j]) for i, j in itertools.combinations(sorted(ids), 2))
    assert {part[i] for i in ids} == set(part.values()) and set(part.values()) <= ids and len(ids) < len(texts)
    assert {(900, None), (901, ""), (None, rows[-1][1])} <= set(kept) and (None, texts[0] + " end") not in kept
    assert similar.without_similar(docs.limit(0)).count() == 0
    assert len(similar.band_keys("x " * 20000)[0]) == similar.BANDS and similar.band_keys("x " * 20000)[1] == 1
    one, other = (similar.band_keys(texts[k])[2] for k in (0, 3))
    df = spark.createDataFrame([(one, other), (one, one)], "a array<long>, b array<long>")
    plain = sum(x == y for x, y in zip(np.array(one).view(np.uint8), np.array(other).view(np.uint8), strict=True))
    assert [r[0] for r in df.select(similar.agreeing(F.col("a"), F.col("b"))).collect()] == [plain, similar.SKETCH]
