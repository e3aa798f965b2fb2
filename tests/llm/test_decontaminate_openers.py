"""Decontamination of short items: names that open sentences, and passages wherever they stand."""

import random
import unicodedata

import pytest

from tabulon.llm import decontaminate

TOM = "Tom has 5 apples. Tom buys 3 more. How many has Tom?"
RUNS = "Tom runs 5 miles. Mary runs 4 miles. Sue runs 2 miles. Who runs most?"


def found(spark, items, texts):
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark).collect()}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST, 0])
def test_names_that_open_sentences(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST", limit)
    anna = TOM.replace("Tom", "Anna").replace("5", "7").replace("3", "4")
    runs = RUNS.replace("Tom", "Bob").replace("Mary", "Ann").replace("Sue", "Eve").replace("5", "8").replace("4", "6").replace("2", "3")
    mixed = "Anna has 7 apples. Bert buys 4 more. How many has Carl?"
    assert found(spark, [TOM, RUNS], [anna, "Words before it. " + runs + " Words behind.", mixed, TOM.lower(), "Nobody has any apples. Some buy more."]) == {(0, 0), (1, 1), (3, 0)}


def test_every_position(spark):
    """Runs of 6 and 7 tokens that cover half of a short item, and two runs of 7 around a change, behind 0 to 7 other words."""
    words = "amber basil cedar daisy elder ferns grape hazel irises jasmine kelp lilac maple nettle olive".split()
    eight, fifteen = words[:8], words[:7] + ["changed"] + words[8:]
    texts = [" ".join([*["pad"] * k, *part, "end"]) for k in range(8) for part in (eight[:6], fifteen)]
    got = found(spark, [" ".join(eight), " ".join(words)], texts)
    assert got == {(2 * k + n, i) for k in range(8) for n, i in ((0, 0), (1, 0), (1, 1))}


def plain_tokens(text):
    blocks = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
    letter = lambda c: unicodedata.category(c)[0] in "LM"
    alone = lambda c: any(a <= ord(c) <= b for a, b in blocks)
    digit = lambda c: unicodedata.category(c) == "Nd"
    out, i = [], 0
    while i < len(text):
        j, c = i + 1, text[i]
        if letter(c):
            while not alone(c) and j < len(text) and letter(text[j]) and not alone(text[j]):
                j += 1
        elif digit(c):
            while j < len(text) and (digit(text[j]) or text[j] in ".," and j + 1 < len(text) and digit(text[j + 1])):
                j += 1
        elif c in ".!?。！？":
            while j < len(text) and text[j] in ".!?。！？":
                j += 1
        else:
            i = j
            continue
        out.append(text[i:j])
        i = j
    return out


def plain_template(tokens):
    out = []
    for k, t in enumerate(tokens):
        named = unicodedata.category(t[0]) == "Lu" and not (len(t) > 1 and unicodedata.category(t[1]) == "Lu")
        if unicodedata.category(t[0]) == "Nd":
            out.append("0")
        elif t[0] in ".!?。！？":
            out.append(".")
        elif k and out[-1] == "0" and t.lower() in decontaminate.UNITS:
            out.append("1")
        else:
            out.append(t.lower() if not named else "3" if not k or out[-1] == "." else "2")
    return out


def plain_windows(t):
    return [tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))] if t else []


def plain_leak(item, text):
    raw, own = plain_tokens(item), plain_tokens(text)
    t, marks = plain_template(raw), ("0", "1", "2", "3")
    found, total = [], 0
    for i, w in enumerate(plain_windows(t)):
        if all(x in (*marks, ".") for x in w):
            continue
        total += 1
        ways = {w, tuple("2" if x == "3" else x for x in w), tuple(raw[i + k].lower() if x == "3" else x for k, x in enumerate(w))}
        ways |= {(*w[:k], "3", *w[k + 1 :]) for k in range(len(w)) if w[k] == "2"}
        for p, d in enumerate(plain_windows(plain_template(own))):
            if d in ways:
                found.append((p - i, i, {("2" if x == "3" else x, raw[i + k], own[p + k]) for k, x in enumerate(w) if x in marks}))
    copies, last = [], None
    for hit in sorted(found, key=lambda h: h[:2]):
        if last is None or hit[0] - last > min(8, len(raw) // 2):
            copies.append([])
        copies[-1].append(hit)
        last = hit[0]

    def counts(hits):
        n, pairs = len({i for _, i, _ in hits}), set().union(*(s for _, _, s in hits))
        odd = sum(len({b for k, a, b in pairs if (k, a) == (kind, x)}) > 1 or kind == "2" and len({a for k, a, b in pairs if (k, b) == (kind, y)}) > 1 for kind, x, y in pairs)
        return (n >= 0.5 * total or n >= 9) and odd <= (1 - decontaminate.CONSISTENT) * len(pairs)

    return any(counts(c) or any(counts([h for h in c if h[0] == o]) for o in {h[0] for h in c}) for c in copies)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    """Whole, cut, mutated, renamed and re-numbered items at any offset, among others' pieces; null ids; scripts without spaces."""
    monkeypatch.setattr(decontaminate, "BROADCAST", limit)
    rng = random.Random(limit)
    words = [a + b for a in "bcdfg" for b in ("ale", "ine", "ock", "um", "ire")]
    names = ["Ann", "Bob", "Eve", "Tom", "Zoe"]

    def sentence(n):
        one = lambda: rng.choice(names) if rng.random() < 0.15 else f"{rng.randrange(90)} km" if rng.random() < 0.15 else rng.choice(words)
        return " ".join(one() for _ in range(n)).capitalize() + "."

    items = [" ".join(sentence(rng.randrange(3, 12)) for _ in range(rng.randrange(1, 4))) for _ in range(10)]
    items += ["北京是中国的首都城市", "two words", "1 2 3 4 5 6 7", "", None, TOM, RUNS]

    def changed(text):
        parts = text.split(" ")
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(parts))
            parts[k : k + rng.randrange(2)] = [rng.choice(words)] if rng.random() < 0.7 else []
            parts = parts or ["x"]
        text = " ".join(parts)
        if rng.random() < 0.5:
            a, b = rng.sample(names, 2)
            text = text.replace(a, b)
        return text.replace(str(rng.randrange(90)), str(rng.randrange(90)))

    texts = [*(x for x in items if x), "我们知道北京是中国的首都城市吗", "2 words", ""]
    for _ in range(120):
        item = rng.choice([x for x in items if x])
        texts.append(" ".join([sentence(rng.randrange(1, 7)), changed(item)[rng.randrange(9) :], *([changed(rng.choice([x for x in items if x]))] if rng.random() < 0.3 else []), sentence(rng.randrange(1, 9))]))
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if plain_leak(x or "", t)}
    assert found(spark, items, texts) == want and 60 < len(want) < 300
    nulls = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = sorted(r["text"] for r in decontaminate.without_leaks(nulls, benchmark).collect())
    assert kept == sorted(t for d, t in enumerate(texts) if not any(d == x for x, _ in want))
