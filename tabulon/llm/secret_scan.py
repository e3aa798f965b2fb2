"""Secret scan: fixed patterns, and a linear-chain conditional random field that tags further tokens.

*Base spans.* Three patterns (assignment, access key, hex run), leftmost and non-overlapping each; matches that are too short
are dropped. Offsets are code points, ends exclusive; an assignment's span is its whole match.

*Tagger.* A line's tokens are tagged outside, begin or inside. Emission features: the token's shape, length class, mix of
letters and digits and share of distinct characters; shapes of the two tokens before and the one after, the words before and
after (hashed), a key word among the three before; and of the file how many assignments it has and whether it holds key words.
Weights are trained here by maximum likelihood (forward-backward, full-batch Adam); Viterbi decodes. Labels are the base spans
of a bounded sample of documents. So that the tagger learns what secrets look like and not the patterns over again, each span is
also shown with its value replaced by random text of another alphabet, with and without its context (key word, assignment,
neighbours); and words of the same files joined to identifiers, paths and addresses are shown as what is no secret.

A token can only be tagged if it has 8 characters and a digit or a capital after a small letter, or 20 characters, or follows an
assignment mark or key word by one or two tokens; others are outside by definition of the chain. So the path between them is
found segment by segment, exactly, and lines without such a token are skipped. Tagged runs that overlap no base span are added
with kind ``crf``; base spans always stay.

Null texts count as empty and have no spans; texts are scanned whole. Repeated rows get equal results, an empty table none;
where no sampled text has a base span nothing is tagged. Input columns named like the new ones give way to them.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import append_columns, bound_batches, hash_share, written

# The base patterns and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex")

KEYWORD = re.compile(r"password|passwd|secret|token|api_?key|credential|private|access_?key|auth|bearer|(?:^|_)key$", re.A | re.I)
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]*[A-Za-z0-9+/_]=*|[^\sA-Za-z0-9]|[^\s]", re.A)
#: Every line that has a token which can be tagged is found by one of these.
ASKS = re.compile(r"[0-9=:]|[a-z][A-Z]|(?<!\S)\S{20}")
CUES = re.compile(r"password|passwd|secret|token|key|credential|private|auth|bearer", re.A | re.I)
INNER = re.compile(r"[a-z][A-Z]")
LEAST_OPEN, LONG_OPEN = 8, 20
#: Documents that are looked at for training, expected numbers of training documents with and without base spans, and of tokens
#: that one document adds at most.
LOOKED_AT, WITH_SPANS, WITHOUT_SPANS, TOKENS_EACH = 60_000, 500, 700, 1000
STEPS, RATE, RIDGE = 150, 0.15, 1e-3
OUT, BEGIN, IN = range(3)
SHAPES = ("edge", "lower", "title", "upper", "letters", "number", "hex", "upper_digits", "mixed", "dotted", "assign", "quote", "mark", "keyword")
LENGTHS = (4, 8, 12, 16, 24, 40)
N_SHAPE, N_LENGTH, N_MIX, N_VARIED, N_WORD, N_FILE = len(SHAPES), len(LENGTHS) + 1, 4, 5, 64, 8
#: Feature offsets: bias, shape, length, both, mix, distinct characters with shape, shapes before (2) and after (1), key word
#: before, word before, word after, file.
OFFSETS = np.cumsum([0, 1, N_SHAPE, N_LENGTH, N_SHAPE * N_LENGTH, N_MIX, N_SHAPE * N_VARIED, N_SHAPE, N_SHAPE, N_SHAPE, 2, N_WORD, N_WORD, N_FILE])
N_FEATURES = int(OFFSETS[-1])
# Alphabets of the values that stand in for those of base spans.
ALPHABETS = ("0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start and then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def shape(token: str) -> int:
    if token in "=:":
        return SHAPES.index("assign")
    if token in "\"'`":
        return SHAPES.index("quote")
    if not token[0].isalnum() and len(token) == 1:
        return SHAPES.index("mark")
    if len(token) < 16 and KEYWORD.search(token):
        return SHAPES.index("keyword")
    if not any(c.isdigit() for c in token):
        return SHAPES.index("lower" if token.islower() else "title" if token.istitle() else "upper" if token.isupper() else "letters")
    body = token.strip(".=-")
    if body.isdigit():
        return SHAPES.index("number")
    if re.fullmatch(r"[0-9a-f]+", body):
        return SHAPES.index("hex")
    if re.fullmatch(r"[0-9A-Z]+", body):
        return SHAPES.index("upper_digits")
    return SHAPES.index("dotted" if re.fullmatch(r"[0-9.:/_+-]+", body) else "mixed")


def mix(token: str) -> int:
    """How often letters and digits alternate, a sign of random strings."""
    kinds = [c.isdigit() for c in token if c.isalnum()]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    return min(N_MIX - 1, turns * 8 // max(1, len(kinds)))


def varied(token: str) -> int:
    """How many different characters the token has for its length; random text has many."""
    n = len(token)
    return 0 if n < 12 else 1 + min(3, int(8 * len(set(token)) / min(n, 24)) // 2)


def word_bucket(token: str) -> int:
    """0 for what isn't a plain word."""
    return 1 + zlib.crc32(token.lower().encode()) % (N_WORD - 1) if token.isalpha() else 0


EDGE, KEYWORD_SHAPE, ASSIGN_SHAPE, LOWER_SHAPE = (SHAPES.index(x) for x in ("edge", "keyword", "assign", "lower"))


def can_be_tagged(token: str) -> bool:
    """By itself; a token that follows a key word or an assignment mark can be in any case."""
    n = len(token)
    return n >= LONG_OPEN or n >= LEAST_OPEN and (any(c.isdigit() for c in token) or INNER.search(token) is not None)


def features(tokens: list[str], file: int) -> tuple[list[tuple[int, ...] | None], list[bool]]:
    """Of each token its active features (None for a plain one), and whether it is plain."""
    shapes = [shape(t) for t in tokens]
    around = [EDGE, EDGE, EDGE, *shapes, EDGE]
    rows, plain = [], []
    for k, token in enumerate(tokens):
        before3, before2, before, own, after = around[k : k + 5]
        cued = KEYWORD_SHAPE in (before, before2) or ASSIGN_SHAPE in (before, before2)
        plain.append(not cued and not can_be_tagged(token))
        if plain[-1]:
            rows.append(None)
            continue
        length = sum(len(token) >= x for x in LENGTHS)
        named = KEYWORD_SHAPE in (before, before2, before3)
        ahead, behind = word_bucket(tokens[k - 1]) if k else 0, word_bucket(tokens[k + 1]) if k + 1 < len(tokens) else 0
        parts = (0, own, length, own * N_LENGTH + length, mix(token), own * N_VARIED + varied(token), before, before2, after, int(named), ahead, behind, file)
        rows.append(tuple(int(o) + p for o, p in zip(OFFSETS, parts, strict=False)))
    return rows, plain


def file_bucket(text: str) -> int:
    """Assignments of the file (none, one, some, many) and whether it holds a key word."""
    n = text.count("=")
    return (0 if not n else 1 if n == 1 else 2 if n < 8 else 3) * 2 + (KEYWORD.search(text) is not None)


@dataclass
class Model:
    emission: np.ndarray  #: feature, label
    transition: np.ndarray  #: label, next label

    def decode(self, rows: list[tuple[int, ...]]) -> list[int]:
        """Viterbi over one segment; outside lies on both sides."""
        scores = self.emission[np.array(rows)].sum(axis=1)
        best, back = scores[0] + self.transition[OUT], []
        for s in scores[1:]:
            step = best[:, None] + self.transition
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + s
        at = int((best + self.transition[:, OUT]).argmax())
        path = [at]
        for b in reversed(back):
            at = int(b[at])
            path.append(at)
        return path[::-1]


def untrained() -> Model:
    emission = np.zeros((N_FEATURES, 3))
    emission[0, OUT] = 1.0
    return Model(emission, np.array([[0, 0, -1e4], [0, -1e4, 0], [0, -1e4, 0.0]]))


def segments(text: str):
    """Runs of tokens that can be tagged, line by line: (features, spans)."""
    if not (ASKS.search(text) or CUES.search(text)):
        return
    file, at = file_bucket(text), 0
    for line in text.split("\n"):
        if ASKS.search(line) or CUES.search(line):
            found = [(m.start() + at, m.end() + at) for m in TOKEN.finditer(line)]
            rows, plain = features([text[a:b] for a, b in found], file)
            start = None
            for k in range(len(found) + 1):
                if k < len(found) and not plain[k]:
                    start = k if start is None else start
                elif start is not None:
                    yield rows[start:k], found[start:k]
                    start = None
        at += len(line) + 1


def variants(text: str, base: list[tuple[int, int, int]], rng: random.Random):
    """(line, spans of secrets in it) made from a text's base spans and words, for training: values of other alphabets within
    their context and among plain words; and joined words that are no secrets."""
    words = [w for w in re.findall(r"[A-Za-z]{2,12}", text[:4000])] or ["word"]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    for start, _, end in base[:2]:
        low = text.rfind("\n", 0, start) + 1
        high = text.find("\n", end)
        low, high = max(low, start - 200), min(len(text) if high < 0 else high, end + 200)
        value = max(re.finditer(r"[A-Za-z0-9+/_.-]+", text[start:end]), key=lambda m: len(m[0]))
        a, b = start + value.start(), start + value.end()
        for alphabet in ALPHABETS:
            made = "".join(rng.choice(alphabet) for _ in range(rng.choice((16, 20, 24, 32, 36, 40, 48))))
            yield text[low:a] + made + text[b:high], [(a - low, 0, a - low + len(made))]
            before, behind = " ".join(some(rng.randrange(4))), " ".join(some(rng.randrange(4)))
            line = f"{before} {made} {behind}"
            yield line, [(len(before) + 1, 0, len(before) + 1 + len(made))]
            key = rng.choice(("password is", "the secret", "auth", "private key", "credential", "bearer"))
            yield f"{before} {key} {made} {behind}", [(len(before) + len(key) + 2, 0, len(before) + len(key) + 2 + len(made))]
    titles = "".join(w.title() for w in some(rng.randrange(2, 5)))
    number = lambda n: str(rng.randrange(10**n))
    none = (
        titles, titles[:1].lower() + titles[1:], "_".join(some(3)).lower(), "-".join(some(4)).lower(), "/".join(some(4)).lower(), ".".join(some(3)).lower(), "".join(some(4)).lower(),
        f"{'_'.join(some(2))}_{number(3)}", f"{'/'.join(some(3))}/{number(6)}.html", f"{rng.choice(words)}{number(3)}.{rng.choice(words)}.com", f"v{number(1)}.{number(2)}.{number(2)}",
        number(10), f"{number(3)}-{number(4)}-{number(4)}", f"20{number(2)}-1{rng.randrange(3)}-0{rng.randrange(1, 10)}T0{rng.randrange(10)}:30:00", f"{number(2)}.{number(3)}.{number(3)}.{number(1)}", f"{number(3)},{number(3)},{number(3)}",
    )
    for x in none:
        yield " ".join([*some(rng.randrange(4)), x, *some(rng.randrange(4))]), []
        yield f"{rng.choice(words)} = {x}", []


def labels_of(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """Begin and inside for tokens that end within a base span and hold at least 8 characters of it."""
    out, last = [], None
    for a, b in spans:
        hit = next((k for k, (s, _, e) in enumerate(base) if b > s and a < e and min(b, e) - max(a, s) >= 8 and b <= e + 2), None)
        out.append(OUT if hit is None else IN if hit == last else BEGIN)
        last = hit
    return out


def extra_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int]]:
    out = []
    for rows, spans in segments(text):
        run = None
        for (a, b), label in zip([*spans, (0, 0)], [*model.decode(rows), OUT], strict=True):
            if run and label != IN:
                out.append(tuple(run))
                run = None
            if label == BEGIN:
                run = [a, b]
            elif label == IN and run:
                run[1] = b
    return [(a, b) for a, b in out if not any(a < e and b > s for s, _, e in base)]


def train(chains: list[tuple[list[tuple[int, ...]], list[int]]], weights_of: list[int] | None = None) -> Model:
    """Maximum likelihood by forward-backward over padded chains, all at once; a chain counts as the root of its weight."""
    model = untrained()
    if not any(label for _, y in chains for label in y):
        return model
    longest = max(len(y) for _, y in chains)
    n, width = len(chains), len(chains[0][0][0])
    x, y, real = np.zeros((n, longest, width), np.int32), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for k, (rows, labels) in enumerate(chains):
        x[k, : len(rows)], y[k, : len(rows)], real[k, : len(rows)] = rows, labels, True
    lengths = real.sum(axis=1)
    times = np.ones(n) if weights_of is None else np.sqrt(np.array(weights_of, float))
    allowed = model.transition > -1e3
    weights = [np.zeros((N_FEATURES, 3)), np.zeros((3, 3))]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    flat = x[real].ravel()
    for step in range(1, STEPS + 1):
        emission, transition = weights[0], np.where(allowed, weights[1], -1e4)
        score = emission[x].sum(axis=2)
        forward, backward = np.zeros((longest, n, 3)), np.zeros((longest, n, 3))
        forward[0] = score[:, 0] + transition[OUT]
        for t in range(1, longest):
            forward[t] = lse(forward[t - 1][:, :, None] + transition, 1) + score[:, t]
        ends = transition[:, OUT]
        for t in range(longest - 1, -1, -1):
            if t < longest - 1:
                backward[t] = lse(transition[None] + (score[:, t + 1] + backward[t + 1])[:, None, :], 2)
            backward[t][lengths == t + 1] = ends
        z = lse(forward[lengths - 1, np.arange(n)] + ends, 1)
        wish = np.zeros((n, longest, 3))
        marginal = np.exp(np.clip(forward + backward - z[None, :, None], -60, 0)).transpose(1, 0, 2)
        np.put_along_axis(wish, y[:, :, None], 1.0, axis=2)
        wish, marginal = wish * times[:, None, None], marginal * times[:, None, None]
        gap = np.repeat((wish - marginal)[real], width, axis=0)
        g_emission = np.stack([np.bincount(flat, weights=gap[:, c], minlength=N_FEATURES) for c in range(3)], axis=1)
        g_transition = np.zeros((3, 3))
        for t in range(1, longest):
            on = real[:, t]
            pair = forward[t - 1][on][:, :, None] + transition + (score[on, t] + backward[t][on])[:, None, :] - z[on][:, None, None]
            g_transition -= (np.exp(np.clip(pair, -60, 0)) * times[on][:, None, None]).sum(axis=0)
            np.add.at(g_transition, (y[on, t - 1], y[on, t]), times[on])
        last = np.arange(n), lengths - 1
        np.add.at(g_transition, (np.zeros(n, int), y[:, 0]), times)
        g_transition[OUT] -= marginal[:, 0].sum(axis=0)
        np.add.at(g_transition, (y[last], np.zeros(n, int)), times)
        g_transition[:, OUT] -= marginal[last].sum(axis=0)
        for w, g, m in zip(weights, (g_emission, g_transition), moments, strict=True):
            g = g / times.sum() - RIDGE * w
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            w += RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Model(weights[0], np.where(allowed, weights[1], -1e4))


def chains_of(text: str, base: list[tuple[int, int, int]]):
    """(features, labels) of each segment, cut where it grows long and the token is outside."""
    for rows, spans in segments(text):
        labels, start = labels_of(spans, base), 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or k - start >= 32 and labels[k] == OUT:
                yield rows[start:k], labels[start:k]
                start = k


def fit(docs: DataFrame, text_col: str = "text", with_spans: int = WITH_SPANS, without_spans: int = WITHOUT_SPANS, looked_at: int = LOOKED_AT) -> Model:
    """Trains on about ``with_spans`` distinct texts with base spans and ``without_spans`` others that have tokens to tag, out of
    about ``looked_at`` texts taken by a hash, so that the corpus isn't searched twice; a text gives chains of up to
    ``TOKENS_EACH`` tokens and as many made from it. Only their features and labels reach the driver."""
    bound_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    n = docs.count()
    some = docs.where(text.isNotNull() & (hash_share("secrets", text_col) < looked_at / max(1, n) * (1 << 20))).select(text.alias("text"))
    has = F.col("text").rlike(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    asks = F.col("text").rlike("[0-9=:]")
    some = written(some.where(asks | has).withColumn("has", has).distinct(), "secret-sample")
    n_has, n_asks = some.agg(F.count(F.when(F.col("has"), 1)), F.count(F.when(~F.col("has"), 1))).first()
    if not n_has:
        return untrained()
    share = F.when(F.col("has"), with_spans / n_has).otherwise(without_spans / max(1, n_asks)) * (1 << 20)
    taken = some.where(hash_share("chains", "text") < share).select(F.xxhash64("text").alias("id"), "text")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("y", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, count, rng = base_spans(t), 0, random.Random(i)
                for rows, labels in chains_of(t, base):
                    if count < TOKENS_EACH:
                        out.append((i, len(out), [f for r in rows for f in r], labels))
                        count += len(labels)
                for line, spans in variants(t, base, rng):
                    for rows, labels in chains_of(line, spans):
                        out.append((i, len(out), [f for r in rows for f in r], labels))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=["id", "at", "x", "y"])

    got = taken.mapInArrow(run, schema).toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"], r["at"]))
    # equal chains are one, weighted by the root of their number
    counts = Counter((tuple(r["x"]), tuple(r["y"])) for r in got)
    width = len(OFFSETS) - 1
    return train([(np.array(x).reshape(-1, width).tolist(), list(y)) for x, y in counts], list(counts.values()))


def scan(text: str | None, model: Model) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans by start, then kind as listed; ``crf`` comes last."""
    text = text or ""
    base = base_spans(text)
    spans = [*base, *((a, len(KINDS), b) for a, b in extra_spans(text, base, model))]
    return [(a, (*KINDS, "crf")[k], b) for a, k, b in sorted(spans)]


FIELDS = (("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()))


def find(docs: DataFrame, model: Model, text_col: str = "text", keep=None) -> DataFrame:
    """Counts, the base spans' digest and all spans (``kind:start:end`` joined by commas), beside ``keep`` (all columns by default)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        told = lambda spans: ",".join(f"{k}:{a}:{b}" for a, k, b in spans)

        def kernel(texts):
            rows = []
            for t in texts:
                spans = scan(t, shared.value)
                base = [s for s in spans if s[1] != "crf"]
                rows.append((*(sum(s[1] == k for s in base) for k in KINDS), hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
            return list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)

        return kernel

    return append_columns(docs, [text_col], make, FIELDS, keep)


def redacted(text: str | None, model: Model, mark: str = "[SECRET]") -> str | None:
    if not text:
        return text
    out, at = [], 0
    for a, _, b in scan(text, model):
        if b > at:
            out += [text[at:a], mark] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``[SECRET]``; overlapping spans become one mark."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = append_columns(docs, [text_col], lambda: lambda texts: ([redacted(t, shared.value) for t in texts],), [(text_col, T.StringType())])
    return out.select(*docs.columns)
