"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A sentence is what ends with ``.``, ``!``, ``?`` or a line's end. Its score is a logistic function of the vocabulary's words and
word beginnings that it holds (each once; beginnings stand for stems with many endings); a document's is 1 - product(1 - sentence scores), so the document labels alone train the sentence scores,
and the sentences over the threshold are where a document offends. The vocabulary is what best tells labelled documents apart
by a signed log-likelihood ratio; what gets little weight in one training is left out of the next, as many weak signs would
add up over a long document. A sentence without a vocabulary word adds nothing; documents without
any, empty and null ones among them, keep the prior score of a bare document.

Very long documents have many sentences; each adds its own chance, and all are scored, in time linear in the text. Repeated rows
get equal results, an empty table none; of an id with several texts one is learned from. Input columns named like the new ones
give way to them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import append_columns, bound_batches, hash_share, split_of, written

#: Expected number of labelled documents to learn from, and the most words of the vocabulary.
LABELLED = 16_000
WORDS = 2048
LEAST_DOCS = 4
#: The least log-likelihood ratio of a word in the vocabulary (chance exceeds it about once in 10**5).
LEAST_RATIO = 15.0
STEPS, RATE, RIDGE = 300, 0.1, 0.1
#: Lengths of word beginnings, and the least weights that are kept from one training to the next.
STEMS = (4, 5, 6)
KEPT = (0.5, 1.5, 2.5)
#: Logit of a sentence before its signs: fixed, so that the signs carry all the evidence.
BIAS = -4.0
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
STOP = re.compile(r"[.!?\n]")
WORD = re.compile(r"[^\W_]+")


def signs(word: str) -> list[str]:
    """A word and its beginnings, which are marked by a character that no word has."""
    return [word, *(f"{word[:n]}~" for n in STEMS if len(word) > n)]


FIELDS = (("score", T.DoubleType()), ("offending", T.ArrayType(T.StringType())))


@dataclass
class Model:
    weights: dict[str, float]  #: word -> weight
    bias: float  #: of a sentence with a vocabulary word
    bare: float  #: logit of a document without any

    def sentence_logits(self, text: str) -> list[tuple[float, int, int]]:
        """(logit, start, end) of each sentence with a vocabulary word."""
        low = text.lower()
        if len(low) != len(text):  # a few capitals grow when lower-cased; offsets are those of the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits = {w: own for w in set(WORD.findall(low)) if (own := [x for x in signs(w) if x in self.weights])}
        if not hits:
            return []
        stops, out = [0, *(m.end() for m in STOP.finditer(low))], []
        for at in sorted({m.start() for w in hits for m in re.finditer(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])", low)}):
            if out and at < out[-1][2]:
                continue
            k = bisect_right(stops, at)
            start, end = stops[k - 1], stops[k] if k < len(stops) else len(low)
            held = {x for w in WORD.findall(low[start:end]) for x in hits.get(w, ())}
            out.append((self.bias + sum(map(self.weights.__getitem__, sorted(held))), start, end))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int, int]]]:
        """The document's score and its sentences with vocabulary words."""
        found = self.sentence_logits(text) if text else []
        clean = -np.logaddexp(0.0, self.bare)
        for z, _, _ in found:
            clean -= np.logaddexp(0.0, z)
        return float(-np.expm1(clean)), found


def learnable(id_col: str = "doc_id") -> Column:
    return split_of(id_col, 5) != 0


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    labelled: int = LABELLED,
) -> Model:
    """Learns from about ``labelled`` labelled documents outside the held-out split, taken by a hash of the id.

    The sampled ids are broadcast (their number is bounded by the sample), so the documents are read without a shuffle. Word
    counts are made on the executors; the driver gets the best words, and the word sets of the sampled sentences.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(learnable(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y"))
    total = known.count()
    taken = known.where(hash_share("toxic", id_col) < min(1.0, labelled / max(1, total)) * (1 << 20)).groupBy(id_col).agg(F.max("y").alias("y"))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(taken), id_col)
    # an id may be repeated without bound; written, as it is read twice
    rows = written(rows.groupBy(id_col).agg(F.min("text").alias("text"), F.first("y").alias("y")), "labelled")

    def words(batches):
        for batch in batches:
            found: Counter = Counter()
            for t, y in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                # a document counts once under the empty word
                found.update((x, y) for x in {"", *(x for w in set(WORD.findall(t.lower())) for x in signs(w))})
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()), pa.array([*found.values()], pa.int64())], names=["word", "y", "n"])

    counts = rows.select("text", "y").mapInArrow(words, "word string, y int, n long").groupBy("word")
    number = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    counts = counts.agg(number(F.col("y") == 1).alias("toxic"), number(F.col("y") != 1).alias("clean"))
    counts = written(counts.where((F.col("word") == "") | (F.col("toxic") + F.col("clean") >= LEAST_DOCS)), "words")
    bags = counts.where("word = ''").first()
    pos, neg = (bags["toxic"], bags["clean"]) if bags else (0, 0)
    prior = float(np.log((pos + 0.5) / (neg + 0.5))) if pos + neg else -2.0
    if not pos or not neg:
        return Model({}, prior, prior)
    n = pos + neg
    expected = lambda share: (F.col("toxic") + F.col("clean")) * F.lit(share / n)
    part = lambda seen, want: F.when(seen > 0, seen * F.log(seen / want)).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), expected(pos)) + part(F.col("clean"), expected(neg)))
    best = counts.where("word != ''").withColumn("ratio", ratio).where((F.col("ratio") >= LEAST_RATIO) & (F.col("toxic") > expected(pos)))
    vocabulary = distinct_signs([(r["word"], (r["toxic"], r["clean"])) for r in best.orderBy(F.desc("ratio"), "word").limit(WORDS).collect()])
    index = {w: k for k, w in enumerate(vocabulary)}

    def instances(batches):
        for batch in batches:
            out = []
            for i, t, y in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                sentences = [s for m in SENTENCE.findall(t.lower()) if (s := sorted({index[x] for w in WORD.findall(m) for x in signs(w) if x in index}))]
                out.append((i, y, sentences))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.list_(pa.list_(pa.int32())))],
                names=["id", "y", "sentences"],
            )

    got = rows.select(F.col(id_col).cast("long").alias("id"), "text", "y").mapInArrow(instances, "id long, y int, sentences array<array<int>>")
    got = sorted(got.toArrow().to_pylist(), key=lambda r: r["id"])
    bags = [(r["y"] == 1, r["sentences"]) for r in got]
    model = train(vocabulary, bags, prior)
    for least in KEPT:
        kept = {k: n for n, k in enumerate(k for k, w in enumerate(vocabulary) if model.weights[w] >= least)}
        bags = [(y, [s for s in ([kept[w] for w in one if w in kept] for one in sentences) if s]) for y, sentences in bags]
        vocabulary = [vocabulary[k] for k in kept]
        model = train(vocabulary, bags, prior)
    return model


def distinct_signs(found: list[tuple[str, tuple[int, int]]]) -> list[str]:
    """Without the beginnings that stand in just the documents of a longer sign: they would share its weight and say no more."""
    by: dict[tuple[int, int], list[str]] = {}
    for sign, counts in found:
        by.setdefault(counts, []).append(sign)
    longer = lambda a, b: len(b.rstrip("~")) > len(a) - 1 and b.startswith(a[:-1])
    return [s for s, counts in found if not (s.endswith("~") and any(longer(s, other) for other in by[counts] if other != s))]


def train(vocabulary: list[str], bags: list[tuple[bool, list[list[int]]]], prior: float) -> Model:
    """Full-batch Adam on the noisy-or likelihood of the bags."""
    y = np.array([float(b) for b, _ in bags])
    sentence_bag = np.array([k for k, (_, ss) in enumerate(bags) for _ in ss], np.int64)
    word = np.array([w for _, ss in bags for s in ss for w in s], np.int64)
    owner = np.array([k for k, s in enumerate(s for _, ss in bags for s in ss) for _ in s], np.int64)
    n_words, n_sentences, n = len(vocabulary), len(sentence_bag), len(bags)
    if not n_words:
        return Model({}, prior, prior)
    theta = np.zeros(n_words + 2)
    theta[-2], theta[-1] = BIAS, prior - 2
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = theta[-2] + np.bincount(owner, weights=theta[word], minlength=n_sentences)
        clean = np.full(n, -np.logaddexp(0.0, theta[-1])) + np.bincount(sentence_bag, weights=-np.logaddexp(0.0, z), minlength=n)
        p_clean = np.clip(np.exp(clean), 1e-12, 1 - 1e-9)
        # d log-likelihood / d log(1 - p): 1 for clean bags, -(1 - p) / p for toxic ones
        slope = np.where(y > 0, -p_clean / (1 - p_clean), 1.0) / n
        by_sentence = slope[sentence_bag] * -1 / (1 + np.exp(-z))
        grad = np.zeros_like(theta)
        grad[:n_words] = np.bincount(word, weights=by_sentence[owner], minlength=n_words) - RIDGE / n * theta[:n_words]
        grad[-1] = (slope * -1 / (1 + np.exp(-theta[-1]))).sum()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model({w: float(x) for w, x in zip(vocabulary, theta, strict=False)}, float(theta[-2]), float(theta[-1]))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep=None) -> DataFrame:
    """``score`` and the ``offending`` sentences (those that alone reach a half) of every whole text, beside ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def kernel(texts):
            got = [shared.value.score(t) for t in texts]
            return [s for s, _ in got], [[t[a:b] for z, a, b in found if z >= 0] for t, (_, found) in zip(texts, got, strict=True)]

        return kernel

    return append_columns(docs, [text_col], make, FIELDS, keep)
