"""Language identification by prediction by partial matching over bytes, under frozen statistics.

Each language has a context tree of order ``ORDER``: counts of the byte that follows each context of up to that many bytes.
A byte seen in a context is coded with c / (total + distinct) of it; otherwise the escape distinct / (total + distinct) is
paid and the next shorter context is asked, down to a uniform byte. With the statistics frozen, a byte's code length depends
on its window of ``ORDER`` + 1 bytes alone, so the trees become tables of windows: one row of bits a language. A window that
no language has seen costs its context's escapes plus the row of the window that is one byte shorter.

A text's code length in a language is the sum over all its bytes, the first ones in the context of line ends. The least
length wins (the first language in order on ties); the score is the winner's posterior under equal priors.

Null texts and texts without a letter (Unicode category L) are ``und`` with score 0, whatever their length; so is every text
where no language could be learned, as from an empty table or from empty texts alone. A text's result depends on itself and the
model, not on the texts beside it; repeated rows get equal results. Input columns named like the new ones give way to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import append_columns, bound_batches, hash_share, split_of

ORDER = 3
#: Expected number of training documents a language; a language with fewer gives all it has.
DOCS_PER_LANGUAGE = 1200
UND = "und"
PAD = b"\n" * ORDER
LETTER = regex.compile(r"\p{L}")
#: Bytes scored by one pass of array operations.
SLICE = 1 << 18


class Table:
    """Open-addressed map from window keys to row numbers; lookups are array operations."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int64)
        self.rows = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._hash(keys)
        while len(left):
            free = self.slots[at] < 0
            won, first = np.unique(at[free], return_index=True)
            rows = left[free][first]
            self.slots[won], self.rows[won] = keys[rows], rows
            lost = np.ones(len(left), bool)
            lost[np.flatnonzero(free)[first]] = False
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is absent."""
        at = self._hash(keys)
        held = self.slots[at]
        out = np.where(held == keys, self.rows[at], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.slots[at]
            hit = held == keys[left]
            out[left[hit]] = self.rows[at[hit]]
            more = ~hit & (held >= 0)
            left, at = left[more], at[more]
        return out


@dataclass
class Model:
    languages: list[str]
    windows: list[np.ndarray]  #: by order: the known windows
    bits: list[np.ndarray]  #: by order: bits of each window's last byte, a column a language
    contexts: list[np.ndarray]  #: by order: the known contexts
    escapes: list[np.ndarray]  #: by order: bits of the escape from each context
    docs: int

    def tables(self) -> tuple[list[Table], list[Table]]:
        return [Table(k) for k in self.windows], [Table(k) for k in self.contexts]


def keys_of(data: np.ndarray, order: int) -> np.ndarray:
    """Of each byte from ``order`` on: it and the ``order`` bytes before it, as one number."""
    out = np.zeros(len(data) - order, np.int64)
    for k in range(order + 1):
        out = (out << 8) | data[k : len(data) - order + k]
    return out


def window_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, window of ORDER + 1 bytes, and how often it occurs."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("window", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text.encode())
            for lang, texts in by.items():
                found = [keys_of(np.frombuffer(PAD + t, np.uint8), ORDER) for t in texts if t]
                if found:
                    keys, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n.astype(np.int64))], names=["lang", "window", "n"])

    return docs.select(text_col, lang_col).mapInArrow(run, schema).groupBy("lang", "window").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
) -> Model:
    """Statistics of the documents for which ``learn`` holds and text and language are known.

    Of each language about ``docs_per_language`` distinct texts are taken, by a hash of the text, so that repeated ids or rows
    don't add up; their windows are counted on the executors and the distinct ones come to the driver, so what arrives is bounded
    by the sample.
    """
    bound_batches(docs.sparkSession)
    known = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    totals = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not totals:
        return freeze({})
    share = F.create_map(*(F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, min(1.0, docs_per_language / n))))
    taken = known.where(hash_share("langid", text_col) < F.element_at(share, F.col(lang_col)) * (1 << 20))
    rows = window_counts(taken.select(text_col, lang_col).distinct(), text_col, lang_col).toArrow()
    langs, windows, n = (rows.column(c).to_numpy() for c in ("lang", "window", "n"))
    counts = {}
    for lang in sorted(totals):
        mine = langs == lang
        order = np.argsort(windows[mine])
        counts[lang] = (windows[mine][order], n[mine][order])
    return freeze(counts, sum(min(docs_per_language, x) for x in totals.values()))


def freeze(counts: dict[str, tuple[np.ndarray, np.ndarray]], docs: int = 0) -> Model:
    """counts: of each language, its sorted windows of ORDER + 1 bytes and their numbers."""
    counts = {lang: found for lang, found in counts.items() if len(found[0])}  # empty texts alone teach nothing
    languages = sorted(counts)
    model = Model(languages, [], [], [], [], docs)
    if not languages:
        return model
    below = None
    for order in range(ORDER + 1):
        mask = (1 << (8 * (order + 1))) - 1
        every = np.unique(np.concatenate([w & mask for w, _ in counts.values()]))
        contexts, context_of = np.unique(every >> 8, return_inverse=True)
        bits, escapes = np.zeros((len(every), len(languages))), np.zeros((len(contexts), len(languages)))
        shorter = below[np.searchsorted(model.windows[-1], every & (mask >> 8))] if order else np.full((len(every), len(languages)), 8.0)
        for k, lang in enumerate(languages):
            w, n = counts[lang]
            c = np.bincount(np.searchsorted(every, w & mask), weights=n, minlength=len(every))
            total = np.bincount(context_of, weights=c, minlength=len(contexts))
            distinct = np.bincount(context_of, weights=c > 0, minlength=len(contexts))
            known = total > 0
            escapes[known, k] = np.log2(total[known] + distinct[known]) - np.log2(distinct[known])
            seen = c > 0
            bits[:, k] = escapes[context_of, k] + shorter[:, k]
            bits[seen, k] = np.log2((total + distinct)[context_of[seen]]) - np.log2(c[seen])
        model.windows.append(every)
        model.bits.append(bits)
        model.contexts.append(contexts)
        model.escapes.append(escapes)
        below = bits
    return model


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.windows, self.contexts = model.tables()

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window, a column a language."""
        top = self.windows[ORDER].find(keys)
        out = self.model.bits[ORDER][top]
        left, cost = np.flatnonzero(top < 0), None
        if len(left):
            cost = np.zeros((len(left), len(self.model.languages)))
        for order in range(ORDER, -1, -1):
            if not len(left):
                break
            key = keys[left] & ((1 << (8 * (order + 1))) - 1)
            row = self.windows[order].find(key)
            hit = row >= 0
            out[left[hit]] = cost[hit] + self.model.bits[order][row[hit]]
            left, cost, key = left[~hit], cost[~hit], key[~hit]
            context = self.contexts[order].find(key >> 8)
            cost[context >= 0] += self.model.escapes[order][context[context >= 0]]
        if len(left):
            out[left] = cost + 8.0
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language. A text is cut from its begin into pieces of SLICE bytes, each summed on
        its own, so that no sum depends on the other texts."""
        out = np.zeros((len(texts), len(self.model.languages)))
        pieces = [(k, at) for k, t in enumerate(texts) for at in range(0, len(t), SLICE)]
        padded = {k: PAD + texts[k] for k, _ in pieces}
        low = 0
        while low < len(pieces):
            high, size = low, 0
            while high < len(pieces) and (high == low or size + len(texts[pieces[high][0]]) <= SLICE):
                size += len(texts[pieces[high][0]]) - pieces[high][1]
                high += 1
            parts = [padded[k][at : at + SLICE + ORDER] for k, at in pieces[low:high]]
            lengths = np.array([len(p) for p in parts])
            keys = keys_of(np.frombuffer(b"".join(parts), np.uint8), ORDER)
            # windows that reach over from one piece to the next belong to none
            ends = np.cumsum(lengths)
            own = np.ones(len(keys), bool)
            for gap in range(ORDER):
                own[(ends[:-1] - ORDER + gap)] = False
            firsts = np.concatenate([[0], np.cumsum(lengths - ORDER)[:-1]])
            sums = np.add.reduceat(self._rows(keys[own]), firsts, axis=0)
            for (k, _), row in zip(pieces[low:high], sums, strict=True):
                out[k] += row
            low = high
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score, and bits a byte in that language (8 where nothing is known)."""
        langs, scores, rates = [UND] * len(texts), [0.0] * len(texts), [8.0] * len(texts)
        ask = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.model.languages else []
        if ask:
            raw = [texts[i].encode() for i in ask]
            bits = self.bits(raw)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(ask)), best]
            score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            for i, b, s, m, t in zip(ask, best, score, least, raw, strict=True):
                langs[i], scores[i], rates[i] = self.model.languages[b], float(s), float(m) / len(t)
        return langs, scores, rates


FIELDS = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType()))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep=None) -> DataFrame:
    """``lang_pred``, ``score`` and ``bits_per_byte`` of every whole text, beside ``keep`` (all columns by default)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return Scorer(shared.value).predict

    return append_columns(docs, [text_col], make, FIELDS, keep)


def held_out_split(id_col: str = "doc_id") -> Column:
    """Documents that language models never learn from."""
    return split_of(id_col, 4) == 2
