"""Byte-level BPE with a given vocabulary: encoding by a contiguous rank array, and decoding.

A text is cut at special tokens, each part into words by the vocabulary family's pattern. A word's parts lie in one array
with the rank of every adjacent pair beside it; the least rank (the leftmost on ties) is merged, its boundary deleted and the
two neighbouring ranks refreshed, until no pair has a rank. Words over ``SHORT`` bytes take the same merges from a heap,
since repeated scans of a long array cost its square. Encoded words are kept in a bounded memo.

Nulls count as the empty text, which has no tokens. Any length of text is encoded whole. Repeated rows get equal results, an
empty table none. Input columns named like the new ones give way to them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from itertools import repeat

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabulon.llm.common import append_columns

SHORT = 256
#: Words held by a memo: the older half goes when the newer half is full.
MEMO = 1 << 19
NONE = 1 << 60
# The word pattern that this vocabulary format prescribes. White space is the Unicode property.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

# Letters and numbers that Unicode 16.0 added. The vocabulary's library classes characters by that version;
# Python's own data ends at an older one and the regex module's begins at a newer.
LETTERS_16 = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E "
    "11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF "
    "1E5D0-1E5ED 1E5F0-1E5F0"
)
NUMBERS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
RANGES_16 = [(k, *(int(x, 16) for x in r.split("-"))) for k, rs in (("\u00aa", LETTERS_16), ("\u00b2", NUMBERS_16)) for r in rs.split()]


def stand_in(c: str) -> str:
    """A character of the same class, for one that Python's Unicode data doesn't know."""
    if unicodedata.category(c) != "Cn":
        return c
    return next((k for k, a, b in RANGES_16 if a <= ord(c) <= b), "\u2603")


def words_of(text: str) -> list[str]:
    if not text or max(text) < "\u0500":
        return WORDS.findall(text)
    seen = "".join(map(stand_in, text))
    return WORDS.findall(text) if seen == text else [text[m.start() : m.end()] for m in WORDS.finditer(seen)]


def byte_letters() -> dict[int, str]:
    """The format's printable letter of each byte: printable Latin-1 as it is, the others from 256 up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """word -> its ids joined by commas. Bounded: two generations, and a word that is asked for again moves to the newer."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> str:
        if len(self) >= MEMO // 2:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        if out is None:
            out = self.encode(word)
        self[word] = out
        return out

    def forget(self) -> None:
        self.older = {}
        self.clear()


class Odd(Exception):
    """A piece between spaces that isn't sure to be cut alone as it is within the text."""


class Codec:
    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        pairs = [tuple(p) for p in pairs]
        self.rank_of = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.bytes_of = {str(i): bytes(back[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {str(i): content.encode() for content, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.decimal = [str(i) for i in range(len(vocab) + len(self.special))]
        self.words = Memo(self._ids)
        self.pieces = Memo(self._piece)

    def forget(self) -> None:
        """Workers outlive their tasks; what a task has memorised would else stay in their memory during other stages."""
        self.words.forget()
        self.pieces.forget()

    def word_ids(self, word: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in word]
        return self._scan(ids) if len(ids) <= SHORT else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        """ids: the parts between boundaries; ranks[i]: that of parts i and i + 1."""
        rank_of, made = self.rank_of.get, self.made
        ranks = list(map(rank_of, zip(ids, ids[1:], strict=False), repeat(NONE)))
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i] = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), NONE)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, *pair) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (rank := self.rank_of.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            least, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = self.made[least], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := self.rank_of.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (rank, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def _ids(self, word: str) -> str:
        return ",".join(map(self.decimal.__getitem__, self.word_ids(word.encode())))

    def _piece(self, piece: str) -> str:
        """Of a space and what follows up to the next space. Words never reach over a space that stands between two others."""
        if len(piece) < 2 or piece[1].isspace() or piece[-1].isspace():
            raise Odd
        if piece[1:].isalpha():  # letters alone are one word
            return self._ids(piece)
        return ",".join(map(self.words.__getitem__, words_of(piece)))

    def _part(self, text: str) -> str:
        first, *rest = text.split(" ")
        try:
            if not first or first[0].isspace() or first[-1].isspace():
                raise Odd
            head = ",".join(map(self.words.__getitem__, words_of(first)))
            return ",".join([head, *[self.pieces[" " + p] for p in rest]])
        except Odd:
            return ",".join(map(self.words.__getitem__, words_of(text)))

    def encode(self, text: str) -> str:
        """Decimal ids joined by commas."""
        if not text:
            return ""
        if self.cut is None or not any(s in text for s in self.special):
            return self._part(text)
        return ",".join(str(self.special[x]) if x in self.special else self._part(x) for x in self.cut.split(text) if x)

    def decode(self, ids: str) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_CODECS: dict[bytes, Codec] = {}


def codec_of(raw: bytes) -> Codec:
    """One a process and vocabulary: workers are used again by later tasks."""
    key = hashlib.sha1(raw).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return codec_of(f.read())


def shipped(docs: DataFrame, vocabulary: str):
    """The vocabulary file's bytes, read by the driver (a few MB, fixed) and broadcast: executors needn't have the file."""
    with open(vocabulary, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


FIELDS = (("ids", T.StringType()), ("n_tokens", T.LongType()), ("decoded", T.StringType()))
DIGESTS = (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep=None) -> DataFrame:
    """``ids`` (decimal, comma-joined), ``n_tokens`` and ``decoded`` of every text, beside ``keep`` (all columns by default)."""
    shared = shipped(docs, vocabulary)

    def make():
        code = codec_of(shared.value)

        def kernel(texts):
            ids = [code.encode(t or "") for t in texts]
            return ids, [x.count(",") + 1 if x else 0 for x in ids], [code.decode(x) for x in ids]

        kernel.close = code.forget
        return kernel

    return append_columns(docs, [text_col], make, FIELDS, keep)


def digests(docs: DataFrame, vocabulary: str, text_col: str = "text", keep=None) -> DataFrame:
    """The same, but only digests leave Python: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    shared = shipped(docs, vocabulary)

    def make():
        code = codec_of(shared.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def kernel(texts):
            n, of_ids, of_text = [], [], []
            for t in texts:
                ids = code.encode(t or "")
                n.append(ids.count(",") + 1 if ids else 0)
                of_ids.append(sha(ids))
                of_text.append(sha(code.decode(ids)))
            return n, of_ids, of_text

        kernel.close = code.forget
        return kernel

    return append_columns(docs, [text_col], make, DIGESTS, keep)


CHECKED = (("ids", T.StringType()), ("n_tokens", T.LongType()), ("round_trip", T.BooleanType()))


def encode_checked(docs: DataFrame, vocabulary: str, text_col: str = "text", keep=None) -> DataFrame:
    """``ids``, ``n_tokens``, and ``round_trip``: whether decoding the ids gives the text."""
    shared = shipped(docs, vocabulary)

    def make():
        code = codec_of(shared.value)

        def kernel(texts):
            ids = [code.encode(t or "") for t in texts]
            return ids, [x.count(",") + 1 if x else 0 for x in ids], [code.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]

        kernel.close = code.forget
        return kernel

    return append_columns(docs, [text_col], make, CHECKED, keep)
