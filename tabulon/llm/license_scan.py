"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Templates and texts are lower-cased words; a shingle is ``SHINGLE`` words, or the whole of a template that has fewer. For each
template length windows of that many shingles begin every quarter of a window. A window is signed by the MinHash of its own
shingles, whether a template has them or not, and the signature is cut into ``BANDS`` bands of ``ROWS`` values; an equal band
retrieves a template. With shingle sets of Jaccard similarity s a band agrees with chance s ** ROWS, so a template goes
unretrieved with chance (1 - s ** ROWS) ** BANDS: at s = 0.53, which a window holding 0.8 of a template has at the least
favourable offset (an eighth of a window), under 10 ** -6 with the values below. A band can only agree if the window and the
template share the shingle that is least, so windows without any shingle of a template needn't be signed; that loses nothing.

A retrieved template is verified at the places around: containment is the share of its distinct shingles within the span of as many
shingles, slid word by word; a template counts with ``LEAST`` or more. Overlapping finds go to the largest containment, then the longest.

Null and empty texts hold no license. Texts are scanned whole, and every place of a template is reported. Repeated rows get equal
results, an empty table none. Input columns named like the new ones give way to them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabulon.llm.common import append_columns

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 96, 3
WORD = re.compile(r"[a-z0-9]+")
# Notices by which licenses are granted, as their texts or stewards recommend them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "This software is released under the BSD 2-Clause \"Simplified\" License."],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
TEMPLATES = {name: [*notices, f"SPDX-License-Identifier: {name}"] for name, notices in TEMPLATES.items()}
_RNG = np.random.default_rng(11)
FLIP, TIMES = (_RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(2))


@dataclass
class Template:
    name: str
    words: list[str]
    length: int  #: words of a shingle
    shingles: np.ndarray  #: numbers of its distinct shingles

    @property
    def spans(self) -> int:
        return len(self.words) - self.length + 1


def hashed(shingles: list[tuple[str, ...]]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(" ".join(s)) for s in shingles), np.uint64, len(shingles))


def signature(hashes: np.ndarray) -> list[tuple]:
    """The bands of a set of shingle hashes."""
    least = ((hashes[:, None] ^ FLIP) * TIMES).min(axis=0).reshape(BANDS, ROWS)
    return [(k, *row) for k, row in enumerate(least.tolist())]


class Scanner:
    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.number: dict[tuple[str, ...], int] = {}
        self.vocabulary: dict[str, int] = {}
        self.templates: list[Template] = []
        for name, notices in templates.items():
            for notice in notices:
                words = WORD.findall(notice.lower())
                if not words:
                    continue
                for w in words:
                    self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
                length = min(SHINGLE, len(words))
                found = [self.number.setdefault(tuple(words[k : k + length]), len(self.number)) for k in range(len(words) - length + 1)]
                self.templates.append(Template(name, words, length, np.unique(found)))
        by_number = list(self.number)
        self.bands: dict[tuple, set[int]] = {}
        for k, t in enumerate(self.templates):
            for band in signature(hashed([by_number[n] for n in t.shingles])):
                self.bands.setdefault(band, set()).add(k)
        self.sizes: dict[int, list[int]] = {}
        for t in self.templates:
            own = self.sizes.setdefault(t.length, [])
            if t.spans not in own:
                own.append(t.spans)

    def scan(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, license, containment) by start; offsets are code points."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = WORD.findall(low)
        ids = np.fromiter(map(self.vocabulary.get, words, iter(int, 1)), np.int32, len(words))
        found: list[tuple[float, int, int, int]] = []
        for length, sizes in self.sizes.items():
            found += self.of_length(words, ids, length, sizes)
        return self.resolved(found, low, words)

    def of_length(self, words: list[str], ids: np.ndarray, length: int, sizes: list[int]) -> list[tuple[float, int, int, int]]:
        """(containment, words, first word, template) of templates with shingles of ``length`` words."""
        last = len(words) - length
        if last < 0:
            return []
        known = np.flatnonzero(ids[: last + 1])
        for k in range(1, length):
            known = known[ids[known + k] > 0]
        places = {int(p): s for p in known if (s := self.number.get(tuple(words[p : p + length]))) is not None}
        if not places:
            return []
        where, found = np.array(sorted(places)), []
        for size in sizes:
            step = max(1, size // 4)
            begins = sorted({b for p in where.tolist() for b in range((p // step) * step, max(-1, p - size), -step) if b >= 0})
            candidates: dict[int, set[int]] = {}
            for b in begins:
                own = hashed([tuple(words[p : p + length]) for p in range(b, min(b + size, last + 1))])
                for band in signature(own):
                    for k in self.bands.get(band, ()):
                        if self.templates[k].spans == size and self.templates[k].length == length:
                            candidates.setdefault(k, set()).add(b)
            for k, at in candidates.items():
                found += self.verified(k, at, size, step, places, where)
        return found

    def verified(self, k: int, begins: set[int], size: int, step: int, places: dict[int, int], where: np.ndarray) -> list[tuple[float, int, int, int]]:
        """The best place around each retrieved window."""
        own, out = set(self.templates[k].shingles.tolist()), []
        for b in sorted(begins):
            best = (0.0, 0)
            for start in range(max(0, b - step), b + step + 1):
                low, high = np.searchsorted(where, [start, start + size])
                share = len(own.intersection(places[p] for p in where[low:high].tolist())) / len(own)
                best = max(best, (share, -start))
            if best[0] >= LEAST:
                out.append((best[0], size + self.templates[k].length - 1, -best[1], k))
        return out

    def resolved(self, found: list[tuple[float, int, int, int]], text: str, words: list[str]) -> list[tuple[int, int, str, float]]:
        if not found:
            return []
        ends = [m.span() for m in WORD.finditer(text)]
        taken: list[tuple[int, int]] = []  # by place, none over another
        out = []
        for share, size, first, k in sorted(set(found), key=lambda f: (-f[0], -f[1], f[2], f[3])):
            stop = min(first + size, len(words))
            at = bisect_left(taken, (first, stop))
            if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or taken[at][0] >= stop):
                taken.insert(at, (first, stop))
                out.append((ends[first][0], ends[stop - 1][1], self.templates[k].name, share))
        return sorted(out)


FIELDS = (("n_licenses", T.LongType()), ("licenses", T.StringType()), ("containment", T.DoubleType()), ("license_spans", T.StringType()))


def find(docs: DataFrame, text_col: str = "text", templates: dict[str, list[str]] | None = None, keep=None) -> DataFrame:
    """``n_licenses``, distinct ``licenses``, the largest ``containment`` and all spans of every whole text, beside ``keep``."""
    templates = TEMPLATES if templates is None else templates

    def make():
        scanner = Scanner(templates)

        def kernel(texts):
            got = [scanner.scan(t) for t in texts]
            return (
                [len(g) for g in got],
                [",".join(sorted({x[2] for x in g})) for g in got],
                [max((x[3] for x in g), default=0.0) for g in got],
                [",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in g) for g in got],
            )

        return kernel

    return append_columns(docs, [text_col], make, FIELDS, keep)
