"""Separator and quote by a head sample."""

from __future__ import annotations

from collections import Counter
from itertools import islice

from tabulon.sources.lexer import records
from tabulon.spec import OpenOptions

# Candidates in order of preference.
SEPARATORS, QUOTES = (",", ";", "\t", "|"), ('"', "'")
RECORDS = 256
MOST_FIELDS = 512


def score(sample: str, separator: str, quote: str) -> tuple[bool, bool, float, int]:
    """Whether the quote opens a field, whether records split, how many records have the modal number of fields, that number."""
    widths: Counter[int] = Counter()
    active = False
    for fields, opened, _ in islice(records([sample], separator, quote), RECORDS):
        widths[min(len(fields), MOST_FIELDS)] += 1
        active |= opened
    if not widths:
        return False, False, 0.0, 0
    mode, most = max(widths.items(), key=lambda x: (x[1], x[0]))  # the larger number on a tie
    return active, mode >= 2, most / widths.total(), mode


def sniff(sample: str, options: OpenOptions) -> tuple[str, str]:
    """(separator, quote): forced ones stay, the best pair of candidates otherwise, the earlier on ties."""
    separators = (options.separator,) if options.separator is not None else tuple(s for s in SEPARATORS if s != options.quote)
    quotes = (options.quote,) if options.quote is not None else tuple(q for q in QUOTES if q != options.separator)
    pairs = [(s, q) for s in separators for q in quotes]
    return pairs[0] if len(pairs) == 1 else max(pairs, key=lambda p: score(sample, *p))
