"""Records of delimited text.

A quote opens a field only as its first character; a doubled quote is one; what follows the closing quote up to the next mark
is appended; elsewhere a quote is a character. LF, CRLF and CR end records, a blank line is one empty field, a last line end
adds no record, and an unclosed quote runs to the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache


@lru_cache(maxsize=64)
def field_pattern(separator: str, quote: str) -> re.Pattern:
    s, q = re.escape(separator), re.escape(quote)
    quoted = rf"(?:{q}((?:[^{q}]|{q}{q})*+)(?:{q}|\Z))?+" if quote else "()"
    return re.compile(rf"{quoted}([^{s}\r\n]*+)({s}|\r\n|\n|\r|\Z)", re.S)


def records(pieces: Iterable[str], separator: str, quote: str, open_quote: bool = False) -> Iterator[tuple[list[str], bool, int]]:
    """(fields, whether a quote opened one, characters) of each record. ``open_quote``: the text begins inside a quoted field.

    A record is given out once it is sure to be whole, so memory is one piece and the longest record.
    """
    find = field_pattern(separator, quote).finditer
    double = quote * 2
    held = quote if open_quote else ""
    pieces = iter(pieces)
    final = False
    while not final:
        piece = next(pieces, None)
        final = piece is None
        held += piece or ""
        if "\r" not in held and not (quote and quote in held):
            # nothing but separators and line feeds: most text of most files
            lines = held.split("\n")
            held = lines.pop()
            for line in lines:
                yield line.split(separator), False, len(line) + 1
            if final and held:
                yield held.split(separator), False, len(held)
            continue
        size, begin, fields, opened = len(held), 0, [], False
        for m in find(held):
            end = m.end()
            # a match that touches the end may go on in the next piece
            if end == size and not final:
                break
            body, rest, mark = m.groups()
            if m.start() == size and not fields:
                break  # nothing after the last line end
            if quote and body is not None:
                opened = True
                rest = (body.replace(double, quote) if double in body else body) + rest
            fields.append(rest)
            if mark != separator:
                yield fields, opened, end - begin
                fields, opened, begin = [], False, end
                if end == size:
                    break
        held = held[begin:]


def fitted(fields: list[str], width: int) -> list[str]:
    """Cut, or filled with empty strings, to the table's width."""
    n = len(fields)
    return fields if n == width else fields[:width] if n > width else fields + [""] * (width - n)
