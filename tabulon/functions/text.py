"""Text expressions: ASCII folding and trimming, byte caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"[\x09-\x0d\x20]"
_FOLD = str.maketrans(UPPER, LOWER)


def fold(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def fold_text(s: str) -> str:
    return s.translate(_FOLD)


def trim(c: Column) -> Column:
    """Without the ASCII white space (0x09-0x0D, 0x20) at both ends."""
    return F.regexp_replace(c, rf"\A{BLANK}+|{BLANK}+\z", "")


def trim_text(s: str) -> str:
    return s.strip("\t\n\x0b\x0c\r ")


def cell(c: Column) -> Column:
    """A cell's text: null is the empty string."""
    return F.coalesce(c, F.lit(""))


def cap(c: Column, most: int) -> Column:
    """(text, truncated): at most so many UTF-8 bytes, cut at a code point's start."""
    raw = c.cast("binary")
    follows = lambda at: F.hex(F.substring(raw, at + 1, 1)).between("80", "BF")
    cut = F.lit(most - 3)
    for at in (most - 2, most - 1, most):
        cut = F.when(~follows(at), at).otherwise(cut)
    long = F.octet_length(c) > most
    text = F.when(long, F.substring(raw, F.lit(1), cut).cast("string")).otherwise(c)
    return F.struct(text.alias("text"), long.alias("truncated"))


def cap_text(s: str, most: int) -> tuple[str, bool]:
    raw = s.encode()
    return (raw[:most].decode("utf-8", "ignore"), True) if len(raw) > most else (s, False)
