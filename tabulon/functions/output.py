"""Cells made safe for spreadsheets and framed as tab-separated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN_NUMBER = r"\A[+-][0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"


def neutralize(c: Column) -> Column:
    """A leading ``=`` or ``@`` always, ``+`` or ``-`` unless the whole is a plain number: an apostrophe goes before."""
    risky = c.rlike(r"\A[=@]") | (c.rlike(r"\A[+-]") & ~c.rlike(PLAIN_NUMBER))
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def tsv_quote(c: Column) -> Column:
    """Quoted if it holds a tab, line end or quote; inner quotes doubled."""
    return F.when(c.rlike("[\t\r\n\"]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def tsv_row(cells: list[Column]) -> Column:
    return F.concat_ws("\t", *(tsv_quote(neutralize(c)) for c in cells))
