"""Text functions as Spark columns: lines, trimming and positions as the analysis defines them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, ``(?U)\\s``.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(text, F.lit(SPACE))


def lines(src: Column) -> Column:
    """Array of lines: cut at line feeds, with one carriage return before each gone and no line after the last feed."""
    parts = F.split(src, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def byte_column(prefix: Column) -> Column:
    """One-based column behind a prefix, in bytes."""
    return F.octet_length(prefix) + 1


def split_lines(src: str) -> list[str]:
    """:func:`lines` in Python."""
    parts = src.split("\n")
    last = parts.pop()
    out = [p[:-1] if p.endswith("\r") else p for p in parts]
    return out + [last] if last else out
