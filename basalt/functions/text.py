"""Canonical forms of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What `[\s\x{85}\p{Z}]` matches: white space of ASCII, the next-line control, and all separators of Unicode.
SPACE = "\t\n\x0b\f\r \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(SPACE))


def fold(c: Column) -> Column:
    return F.lower(trim(c))


def hostname(c: Column) -> Column:
    """Folded, and without one trailing dot."""
    folded = fold(c)
    return F.when(F.endswith(folded, F.lit(".")), F.left(folded, F.char_length(folded) - 1)).otherwise(folded)
