"""Small column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the characters that Unicode counts as white space
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """``c`` without white space at its ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def squeezed(c: Column, also: str = "") -> Column:
    """``c`` without any white space or any character of ``also``."""
    return F.translate(c, WHITE_SPACE + also, "")


def base64_text(c: Column) -> Column:
    """Bytes as base64 in one line, whatever their length."""
    return F.translate(F.base64(c), "\r\n", "")
