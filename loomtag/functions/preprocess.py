"""Bytes to clean UTF-8 text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def detect_encoding(data: Column) -> Column:
    """utf16_le, utf16_be or utf8, by the byte order mark."""
    two = F.hex(F.substring(data.cast("binary"), 1, 2))
    return F.when(two == "FFFE", "utf16_le").when(two == "FEFF", "utf16_be").otherwise("utf8")


def to_utf8(data: Column, encoding: str | None = None) -> Column:
    """Text of a binary column. Without ``encoding`` the byte order mark decides and is removed."""
    b = data.cast("binary")
    names = {"utf8": "UTF-8", "utf16_le": "UTF-16LE", "utf16_be": "UTF-16BE"}
    if encoding is not None:
        return F.decode(b, names[encoding])
    two, three = F.substring(b, 3, 1 << 30), F.substring(b, 4, 1 << 30)
    kind = detect_encoding(data)
    marked = F.hex(F.substring(b, 1, 3)) == "EFBBBF"
    return F.when(kind == "utf16_le", F.decode(two, "UTF-16LE")).when(kind == "utf16_be", F.decode(two, "UTF-16BE")).when(marked, F.decode(three, "UTF-8")).otherwise(b.cast("string"))


def line_endings(text: Column) -> Column:
    """CR LF and lone CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def preprocess(data: Column) -> Column:
    return line_endings(to_utf8(data))
