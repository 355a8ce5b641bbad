"""Byte-wise helpers for text and JSON, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(c: Column) -> Column:
    """UTF-8 bytes of text, or bytes of binary."""
    return F.octet_length(c)


def truncate_bytes(c: Column, limit: int) -> Column:
    """The longest start of text that has at most `limit` bytes in UTF-8 and ends with a whole character."""
    data = c.cast("binary")
    top = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")
    # Back off while the byte after the cut continues a character; one has four bytes at most.
    cut = F.lit(limit)
    for back in (3, 2, 1):
        inside = F.lit(True)
        for b in range(back):
            inside = inside & top(F.lit(limit + 1 - b)).between(0x80, 0xBF)
        cut = F.when(inside & (cut == limit) & F.lit(limit >= back), F.lit(limit - back)).otherwise(cut)
    short = F.decode(F.substring(data, F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(c) <= limit, c).otherwise(short)


def format_json(c: Column) -> Column:
    """JSON text in one form: keys sorted, no spaces; null where it is not JSON."""
    return F.to_json(F.try_parse_json(c))


def truncate_json(c: Column, limit: int) -> Column:
    """JSON text if it has at most `limit` bytes, else null: a cut would not be JSON."""
    held = format_json(c)
    return F.when(F.octet_length(held) <= limit, held)
