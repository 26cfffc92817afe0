"""Content keys and byte forms of dictionary entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    """SHA-256 content key as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def entry_bytes(text: Column) -> Column:
    """Export form of a dictionary entry: 16-bit length, then the UTF-8 bytes."""
    head = F.unhex(F.lpad(F.hex(F.octet_length(text)), 4, "0"))
    return F.concat(head, text.cast("binary"))


def big_endian(value: Column, width: int = 8) -> Column:
    """Hexadecimal text of an integer in ``width`` bytes, two's complement."""
    return F.substr(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(17 - 2 * width))


def from_big_endian(payload: Column, start: int | Column, width: int = 8) -> Column:
    """Signed integer read from ``width`` bytes of a payload, 1-based start."""
    position = F.lit(start) if isinstance(start, int) else start
    number = F.conv(F.hex(F.substr(payload, position, F.lit(width))), 16, -10).cast("bigint")
    if width == 8:
        return number
    return F.when(number >= (1 << (8 * width - 1)), number - (1 << (8 * width))).otherwise(number)
