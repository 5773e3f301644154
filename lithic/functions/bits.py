"""Bit fields of image records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned(b: Column, at: int | Column, size: int) -> Column:
    """A little-endian unsigned number of 1, 2 or 4 bytes of a binary column, null beyond its end."""
    digits = F.concat(*[F.hex(F.substring(b, at + k + 1, 1)) for k in reversed(range(size))])
    return F.when(F.octet_length(b) >= at + size, F.conv(digits, 16, 10).cast("long"))


def signed32(raw: Column) -> Column:
    """The signed reading of the low 32 bits of a number."""
    low = raw.bitwiseAND(0xFFFFFFFF)
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def small_string(raw: Column) -> tuple[Column, Column, Column]:
    """(is_utf16, offset, length) of an entry of the string table; length 255 points to the overflow table."""
    return raw.bitwiseAND(1) == 1, F.shiftright(raw, 1).bitwiseAND(0x7FFFFF), F.shiftright(raw, 24).bitwiseAND(0xFF)


def options(raw: Column, version: Column) -> tuple[Column, Column, Column]:
    """(static_builtins, cjs_resolved, has_async); the last is unknown from version 98 on."""
    return raw.bitwiseAND(1) == 1, raw.bitwiseAND(2) == 2, F.when(version < 98, raw.bitwiseAND(4) == 4)
