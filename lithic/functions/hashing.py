"""Hashes with wrap-around arithmetic, as vectorised functions; SHA digests are Spark's own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK32, MASK64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def jenkins(text: str) -> int:
    """One-at-a-time hash over UTF-16 units."""
    h = 0
    data = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(data), 2):
        h = (h + (data[i] | data[i + 1] << 8)) & MASK32
        h = (h + (h << 10)) & MASK32
        h ^= h >> 6
    return h


def fnv1a(parts: list[bytes]) -> int:
    """FNV-1a over the parts, each followed by 0xff."""
    # The published offset basis and prime.
    h = 0xCBF29CE484222325
    for part in parts:
        for b in (*part, 0xFF):
            h = ((h ^ b) * 0x100000001B3) & MASK64
    return h


@F.pandas_udf(T.LongType())
def identifier_hash(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else jenkins(v)).astype("Int64")


@F.pandas_udf(T.StringType())
def ordered_digest(parts: pd.Series) -> pd.Series:
    return parts.map(lambda a: f"{fnv1a([(p or '').encode() for p in a]):016x}")


def file_key(content: Column) -> Column:
    return F.sha2(content, 256)


def footer_ok(content: Column) -> Column:
    """SHA-1 of all but the last 20 bytes equals these."""
    n = F.octet_length(content)
    return F.sha1(F.substring(content, F.lit(1), n - 20)) == F.lower(F.hex(F.substring(content, n - 19, F.lit(20))))
