"""Repeatable divisions of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def is_calibration(key: str, seed: int = 18) -> Column:
    """True for a fifth of the rows, by another hash of ``key``."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(5)) == 0
