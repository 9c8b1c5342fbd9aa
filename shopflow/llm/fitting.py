"""Choosing the rows that models are fitted on: bounded, and the same every time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def hashed_fraction(df: DataFrame, id_col: str, fraction: Column) -> DataFrame:
    """Rows whose seeded id hash lies in the given fraction of all hashes."""
    place = (F.xxhash64(F.col(id_col), F.lit(7)).bitwiseAND(F.lit((1 << 52) - 1))
             / F.lit(float(1 << 52)))
    return df.where(place < fraction)
