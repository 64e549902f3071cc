"""Shared helpers on text columns and on batches of texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z only
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    `lower` does just that on texts of one-byte characters and is faster.
    """
    one_byte = F.octet_length(text) == F.char_length(text)
    return F.when(one_byte, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def others(df: DataFrame, replaced: tuple[str, ...]) -> list[str]:
    """Columns of df but those an operator writes anew; names differ by more than case."""
    return [c for c in df.columns if c.lower() not in replaced]


def schema_with(df: DataFrame, kept: list[str], ddl: str = "") -> StructType:
    """Schema of the kept columns followed by those of the DDL text."""
    return StructType([df.schema[c] for c in kept] + (StructType.fromDDL(ddl).fields if ddl else []))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h
