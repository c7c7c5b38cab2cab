"""Column expressions shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character left alone.

    Texts of ASCII alone, which have as many bytes as characters, take the faster function.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than space and U+0009-000D; null text: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
