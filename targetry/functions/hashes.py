"""Hashes of a fixed number of bytes from hexadecimal text that may be short or broken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient(text: Column, size: int) -> Column:
    """The first size bytes, as lower-case hexadecimal, filled up with zeros; all zeros for what isn't hexadecimal."""
    good = F.coalesce(text.rlike("^([0-9a-fA-F]{2})+$"), F.lit(False))
    return F.when(good, F.rpad(F.substring(F.lower(text), 1, 2 * size), 2 * size, "0")).otherwise(F.lit("00" * size))


def truncated(text: Column, size: int) -> Column:
    """lenient(), but for the empty hash, which is a value of its own."""
    return F.when(text == "", F.lit("")).otherwise(lenient(text, size))
