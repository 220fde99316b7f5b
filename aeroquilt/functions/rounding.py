"""Rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """``x`` to so many digits as DuckDB's round() does it: times a power of ten, halves away from zero, and divided again.

    ``F.round`` rounds the decimal text of a value, which takes far longer and differs where the product falls on a half.
    """
    tens = F.lit(10.0**digits)
    times = x * tens
    whole = F.when(F.abs(times) < 2.0**52, F.signum(times) * F.floor(F.abs(times) + 0.5)).otherwise(times)  # larger ones are whole
    return F.when(F.abs(times) < float("inf"), whole / tens).otherwise(x)
