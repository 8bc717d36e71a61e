"""Exact decimal rounding: scores are decimals throughout, never doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(col: Column, places: int, half_up: bool = False) -> Column:
    """Rounds to a number of places; halves go to the even digit unless half_up."""
    return F.round(col, places) if half_up else F.bround(col, places)


def dec(value: str, kind: str = "decimal(6,4)") -> Column:
    return F.lit(value).cast(kind)


def dec4(col: Column, half_up: bool = False) -> Column:
    """A factor as stored: decimal(6,4)."""
    return quantize(col, 4, half_up).cast("decimal(6,4)")


def milli(col: Column) -> Column:
    """A rounded confidence in whole thousandths."""
    return F.round(col * 1000).cast("int")
