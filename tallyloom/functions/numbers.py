"""Number coercion that never raises, whatever the ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: decimal or exponent notation; no 'nan', 'inf' or type suffixes.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def safe_double(text: Column) -> Column:
    """The number a text cell holds, or NULL.

    Refers to the cell once, so that a cell that is costly to make is made once.
    """
    cell = F.trim(text.cast("string"))
    return F.regexp_extract(cell, NUMBER_PATTERN, 0).try_cast("double")


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, 0 where there is nothing to divide by."""
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))
