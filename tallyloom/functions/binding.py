"""Binding of intermediate values inside column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often ``body`` refers to it.

    The optimizer writes a column's expression out at every place it is used, inside lambda
    bodies too; a bound lambda variable stays bound.
    """
    return F.transform(F.array(value), body)[0]


def explode_once(df: DataFrame, array: Column | str, pos: str, value: str) -> DataFrame:
    """Replace the other columns' row by one row per array entry.

    The outer form with a filter after it, because for the inner form the optimizer tests
    the array beforehand, and so builds it twice.
    """
    return df.select(
        *[c for c in df.columns if c != array], F.posexplode_outer(array).alias(pos, value)
    ).where(F.col(pos).isNotNull())
