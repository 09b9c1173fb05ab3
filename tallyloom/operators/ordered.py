"""Order-dependent building blocks that hold up when one key owns much of the table.

A plain window over a key sorts the whole key in one task. The functions here cut the
order into ranges first, so that a key's rows spread over many tasks and only one small
row per key and range is ever brought together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import durable

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys match each other; the right side's keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    matches = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    )
    return left.join(renamed, matches, how).drop(*[f"__r_{k}" for k in keys])


def with_positions(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    index: str = "input_index",
    total: str | None = None,
    start: int = 0,
) -> DataFrame:
    """Number rows by ``order``, within ``keys`` if given; optionally add the group size.

    One range shuffle places the rows; numbering inside a partition is a counter. The
    placed rows are written once, because the offsets and the rows must see the very same
    partitions. ``order`` should be unique within ``keys``.
    """
    columns = [*keys, *order]
    placed = (
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id())
    )
    placed = durable(placed, "positions")
    runs = placed.groupBy(*keys, "__part").agg(
        F.min("__row").alias("__first"), F.count("*").alias("__n")
    )
    # One row per key and partition: never more rows per key than there are partitions.
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part")
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    ladder = runs.select(
        *keys, "__part", "__first",
        F.coalesce(
            F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
        *([F.sum("__n").over(whole).alias(total)] if total else []),
    )
    joined = join_on(placed, ladder, [*keys, "__part"])
    position = F.col("__before") + F.col("__row") - F.col("__first") + start
    return joined.withColumn(index, position).drop("__part", "__row", "__first", "__before")


def _range_of(value: Column, bounds: Column) -> Column:
    return F.coalesce(F.size(F.filter(bounds, lambda b: b < value)), F.lit(0))


def _deviation(squares: Column, count: Column) -> Column:
    return F.when(count > 1, F.sqrt(squares / (count - 1)))


def weighted_summary(
    freq: DataFrame, keys: Sequence[str], value: str = "value", weight: str = "n",
    totals: Sequence[str] = (),
) -> DataFrame:
    """Exact mean, sample deviation, extremes and quartiles per key from value counts.

    ``freq`` holds one row per key and distinct value with its count; it is read more than
    once and should be a stored table. Further count columns named in ``totals`` are summed
    along. Values are cut into as many ranges as there are shuffle partitions; counts along
    the ranges carry the ranks, so no task ever holds a key.
    """
    ranges = max(int(freq.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    bounds = freq.agg(
        F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 1000)
    ).scalar()
    ranged = (
        freq.withColumn("__bounds", bounds)
        .withColumn("__range", _range_of(F.col(value), F.col("__bounds")))
        .drop("__bounds")
    )
    v, n = F.col(value), F.col(weight)
    per_range = ranged.groupBy(*keys, "__range").agg(
        F.sum(n).alias("__n"), F.sum(n * v).alias("__s")
    )
    along = Window.partitionBy(*keys).orderBy("__range")
    whole = Window.partitionBy(*keys)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    ladder = per_range.select(
        *keys, "__range",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("__total"),
        (F.sum("__s").over(whole) / F.sum("__n").over(whole)).alias("__mean"),
    )
    inside = (
        Window.partitionBy(*keys, "__range").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = join_on(ranged, ladder, [*keys, "__range"]).withColumn(
        "__from", F.col("__before") + F.coalesce(F.sum(n).over(inside), F.lit(0))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__from") <= rank) & (rank < F.col("__from") + n), v))

    picks = []
    for name, p in QUARTILES.items():
        rank = (F.col("__total") - 1) * F.lit(p)
        picks += [at(F.floor(rank)).alias(f"__lo_{name}"), at(F.ceil(rank)).alias(f"__hi_{name}")]
    grouped = placed.groupBy(*keys).agg(
        F.max("__total").alias("count"),
        F.max("__mean").alias("mean"),
        F.sum(n * (v - F.col("__mean")) * (v - F.col("__mean"))).alias("__m2"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        *[F.sum(c).alias(c) for c in totals],
        *picks,
    )
    quartiles = []
    for name, p in QUARTILES.items():
        rank = (F.col("count") - 1) * F.lit(p)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        quartiles.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return grouped.select(
        *keys, "count", "mean", _deviation(F.col("__m2"), F.col("count")).alias("std"),
        "min", "max", *quartiles, *totals,
    )
