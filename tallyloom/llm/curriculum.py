"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time, from 0 to 1, linear between knots. Its
integral is the source's cumulative demand for words; inverting it turns a document's place in
its source's stream of words into a training position. Documents are then range-sorted by
position.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.tokens import WORD
from tallyloom.operators.ordered import join_on, with_positions
from tallyloom.session import durable

Knots = Sequence[tuple[float, float]]
WEIGHTS = (3.0, 1.0, 2.0)
SCHEDULES: tuple[Knots, ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.2), (0.5, 1.0), (1.0, 1.8)),
    ((0.0, 1.8), (0.5, 1.0), (1.0, 0.2)),
)


def inverse_demand(share: Column, knots: Knots) -> Column:
    """When a source has used up ``share`` of its words: the inverse of its integrated schedule.

    ``share`` is from 0 to 1. Weights must not be negative, nor all zero.
    """
    times, weights = zip(*knots, strict=True)
    if times[0] != 0 or times[-1] != 1 or list(times) != sorted(set(times)):
        raise ValueError("knots must run from 0 to 1 in rising order")
    areas = [(b - a) * (u + v) / 2 for a, b, u, v in
             zip(times, times[1:], weights, weights[1:], strict=False)]
    if min(weights) < 0 or sum(areas) <= 0:
        raise ValueError("weights must not be negative, nor all zero")
    demand = share * F.lit(sum(areas))
    out, done = None, sum(areas)
    for k in reversed(range(len(areas))):
        done -= areas[k]
        if areas[k] == 0:
            continue
        width = times[k + 1] - times[k]
        rest = F.greatest(demand - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.greatest(
            F.lit(weights[k] ** 2) + 2 * rest * F.lit((weights[k + 1] - weights[k]) / width),
            F.lit(0.0)))
        place = F.when(rest <= 0, F.lit(times[k])).otherwise(F.least(
            F.lit(times[k]) + 2 * rest / (F.lit(weights[k]) + root), F.lit(times[k + 1])))
        out = place if out is None else F.when(demand < F.lit(done + areas[k]), place).otherwise(out)
    return out


def source_targets(
    sizes: DataFrame, source_col: str, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """One row per source: ``source_size``, ``rank`` and ``target`` in words.

    Sources take their weights in order of their names, null last. Targets follow the weights
    until a source reaches ``most`` times its size; what is over is shared by the others.
    """
    if min(weights) <= 0:
        raise ValueError("weights must be positive")
    per_source = durable(
        sizes.groupBy(source_col).agg(F.sum("size").alias("source_size")), "sources")
    # One row per source from here on.
    named = per_source.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1))
    full = named.select(
        "*", weight.alias("weight"), (F.col("source_size") * most).alias("most"))
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (
        F.sum("source_size").over(everything) * share
        - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    levelled = full.withColumn("level", level)
    open_ = F.col("most") / F.col("weight") > F.col("level")
    first_open = F.min(F.when(open_, F.struct(F.col("most") / F.col("weight"), "rank", "level")))
    chosen = first_open.over(everything)["level"]
    return levelled.select(
        source_col, "source_size", "rank",
        F.least("most", F.coalesce(F.col("weight") * chosen, F.col("most"))).alias("target"))


def _running_sums(source_col: str) -> Callable:
    """Sum of sizes up to each row, along a partition sorted by source; from 0 at each source."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, total = object(), 0
        for batch in batches:
            ends = []
            for now, size in zip(batch.column(source_col).to_pylist(),
                                 batch.column("size").to_pylist(), strict=True):
                total = size if now != source else total + size
                source = now
                ends.append(total)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ends, pa.int64())], [*batch.schema.names, "__end"])
    return run


def assign(
    sizes: DataFrame, id_col: str = "doc_id", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0,
    schedules: Sequence[Knots] = SCHEDULES,
) -> DataFrame:
    """Positions for documents of known ``size``; all columns stay.

    Adds ``source_size``, ``target``, ``taken`` (words the mix takes of the document) and
    ``copies``, an array of (copy, words, position), one entry for every time it is used. A
    source's documents stand in the order of a hash of their ids and are used up in that order,
    again from the start while the target is not reached; the last one may be used in part. The
    words taken from a source are its target rounded down. Rows alike in id and size are
    interchangeable. Documents without words have no copies.
    """
    columns = sizes.columns
    ranged = (
        sizes.withColumn("__hash", F.md5(F.col(id_col).cast("string")))
        .repartitionByRange(source_col, "__hash")
        .sortWithinPartitions(source_col, "__hash", id_col, "size")
        .withColumn("__part", F.spark_partition_id()))
    schema = T.StructType([*ranged.schema.fields, T.StructField("__end", T.LongType())])
    placed = durable(ranged.mapInArrow(_running_sums(source_col), schema), "placed")
    targets = source_targets(placed, source_col, weights, share, most)
    parts = placed.groupBy(source_col, "__part").agg(F.sum("size").alias("__n"))
    # A row for each source and partition.
    along = Window.partitionBy(source_col).orderBy("__part")
    ladder = parts.select(source_col, "__part", F.coalesce(
        F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ).alias("__before"))
    known = durable(join_on(ladder, targets, [source_col]), "ladder")
    joined = join_on(placed, known, [source_col, "__part"])
    begin = F.col("__before") + F.col("__end") - F.col("size")
    quota, total = F.floor("target"), F.col("source_size")
    copies = math.ceil(most)
    used = [
        F.greatest(F.lit(0), F.least(F.col("size"), quota - begin - total * c)).cast("long")
        for c in range(copies)
    ]
    kind = F.col("rank") % len(schedules)

    def position(start: Column) -> Column:
        share_used = F.least(start / F.greatest(quota, F.lit(1)), F.lit(1.0))
        out = inverse_demand(share_used, schedules[-1])
        for k in range(len(schedules) - 1):
            out = F.when(kind == k, inverse_demand(share_used, schedules[k])).otherwise(out)
        return out

    entries = F.array(*[
        F.struct(F.lit(c).alias("copy"), used[c].alias("words"),
                 position((begin + total * c).cast("double")).alias("position"))
        for c in range(copies)
    ])
    taken = sum(used[1:], used[0])
    return joined.select(
        *columns, "source_size", "target", taken.alias("taken"),
        F.filter(entries, lambda e: e["words"] > 0).alias("copies"))


def document_sizes(docs: DataFrame, text_col: str) -> Column:
    """Words of each text; null has none."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def stream(
    sizes: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options
) -> DataFrame:
    """The training stream without texts: a row for every use of a document.

    ``sizes`` as for ``assign``. Returns its columns with ``source_size``, ``target``, ``copy``,
    ``words``, ``position`` and ``rank`` (from 1, by position, then id and copy): uses are
    range-sorted by position and numbered along the ranges. Documents that the mix does not use
    have no row; an empty table gives an empty one.
    """
    assigned = assign(sizes, id_col, source_col, **options)
    uses = assigned.select(
        *sizes.columns, "source_size", "target", F.explode("copies").alias("__use")
    ).select(*sizes.columns, "source_size", "target", "__use.*")
    return with_positions(uses, ["position", id_col, "copy"], index="rank", start=1)


def place(
    sizes: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options
) -> DataFrame:
    """One row per row of ``sizes``, also of those that the mix does not use.

    Adds ``source_size``, ``target``, ``taken`` (words of all its uses), ``n_uses`` and the first
    use's ``first_position`` and ``first_rank`` in the stream, null without a use. Rows alike
    in id and size are interchangeable.
    """
    rows = durable(sizes.withColumn("__origin", F.monotonically_increasing_id()), "sizes")
    known = rows.select("__origin", id_col, source_col, "size")
    used = stream(known, id_col, source_col, **options).groupBy("__origin").agg(
        F.sum("words").alias("taken"), F.count("*").alias("n_uses"),
        F.min("position").alias("first_position"), F.min("rank").alias("first_rank"))
    targets = durable(source_targets(rows, source_col, **{
        k: v for k, v in options.items() if k in ("weights", "share", "most")}).drop("rank"), "targets")
    return join_on(rows, targets, [source_col]).join(used, "__origin", "left").select(
        *sizes.columns, "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce("n_uses", F.lit(0)).alias("n_uses"), "first_position", "first_rank")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    **options,
) -> DataFrame:
    """The training stream: ``docs`` in the order of ``position``, a row for every use.

    Adds ``copy``, ``words`` (how many of the document's first words this use takes) and
    ``position``; columns of ``docs`` with these names are replaced. A null text has no words
    and is not used; a null source is a source. Options as for ``assign``.
    """
    columns = [c for c in docs.columns if c not in ("copy", "words", "position")]
    whole = docs.select(
        F.struct(*columns).alias("__row"), F.col(id_col).alias("__doc"),
        F.col(source_col).alias("__source"), document_sizes(docs, text_col).alias("size"))
    assigned = assign(whole, "__doc", "__source", **options)
    uses = assigned.select("__row", "__doc", F.explode("copies").alias("use")).select(
        "__row.*", "__doc", "use.copy", "use.words", "use.position")
    return uses.repartitionByRange("position").sortWithinPartitions(
        "position", "__doc", "copy").select(*columns, "copy", "words", "position")
