"""Hard-negative mining by slot-decomposed selection.

A positive's score limits its negatives to a window of scores. The upper limits of an anchor's
windows split the scores into disjoint slots. While anchors meet rows in blocks, a combiner keeps
the best rows of every slot; what leaves a task is bounded by anchors and slots. The slots of an
anchor, from the highest down, then answer all its windows: a window's rows are the first of its
own slot followed by the lower ones.

Anchors and rows meet in a grid of cells. A cell holds at most ``ANCHORS`` anchors, past which
blocks of rows stream, so its memory depends on neither the table's size nor its labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import durable

ANCHORS, ROWS, BLOCK = 32_768, 4_000_000, 4_096
TILE_ANCHORS, TILE_ROWS = 512, 1_024
#: Below and above every score.
LOW, HIGH = -(1 << 62), 1 << 62
FIELDS = ["ids", "rows", "labels", "components", "limits", "lowest"]
BLOCKS = "place int, anchors boolean, n int, " + ", ".join(f"{f} binary" for f in FIELDS)
KEPT = "anchor long, slot int, score long, other long, row long"


def _longs(column: pa.Array) -> np.ndarray:
    return np.array(column.to_numpy(zero_copy_only=False), np.int64)


def _matrix(column: pa.Array, fill: int) -> np.ndarray:
    """A list column, short lists filled up."""
    sizes = _longs(column.value_lengths())
    out = np.full((len(sizes), int(sizes.max(initial=0))), fill, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = _longs(column.flatten())
    return out


def _packed(anchors: bool, places: int) -> Callable:
    """Rows as blocks of matrices, dealt to ``places`` in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for whole in batches:
            for low in range(0, whole.num_rows, BLOCK):
                part = whole.slice(low, BLOCK)
                held = [_longs(part.column(c)) for c in ("id", "row", "label")]
                held.append(_matrix(part.column("components"), 0))
                held += [_matrix(part.column("limits"), LOW), _longs(part.column("lowest"))] \
                    if anchors else [np.zeros(0), np.zeros(0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([turn % places], pa.int32()), pa.array([anchors]),
                     pa.array([part.num_rows], pa.int32()),
                     *[pa.array([x.tobytes()], pa.binary()) for x in held]],
                    ["place", "anchors", "n", *FIELDS])
                turn += 1
    return run


def _unpacked(blocks: list[dict]) -> dict[str, np.ndarray]:
    """The rows of packed blocks as one set of arrays."""
    out = {}
    for name in FIELDS:
        tables = [np.frombuffer(b[name], np.int64).reshape(b["n"], -1) for b in blocks]
        wide = max(t.shape[1] for t in tables)
        fill = LOW if name == "limits" else 0
        out[name] = np.concatenate([
            np.pad(t, ((0, 0), (0, wide - t.shape[1])), constant_values=fill) for t in tables])
        if name not in ("components", "limits"):
            out[name] = out[name].reshape(-1)
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products of the rows of ``a`` and ``b``, shorter rows filled up with zeros.

    Computed in floating point where every partial sum is exact.
    """
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    most = max(wide, 1) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Combiner:
    """The best ``k`` rows of every (anchor, slot) among the blocks seen so far.

    With ``same`` the rows of the anchor's own label count, all in slot 0; without it those of
    other labels, in the slots that the anchor's limits cut.
    """

    def __init__(self, anchors: dict[str, np.ndarray], k: int, same: bool) -> None:
        self.anchors, self.k, self.same = anchors, k, same
        self.n = len(anchors["ids"])
        self.slots = 1 if same else anchors["limits"].shape[1]
        self.least = np.full(self.n * self.slots, LOW)
        #: By the first anchor of a tile of anchors, so that a tile of rows moves little.
        self.kept: dict[int, np.ndarray] = {}
        if same:
            order = np.argsort(anchors["labels"], kind="stable")
            values, first = np.unique(anchors["labels"][order], return_index=True)
            self.groups = dict(zip(values.tolist(), np.split(order, first[1:]), strict=True))

    def _tiles(self, rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        everyone = np.arange(self.n)
        for low in range(0, len(rows["ids"]), TILE_ROWS):
            some = np.arange(low, min(low + TILE_ROWS, len(rows["ids"])))
            if self.same:
                labels = rows["labels"][some]
                pairs = [(self.groups.get(label), some[labels == label])
                         for label in np.unique(labels).tolist()]
            else:
                pairs = [(everyone, some)]
            for anchors, members in pairs:
                if anchors is not None:
                    for first in range(0, len(anchors), TILE_ANCHORS):
                        yield anchors[first:first + TILE_ANCHORS], members

    def add(self, rows: dict[str, np.ndarray]) -> None:
        for a, b in self._tiles(rows):
            scores = inner_products(self.anchors["components"][a], rows["components"][b])
            if self.same:
                slot = np.zeros(scores.shape, np.int64)
                fits = self.anchors["rows"][a][:, None] != rows["rows"][b]
            else:
                fits = self.anchors["labels"][a][:, None] != rows["labels"][b]
                fits &= scores >= self.anchors["lowest"][a][:, None]
                slot = np.full(scores.shape, -1)
                for k in range(self.slots):
                    slot += self.anchors["limits"][a, k][:, None] >= scores
                fits &= slot >= 0
            place = a[:, None] * self.slots + slot
            fits &= scores >= self.least[np.maximum(place, 0)]
            x, y = np.nonzero(fits)
            if not len(x):
                continue
            found = np.stack([place[x, y], scores[x, y], rows["ids"][b][y], rows["rows"][b][y]])
            touched = np.zeros(len(self.least), bool)
            touched[found[0]] = True
            held = self.kept.get(int(a[0]), found[:, :0])
            again = touched[held[0]]
            self.kept[int(a[0])] = np.concatenate(
                [held[:, ~again], self._best(np.concatenate([held[:, again], found], 1))], 1)

    def _best(self, found: np.ndarray) -> np.ndarray:
        place, score, other, row = found
        found = found[:, np.lexsort((row, other, -score, place))]
        place = found[0]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        rank = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
        last = rank == self.k - 1
        self.least[place[last]] = found[1, last]
        return found[:, rank < self.k]

    def result(self) -> pa.RecordBatch:
        place, score, other, row = np.concatenate(
            [np.zeros((4, 0), np.int64), *self.kept.values()], 1)
        anchor = self.anchors["rows"][place // self.slots]
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array((place % self.slots).astype(np.int32)), pa.array(score),
             pa.array(other), pa.array(row)], [f.split()[0] for f in KEPT.split(", ")])


def _cells(k: int, same: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors, combiner = None, [], None
        for batch in batches:
            for block in batch.to_pylist():
                if (block["r"], block["q"]) != cell:
                    if combiner is not None:
                        yield combiner.result()
                    cell, anchors, combiner = (block["r"], block["q"]), [], None
                if block["anchors"]:
                    anchors.append(block)
                elif anchors:
                    if combiner is None:
                        combiner = Combiner(_unpacked(anchors), k, same)
                    combiner.add(_unpacked([block]))
        if combiner is not None:
            yield combiner.result()
    return run


def _best_rows(rows: DataFrame, anchors: DataFrame, n_rows: int, k: int, same: bool) -> DataFrame:
    """The ``k`` best rows of every anchor and slot; stored."""
    spark = rows.sparkSession
    # One small figure: how many anchors there are.
    across = max(-(-anchors.count() // ANCHORS), 1)
    tasks = spark.sparkContext.defaultParallelism
    down = max(-(-n_rows // ROWS), min(-(-tasks // across), -(-n_rows // BLOCK)), 1)
    rest = [c for c in BLOCKS.split(", ")[1:]]
    columns = [c.split()[0] for c in rest]
    left = rows.mapInArrow(_packed(False, down), BLOCKS).select(
        F.col("place").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("q"),
        *columns)
    right = anchors.mapInArrow(_packed(True, across), BLOCKS).select(
        F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"), F.col("place").alias("q"),
        *columns)
    found = (
        left.unionByName(right).repartition(across * down, "r", "q")
        .sortWithinPartitions("r", "q", F.desc("anchors")).mapInArrow(_cells(k, same), KEPT))
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other", "row")
    return durable(
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "kept")


def _share(score: Column, share: tuple[int, int]) -> Column:
    """``score`` times a whole-number ratio, rounded down."""
    product = score * F.lit(share[0])
    return ((product - F.pmod(product, F.lit(share[1]))) / F.lit(share[1])).cast("long")


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", positives: int = 5, negatives: int = 10,
    window: tuple[tuple[int, int], tuple[int, int]] = ((30, 100), (90, 100)), scale: int = 256,
) -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` holds.

    A component x counts as floor(``scale`` * x); a row's score is its inner product with the
    anchor. Higher scores come first, of equal ones the smaller id. An anchor's positives are its
    first rows of the same label; a positive's negatives are the first rows of other labels
    whose score lies within the two shares of the positive's score, limits included. Shares must
    be whole-number ratios. Returns ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``.

    Rows with a null id, label or vector or a null or non-finite component take no part; ids and
    labels are whole numbers. Repeated rows are rows of their own: a copy of an anchor is an
    anchor, and one of its positives. Vectors of other lengths are filled up with zeros, an empty
    one scores 0. Scores must fit 64 bits. A positive of negative score has no window. Other
    columns, whatever their names, are left alone; an empty table gives an empty one.
    """
    (low_part, low_whole), (high_part, high_whole) = window
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = durable(
        vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
                      & vector.isNotNull() & ~bad)
        .select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
            F.col(label_col).cast("long").alias("label"),
            F.transform(vector, lambda v: F.floor(v.cast("double") * scale)).alias("components"),
            F.coalesce(anchors, F.lit(False)).alias("is_anchor")),
        "vectors")
    n_rows = rows.count()
    everyone = rows.where("is_anchor").drop("is_anchor")
    plain = everyone.select("*", F.array().cast("array<long>").alias("limits"),
                            F.lit(LOW).alias("lowest"))
    rows = rows.drop("is_anchor")
    best = _best_rows(rows, plain, n_rows, positives, True)
    upper = _share(F.col("score"), (high_part, high_whole))
    lower = -_share(-F.col("score"), (low_part, low_whole))
    pairs = durable(
        best.select("anchor", F.col("other").alias("positive_id"), "score", lower.alias("lower"),
                    upper.alias("upper")).where("lower <= upper"), "positives")
    # As many limits as an anchor has positives, highest first.
    limits = pairs.groupBy("anchor").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("limits"),
        F.min("lower").alias("lowest"))
    cut = durable(everyone.join(limits, everyone["row"] == limits["anchor"]).drop("anchor"), "anchors")
    kept = _best_rows(rows, cut, n_rows, negatives, False)
    entry = F.struct("slot", "rank", F.col("score").alias("negative_score"),
                     F.col("other").alias("negative_id"))
    # At most ``negatives`` entries a slot, slots and entries from the highest score down.
    slots = kept.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    answered = pairs.join(cut.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")),
                          "anchor").join(slots, F.col("anchor") == F.col("row"))
    suffix = F.filter("entries", lambda e: e["negative_score"] <= F.col("upper"))
    first = F.filter(F.slice(suffix, 1, negatives), lambda e: e["negative_score"] >= F.col("lower"))
    return answered.select(
        "anchor_id", "positive_id", F.col("score").alias("positive_score"), F.posexplode(first)
    ).select(
        "anchor_id", "positive_id", (F.col("pos") + 1).alias("rank"),
        F.col("col.negative_id").alias("negative_id"), "positive_score",
        F.col("col.negative_score").alias("negative_score"))
