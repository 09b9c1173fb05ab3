"""Suffix-array dedup: repeated byte strings by external induced sorting.

Sorting every suffix of a corpus is not needed to know which 200-byte strings repeat. The
sample suffixes are those that begin at an anchor (``repeats``), the part that the first level
of the recursion names; only anchors whose name occurs in several contexts go down a level.
There the suffix tuples (name, text to the right, text to the left) are put in suffix order by
Spark's external sort, whose spilled and merged runs are the disk-backed queue. Tasks read the
tuples as that queue hands them out, hold one bounded run of names at a time, and induce the
order of the suffixes one byte further left from the order just known: a stable sort by the
preceding byte. The common prefix of neighbours is carried along: one more than the least one
between them before. Two suffixes whose common prefix reaches the length are a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.repeats import (
    REF, Shape, repeated_anchors, split_contexts, union_length, with_marks, with_ref,
)
from tallyloom.llm.tokens import as_bytes
from tallyloom.session import durable

RESULT = [
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType()),
    T.StructField("kept_sha256", T.StringType()),
]
TUPLE = ("key long, right binary, left binary, __id string, __text long, at int, single boolean, "
         "low int, high int")
NAMED = ("key long, __id string, __text long, start int, more int, offset int, single boolean, "
         "low int, high int")
RUN_ROWS = 20_000
#: Contexts of a name that one task sorts.
RUN_NAMES = 4_000


def _tuples(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("__id").to_pylist(), batch.column("__text").to_pylist()
            marks = batch.column("anchors").to_pylist()
            rows: list[tuple] = []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                for m in marks[i]:
                    at, start = m["start"] + m["offset"], m["start"]
                    rows.append((m["key"], text[at:start + m["more"] + window], text[start:at],
                                 ids[i], hashes[i], at, m["single"], m["low"], m["high"]))
                    if len(rows) >= RUN_ROWS:
                        yield _as_batch(rows, TUPLE)
                        rows = []
            yield _as_batch(rows, TUPLE)
    return run


def _as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
             "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        [name for name, _ in fields])


def longer_names(text: bytes, m: dict, window: int) -> Iterator[tuple[int, int, int]]:
    """(name, low, high) for both halves of an anchor's distances ``low`` to ``high``.

    A window that begins ``d`` bytes left of the anchor holds ``d`` bytes before it and
    ``window - d`` from it on, so those of a half share the least of either. A half in which the
    anchor has no window has no name.
    """
    at, middle = m["start"] + m["offset"], (m["low"] + m["high"]) // 2
    for low, high in ((m["low"], middle), (middle + 1, m["high"])):
        if low <= min(high, m["offset"]) and high >= m["offset"] - m["more"]:
            shared = text[at - low:at + window - high]
            name = xxhash.xxh64_intdigest(shared, (m["key"] + 256 * low + high) & (2**64 - 1))
            yield name - (1 << 63), low, high


def _renamed(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("__id").to_pylist(), batch.column("__text").to_pylist()
            marks = batch.column("anchors").to_pylist()
            rows: list[tuple] = []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                for m in marks[i]:
                    rows += [(name, ids[i], hashes[i], m["start"], m["more"], m["offset"],
                              m["single"], low, high)
                             for name, low, high in longer_names(text, m, window)]
                    if len(rows) >= RUN_ROWS:
                        yield _as_batch(rows, NAMED)
                        rows = []
            yield _as_batch(rows, NAMED)
    return run


def neighbour_prefix(keys: np.ndarray, rights: list[bytes], width: int) -> np.ndarray:
    """Common prefix of every row's right text with the row before; 0 where the key changes."""
    lengths = np.array([len(r) for r in rights], np.int64)
    padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rights), np.uint8)
    table = padded.reshape(len(rights), width)
    out = np.zeros(len(rights), np.int64)
    if len(rights) > 1:
        differ = table[1:] != table[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared = np.minimum(shared, np.minimum(lengths[1:], lengths[:-1]))
        out[1:] = np.where(keys[1:] == keys[:-1], shared, 0)
    return out


def _between(prefix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of prefix[low+1 .. high] for every pair with low < high."""
    edges = np.empty(2 * len(low), np.int64)
    edges[0::2], edges[1::2] = low + 1, high + 1
    return np.minimum.reduceat(np.append(prefix, 0), edges)[::2]


def induce(keys: np.ndarray, rights: list[bytes], lefts: list[bytes], window: int) -> np.ndarray:
    """Which windows repeat: row by distance to the left of the anchor.

    Rows are in order of (key, right). One step to the left is a stable sort by the byte there.
    """
    tops = np.array([len(x) for x in lefts], np.int64)
    depth = int(tops.max(initial=0))
    before = np.zeros((len(lefts), depth + 1), np.uint8)
    for i, left in enumerate(lefts):
        before[i, 1:len(left) + 1] = np.frombuffer(left, np.uint8)[::-1]
    repeat = np.zeros((len(lefts), depth + 1), bool)
    order, prefix = np.arange(len(lefts)), neighbour_prefix(keys, rights, window)

    def mark(step: int) -> None:
        hit = prefix >= window
        repeat[order[hit], step] = True
        repeat[order[:-1][hit[1:]], step] = True

    mark(0)
    for step in range(1, depth + 1):
        alive = np.flatnonzero(tops[order] >= step)
        if not len(alive):
            break
        rows = order[alive]
        byte = before[rows, step].astype(np.int64)
        name = np.zeros(len(rows), np.int64)
        name[1:] = np.cumsum(keys[rows[1:]] != keys[rows[:-1]])
        group = name * 256 + byte
        place = np.argsort(group, kind="stable")
        same = group[place[1:]] == group[place[:-1]]
        extended = np.zeros(len(rows), np.int64)
        low, high = alive[place[:-1][same]], alive[place[1:][same]]
        if len(low):
            extended[1:][same] = 1 + _between(prefix, low, high)
        order, prefix = rows[place], extended
        mark(step)
    return repeat


def _repeat_spans(keys: list[int], table: pa.Table, window: int) -> pa.RecordBatch:
    lefts = table.column("left").to_pylist()
    repeat = induce(np.array(keys, np.int64), table.column("right").to_pylist(), lefts, window)
    repeat &= table.column("single").to_numpy(zero_copy_only=False)[:, None]
    step = np.arange(repeat.shape[1])
    repeat &= step >= table.column("low").to_numpy()[:, None]
    repeat &= step <= table.column("high").to_numpy()[:, None]
    edge = np.diff(np.pad(repeat.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, near = np.nonzero(edge == 1)
    _, far = np.nonzero(edge == -1)
    at = table.column("at").to_numpy()[row].astype(np.int64)
    take = pa.array(row)
    refs = [table.column(c).combine_chunks().take(take) for c in REF]
    return pa.RecordBatch.from_arrays(
        [*refs, pa.array((at - far + 1).astype(np.int32)),
         pa.array((at - near + window).astype(np.int32))], [*REF, "start", "end"])


def _drain(window: int) -> Callable:
    """Read sorted tuples, whole names at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            if not len(keys):
                continue
            cut = int(np.argmax(keys == keys[-1]))
            if size + cut >= RUN_ROWS and (cut or held[-1].column("key")[-1].as_py() != keys[0]):
                table = pa.Table.from_batches([*held, batch.slice(0, cut)])
                yield _repeat_spans(table.column("key").to_pylist(), table, window)
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            table = pa.Table.from_batches(held)
            yield _repeat_spans(table.column("key").to_pylist(), table, window)
    return run


def _cut(columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            marks = batch.column("__spans").to_pylist()
            for text, spans in zip(as_bytes(batch.column("__source")), marks, strict=True):
                runs = union_length(np.array(
                    [(m["start"], m["end"]) for m in spans or []], np.int64).reshape(-1, 2))
                ends = [0, *[end for _, end in runs]]
                starts = [*[start for start, _ in runs], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))
                out.append((len(text), len(text) - len(kept), len(runs), kept,
                            hashlib.sha256(kept).hexdigest()))
            values = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns],
                 *[pa.array(v, k) for v, k in zip(values, kinds, strict=True)]],
                [*columns, *[f.name for f in RESULT]])
    return run


MARK = ("key", "start", "more", "offset", "single", "low", "high")


def _levels(source: DataFrame, open_: DataFrame, window: int, run_names: int
            ) -> tuple[DataFrame, DataFrame]:
    """Anchors under names of at most ``run_names`` contexts, and the spans of those whose name
    has become the whole window.

    ``open_`` has ``contexts`` by name and the distances ``low`` to ``high``. Every level halves
    the distances, so levels are few, and only what is over the bound goes down one.
    """
    rare = open_.where(F.col("contexts") <= run_names)
    spans = None
    level = open_.where(F.col("contexts") > run_names)
    while not level.isEmpty():
        marked = with_marks(source, level, F.struct(*MARK), "anchors", "inner")
        named = durable(marked.mapInArrow(_renamed(window), NAMED), "names")
        several = durable(named.groupBy("key").agg(F.count("*").alias("contexts"))
                          .where("contexts > 1"), "contexts")
        # Stored on both sides, so that a key that is still frequent can be split.
        held = durable(named.join(several, "key"), "level")
        whole = held.where("low = high AND single").select(
            *REF, (F.col("start") + F.col("offset") - F.col("low")).alias("start"),
            (F.col("start") + F.col("offset") - F.col("low") + window).alias("end"))
        spans = whole if spans is None else spans.unionByName(whole)
        open_ = held.where("low < high")
        rare = rare.unionByName(open_.where(F.col("contexts") <= run_names).select(*rare.columns))
        level = open_.where(F.col("contexts") > run_names)
    return rare, spans


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
    sample_gram: int = 64, run_names: int = RUN_NAMES,
) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts elsewhere.

    Adds ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (remaining
    bytes; a cut may fall inside a character) and ``kept_sha256``; columns of ``docs`` with
    these names are replaced. A null text counts as empty; texts shorter than ``length`` lose
    nothing. Rows alike in id and text are separate documents. Names in more than ``run_names``
    contexts do not meet in one task but become longer ones, level after level.
    """
    if not 1 <= sample_gram <= length:
        raise ValueError("sample_gram must be between 1 and length")
    shape = Shape(words=False, window=length, gram=sample_gram)
    columns = [c for c in docs.columns if c not in {f.name for f in RESULT}]
    source = with_ref(docs, id_col, text_col)
    whole, open_ = split_contexts(repeated_anchors(source, text_col, shape), shape)
    open_ = durable(open_.withColumn("low", F.lit(0)).withColumn(
        "high", F.lit(length - sample_gram)), "open")
    texts = source.select(F.col(text_col).alias("text"), *REF)
    rare, windows = _levels(texts, open_, length, run_names)
    marked = with_marks(texts, rare, F.struct(*MARK), "anchors", "inner")
    tuples = marked.mapInArrow(_tuples(length), TUPLE)
    sorted_ = tuples.repartition("key").sortWithinPartitions("key", "right")
    induced = sorted_.mapInArrow(
        _drain(length), "__id string, __text long, start int, end int")
    spans = whole.unionByName(induced)
    spans = spans if windows is None else spans.unionByName(windows)
    kept = source.select(*columns, F.col(text_col).alias("__source"), *REF)
    cut = with_marks(kept, spans, F.struct("start", "end"), "__spans")
    schema = T.StructType([*[docs.schema[c] for c in columns], *RESULT])
    return cut.select(*columns, "__source", "__spans").mapInArrow(_cut(columns), schema)
