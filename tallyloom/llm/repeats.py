"""Anchors: a sparse set of positions that finds every repeated fixed-length window.

A window of ``window`` tokens (bytes or words) is represented by the least hash among its
``gram``-token substrings, the leftmost of equals. Equal windows have their least gram at the
same offset, so a window whose anchor gram occurs once in the corpus occurs once itself. Only
one gram in about ``(window - gram) / 2`` is an anchor, so the corpus-wide count of anchors
moves a small part of what a count of all windows would, and rules out the same windows.

All windows of one anchor are consecutive. They span ``window + last - first`` tokens, the
anchor's context; contexts that occur twice settle all their windows at once. What is left are
anchors that occur in several contexts: edges of shared passages and edited copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tokens import as_bytes, byte_tokens, mix, rolling, slabs, word_tokens
from tallyloom.operators.ordered import join_on
from tallyloom.session import durable

KEY_BASE, WINDOW_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
SEGMENT = 1 << 22
REF = ["__id", "__text"]


@dataclass(frozen=True)
class Shape:
    """What a window is: its tokens, its length, and the length of the grams that anchor it."""

    words: bool
    window: int
    gram: int

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return word_tokens(texts) if self.words else byte_tokens(texts)


def with_ref(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with what their rows are known by: id and hash of the text.

    Rows that agree in both have the same text and so the same repeats.
    """
    return docs.withColumn("__id", F.col(id_col).cast("string")).withColumn(
        "__text", F.xxhash64(F.coalesce(text_col, F.lit("")))
    )


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` consecutive values."""
    out, covered = values, 1
    while covered < span:
        step = min(covered, span - covered)
        out = np.minimum(out[:len(out) - step], out[step:])
        covered += step
    return out


def find_anchors(tokens: np.ndarray, first: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Anchors of several texts: text, key, context hash, first window, number of further
    ones, and the anchor's distance from the first.

    ``first`` holds where each text's tokens begin, and the end.
    """
    parts = []
    for start in range(0, max(len(tokens), 1), SEGMENT):
        piece = tokens[start:start + SEGMENT + shape.window - 1]
        n = len(piece) - shape.window + 1
        if n <= 0:
            continue
        grams = mix(rolling(piece, shape.gram, KEY_BASE))
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64(0xFFFFFF)
        least = _least((grams & ~low) | place, shape.window - shape.gram + 1)
        at = np.arange(start, start + n)
        text = np.searchsorted(first, at, side="right") - 1
        inside = np.flatnonzero(at + shape.window <= first[text + 1])
        if not len(inside):
            continue
        anchor = (least[inside] & low).astype(np.int64)
        begins = np.ones(len(inside), bool)
        begins[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)
        begin = np.flatnonzero(begins)
        end = np.append(begin[1:], len(inside)) - 1
        one, two, spot = inside[begin], inside[end], anchor[begin]
        windows = rolling(piece, shape.window, WINDOW_BASE)
        context = mix(windows[one] + mix(windows[two] + mix(
            ((two - one) * 1024 + (spot - one)).astype(np.uint64))))
        parts.append((text[one], grams[spot], context, one + start, two - one, spot - one))
    names = ("text", "key", "context", "start", "more", "offset")
    if not parts:
        return {name: np.zeros(0, np.uint64 if name in ("key", "context") else np.int64)
                for name in names}
    return {name: np.concatenate([p[i] for p in parts]) for i, name in enumerate(names)}


def _anchor_batches(shape: Shape, keys_only: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for low, high in slabs(texts):
                tokens, first = shape.tokens(texts[low:high])
                found = find_anchors(tokens, first, shape)
                key = pa.array(found["key"].view(np.int64))
                if keys_only:
                    yield pa.RecordBatch.from_arrays([key], ["key"])
                    continue
                text = found["text"]
                rows = pa.array(text + low)
                yield pa.RecordBatch.from_arrays([
                    key, pa.array(found["context"].view(np.int64)),
                    batch.column("__id").take(rows), batch.column("__text").take(rows),
                    pa.array((found["start"] - first[text]).astype(np.int32)),
                    pa.array(found["more"].astype(np.int32)),
                    pa.array(found["offset"].astype(np.int32)),
                ], ["key", "context", *REF, "start", "more", "offset"])
    return run


def repeated_anchors(docs: DataFrame, text_col: str, shape: Shape) -> DataFrame:
    """Every occurrence of an anchor gram that occurs twice or more; a stored table.

    The keys are counted first, with partial sums per task, so that a passage in a third of
    all documents is a few rows by the time it is shuffled.
    """
    source = docs.select(F.col(text_col).alias("text"), *REF)
    keys = source.select("text").mapInArrow(_anchor_batches(shape, True), "key long")
    # Stored, so that the join's other side is a plain shuffle and a hot key can be split.
    twice = durable(keys.groupBy("key").count().where("count > 1").select("key"), "keys")
    rows = source.mapInArrow(
        _anchor_batches(shape, False),
        "key long, context long, __id string, __text long, start int, more int, offset int",
    )
    return durable(rows.join(twice, "key", "left_semi"), "anchors")


def split_contexts(anchors: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Windows settled by whole contexts, and one anchor of each context that is not.

    Returns spans (ref, start, end) in tokens, and representatives with ``single`` (the
    context occurs once), ``contexts`` (how many contexts its key has) and ``members``.
    """
    contexts = durable(anchors.groupBy("key", "context").agg(
        F.count("*").alias("members"),
        F.min(F.struct(*REF, "start", "more", "offset")).alias("one"),
    ), "contexts")
    # Stored before it is joined: the join's sides are then plain shuffles, and a hot key can be split.
    per_key = durable(contexts.groupBy("key").agg(F.count("*").alias("contexts"))
                      .where("contexts > 1"), "per_key")
    many = contexts.where("members > 1").select("key", "context")
    whole = anchors.join(many, ["key", "context"], "left_semi").select(
        *REF, F.col("start"), (F.col("start") + F.col("more") + shape.window).alias("end")
    )
    open_ = contexts.join(per_key, "key").select(
        "key", "contexts", (F.col("members") == 1).alias("single"),
        *[F.col(f"one.{c}").alias(c) for c in (*REF, "start", "more", "offset")],
    )
    return whole, open_


def with_marks(docs: DataFrame, marks: DataFrame, packed: Column, name: str,
               how: str = "left") -> DataFrame:
    """Each document's row with the array of its marks, at most one per token of it."""
    lists = marks.groupBy(*REF).agg(F.collect_set(packed).alias(name))
    return join_on(docs, lists, REF, how)


def union_length(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by rows of (start, end); touching runs are one."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.ones(len(spans), bool)
    fresh[1:] = spans[1:, 0] > reach[:-1]
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(spans)) - 1
    return list(zip(spans[begin, 0].tolist(), reach[last].tolist(), strict=True))


def _window_batches(shape: Shape) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = as_bytes(batch.column("text")), batch.column("__id")
            hashes, marks = batch.column("__text"), batch.column("anchors").to_pylist()
            for i, text in enumerate(texts):
                tokens, _ = shape.tokens([text])
                windows = rolling(tokens, shape.window, WINDOW_BASE).view(np.int64)
                starts = np.array([m["start"] for m in marks[i]], np.int64)
                sizes = np.array([m["more"] for m in marks[i]], np.int64) + 1
                row = np.repeat(np.arange(len(starts)), sizes)
                at = starts[row] + np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
                keys = np.array([m["key"] for m in marks[i]], np.int64)
                single = np.array([m["single"] for m in marks[i]], bool)
                for low in range(0, len(row), 100_000):
                    part = slice(low, low + 100_000)
                    n = len(row[part])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys[row[part]]), pa.array(windows[at[part]]),
                        pa.array([ids[i].as_py()] * n, pa.string()),
                        pa.array([hashes[i].as_py()] * n, pa.int64()),
                        pa.array(at[part].astype(np.int32)), pa.array(single[row[part]]),
                    ], ["key", "hash", *REF, "start", "single"])
    return run


def counted_windows(docs: DataFrame, text_col: str, open_: DataFrame, shape: Shape) -> DataFrame:
    """Spans of the windows of ``open_`` anchors whose Rabin-Karp hash occurs twice or more.

    The counts are sums per task first, so a window in many contexts is a few rows.
    """
    source = docs.select(F.col(text_col).alias("text"), *REF)
    marked = with_marks(
        source, open_, F.struct("key", "start", "more", "single"), "anchors", "inner"
    )
    windows = durable(marked.mapInArrow(
        _window_batches(shape),
        "key long, hash long, __id string, __text long, start int, single boolean",
    ), "windows")
    counts = windows.groupBy("key", "hash").count().where("count > 1")
    twice = durable(counts.select("key", "hash"), "hashes")
    return windows.where("single").join(twice, ["key", "hash"], "left_semi").select(
        *REF, "start", (F.col("start") + shape.window).alias("end")
    )
