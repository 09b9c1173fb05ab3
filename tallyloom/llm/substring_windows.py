"""Substring dedup by Rabin-Karp hashes of fixed-length word windows.

Windows that can occur twice are found by their anchors (``repeats``); the Rabin-Karp hashes of
those windows are counted in Spark, and repeated windows merge into maximal removal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.repeats import (
    Shape, counted_windows, repeated_anchors, split_contexts, union_length, with_marks, with_ref,
)
from tallyloom.llm.tokens import as_bytes
from tallyloom.session import durable

RESULT = [
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType()),
]


def _cut(columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("__spans").to_pylist()
            counts, removed, kept, digests = [], [], [], []
            for text, marks in zip(as_bytes(batch.column("__source")), spans, strict=True):
                words = text.split()
                counts.append(len(words))
                runs = union_length(np.array(
                    [(m["start"], m["end"]) for m in marks or []], np.int64).reshape(-1, 2))
                for start, end in reversed(runs):
                    del words[start:end]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
                digests.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in columns], pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                pa.array(digests, pa.string()),
            ], [*columns, *[f.name for f in RESULT]])
    return run


def remove_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35
) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that also starts elsewhere.

    Adds ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space) and
    ``kept_sha256``; columns of ``docs`` with these names are replaced, all others stay. A null
    text counts as empty. Texts shorter than a window keep all their words. Rows alike in id
    and text are separate documents and repeat each other. An empty table gives an empty one.
    """
    if window < 1:
        raise ValueError("window must be at least one word")
    shape = Shape(words=True, window=window, gram=max(window // 3, 1))
    columns = [c for c in docs.columns if c not in {f.name for f in RESULT}]
    source = with_ref(docs, id_col, text_col)
    anchors = repeated_anchors(source, text_col, shape)
    whole, open_ = split_contexts(anchors, shape)
    spans = whole.unionByName(counted_windows(source, text_col, durable(open_, "open"), shape))
    kept = source.select(*columns, F.col(text_col).alias("__source"), "__id", "__text")
    marked = with_marks(kept, spans, F.struct("start", "end"), "__spans")
    schema = T.StructType([*[docs.schema[c] for c in columns], *RESULT])
    return marked.select(*columns, "__source", "__spans").mapInArrow(_cut(columns), schema)
