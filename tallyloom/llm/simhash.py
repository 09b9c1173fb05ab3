"""SimHash near-dedup by bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree wholly in some of ``radius + 2``
bands. Fingerprints that share two bands (one more than needed to be in a block at all) form a
block. Inside blocks the fingerprints are stored vertically, one bit plane per row, 64 lanes to
a machine word: lane i is compared with lane i + s for all lanes at once, the differing bits are
added up by carry-save counters plane by plane, and words whose lanes have all gone beyond the
radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.components import components
from tallyloom.llm.tokens import as_bytes
from tallyloom.session import durable

TILE = 4096
RUN_ROWS = 20_000


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the word shingles' XXH64, A-Z lower-cased; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    votes, total = np.zeros(64, np.int64), max(len(words) - shingle + 1, 1)
    for low in range(0, total, 65_536):
        high = min(low + 65_536, total)
        columns = [words[low + k:high + k] for k in range(shingle)]
        joined = map(b" ".join, zip(*columns, strict=False)) if len(words) >= shingle \
            else [b" ".join(words)]
        hashes = np.fromiter((digest(s, seed) for s in joined), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > total, bitorder="little").tobytes(), "little")


def _fingerprints(columns: list[str], shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column("__source"))],
                              np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(prints.view(np.int64))],
                [*columns, "__print"])
    return run


def with_fingerprint(docs: DataFrame, columns: list[str], text_col: str, shingle: int) -> DataFrame:
    """``columns`` of the documents and their fingerprint as a long, ``__print``."""
    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("__print", T.LongType())])
    return docs.select(*columns, F.col(text_col).alias("__source")).mapInArrow(
        _fingerprints(columns, shingle), schema)


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of words; bit i % 64 of word i // 64 in row p is bit p of fingerprint i."""
    lanes = -len(prints) % 64
    padded = np.append(prints, np.zeros(lanes, np.uint64))
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").copy().view(np.uint64)


def within_radius(planes: np.ndarray, lanes: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of ``wanted`` (bits in words) whose print is near that of the lane ``lanes`` on."""
    block = np.flatnonzero(wanted)
    alive = wanted[block]
    width = max(radius.bit_length(), 1)
    count = [np.zeros(len(block), np.uint64) for _ in range(width)]
    whole, part = divmod(lanes, 64)
    size = planes.shape[1]
    for p in range(64):
        plane = planes[p]
        near = block + whole
        moved = np.where(near < size, plane[np.minimum(near, size - 1)], 0).astype(np.uint64)
        if part:
            far = near + 1
            upper = np.where(far < size, plane[np.minimum(far, size - 1)], 0).astype(np.uint64)
            moved = (moved >> np.uint64(part)) | (upper << np.uint64(64 - part))
        carry = plane[block] ^ moved
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        above, equal = np.zeros(len(block), np.uint64), ~np.zeros(len(block), np.uint64)
        for k in reversed(range(width)):
            if radius >> k & 1:
                equal &= count[k]
            else:
                above |= equal & count[k]
                equal &= ~count[k]
        alive &= ~(carry | above)
        if p % 4 == 3:
            left = alive != 0
            if not left.any():
                return np.zeros(len(wanted), np.uint64)
            if not left.all():
                block, alive = block[left], alive[left]
                count = [c[left] for c in count]
    out = np.zeros(len(wanted), np.uint64)
    out[block] = alive
    return out


def _pack(flags: np.ndarray) -> np.ndarray:
    padded = np.append(flags, np.zeros(-len(flags) % 64, bool))
    return np.packbits(padded, bitorder="little").view(np.uint64)


def linked(prints: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """For every row the least row of its group it is linked to, directly or through others."""
    planes = bit_planes(prints)
    root = np.arange(len(prints))
    sizes = np.diff(np.flatnonzero(np.append(np.insert(groups[1:] != groups[:-1], 0, True), True)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for step in range(1, int(sizes.max(initial=1))):
        together = np.zeros(len(prints), bool)
        together[:-step] = groups[step:] == groups[:-step]
        near = within_radius(planes, step, _pack(together), radius)
        if near.any():
            lanes = np.flatnonzero(
                np.unpackbits(near.view(np.uint8), bitorder="little")[:len(prints)])
            for i in lanes[root[lanes] != root[lanes + step]].tolist():
                a, b = find(i), find(i + step)
                root[max(a, b)] = min(a, b)
            while (root[root] != root).any():
                root = root[root]
    return root


def _links(radius: int) -> Callable:
    def edges(table: pa.Table) -> pa.RecordBatch:
        prints = table.column("__print").to_numpy()
        group = np.zeros(len(prints), np.int64)
        for name in ("key", "low", "high"):
            values = table.column(name).to_numpy()
            group[1:] |= values[1:] != values[:-1]
        root = linked(prints.view(np.uint64), np.cumsum(group), radius)
        joined = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays(
            [pa.array(prints[joined]), pa.array(prints[root[joined]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < RUN_ROWS:
                continue
            table = pa.Table.from_batches(held)
            same = np.ones(size, bool)
            for name in ("key", "low", "high"):
                values = table.column(name).to_numpy()
                same &= values == values[-1]
            cut = int(np.argmax(same))
            if cut:
                yield edges(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size -= cut
        if held:
            yield edges(pa.Table.from_batches(held))
    return run


def _block_keys(radius: int) -> Column:
    """Every pair of bands with its number; bands are as even as 64 bits allow."""
    bands = radius + 2
    edges = [64 * i // bands for i in range(bands + 1)]
    value = [
        F.shiftrightunsigned("__print", low).bitwiseAND((1 << (high - low)) - 1)
        for low, high in zip(edges, edges[1:], strict=False)
    ]
    return F.array(*[
        F.xxhash64(F.lit(i), value[a], value[b])
        for i, (a, b) in enumerate(combinations(range(bands), 2))
    ])


def classes(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``__print``, ``root`` for every distinct fingerprint of the stored table ``prints``.

    A block of more than ``TILE`` fingerprints is cut into tiles, and every two tiles meet in a
    task of their own; only links that connect something new leave it.
    """
    if not 0 <= radius <= 14:
        raise ValueError("radius must be from 0 to 14")
    distinct = durable(prints.select("__print").distinct(), "prints")
    keyed = distinct.select("__print", F.explode(_block_keys(radius)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = durable(sizes.select(
        "key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "blocks")
    own = F.pmod(F.xxhash64("__print"), F.col("tiles")).cast("int")
    tiled = keyed.join(blocks, "key").withColumn("own", own).select(
        "__print", "key", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    ranked = tiled.select(
        "__print", "key", F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"))
    found = ranked.repartition("key", "low", "high").sortWithinPartitions(
        "key", "low", "high").mapInArrow(_links(radius), "a long, b long")
    roots = components(found)
    return distinct.join(roots, distinct["__print"] == roots["node"], "left").select(
        "__print", F.coalesce("root", "__print").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
    radius: int = 2,
) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    The component's id is the least document id that links of at most ``radius`` differing
    bits reach, directly or through others. A null or wordless text has fingerprint zero and is
    linked like any other; texts shorter than a shingle count whole. Rows with a null id take
    part; a component without any id has null. Repeated rows each get a row.
    """
    prints = durable(with_fingerprint(docs, [id_col], text_col, shingle), "fingerprints")
    labels = classes(prints, radius)
    firsts = durable(
        prints.groupBy("__print").agg(F.min(id_col).alias("first")).join(labels, "__print"),
        "labels")
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named = durable(firsts.join(least, "root").select("__print", "component_id"), "components")
    digits = F.lower(F.lpad(F.hex("__print"), 16, "0"))
    return prints.join(named, "__print").select(
        id_col, digits.alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
    radius: int = 2,
) -> DataFrame:
    """The documents with one row per component: the least id, of equal ids any one row.

    All columns stay as they are.
    """
    columns = docs.columns
    printed = durable(
        with_fingerprint(docs, columns, text_col, shingle)
        .withColumn("__row", F.monotonically_increasing_id()), "documents")
    labels = classes(printed, radius)
    first = durable(printed.groupBy("__print").agg(
        F.min(F.struct(F.col(id_col).isNull(), id_col, "__row")).alias("first")
    ).join(labels, "__print"), "labels")
    chosen = first.groupBy("root").agg(F.min("first").alias("first")).select("first.__row")
    # As many rows as documents stay, so never a side to broadcast.
    return printed.join(
        durable(chosen, "chosen").hint("merge"), "__row", "left_semi").select(*columns)
