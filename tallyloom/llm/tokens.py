"""Words, bytes and their hashes in Arrow batches; shared by the text operators.

A word is a run of characters other than space and U+0009 to U+000D. All separators are ASCII,
so words can be cut on UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SLAB = 1 << 20

_rng = np.random.default_rng(20240601)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for reuse up to a slab."""
    known = _powers.get(base)
    if known is not None and len(known) >= n:
        return known[:n]
    size = max(n, SLAB)
    out = np.full(size, base & (2**64 - 1), np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if size <= 4 * SLAB:
        _powers[base] = out
    return out[:n]


def rolling(values: np.ndarray, length: int, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of every window of ``length`` values."""
    out, covered, block, size = None, 0, values, 1
    while True:
        if length & size:
            if out is None:
                out = block
            else:
                n = len(values) - covered - size + 1
                factor = np.uint64(pow(base, size, 2**64))
                out = out[:max(n, 0)] * factor + block[covered:covered + max(n, 0)]
            covered += size
        if covered == length:
            return out[:max(len(values) - length + 1, 0)]
        n = max(len(block) - size, 0)
        block = block[:n] * np.uint64(pow(base, size, 2**64)) + block[size:size + n]
        size *= 2


def slabs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a slab of bytes each, one text at least."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > SLAB:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def byte_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for every byte, and where each text's bytes begin."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=first[1:])
    return BYTE_CODE[data], first


def word_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, start and end of every word in them, and each text's first word."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=edges[1:])
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(texts) + 1, np.int64)
    inside = ~SEPARATOR[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = ~inside[:-1]
    fresh[edges] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    over = np.ones(len(data) + 1, bool)
    over[1:-1] = ~inside[1:]
    over[edges] = True
    ends = np.flatnonzero(inside & over[1:]) + 1
    return data, starts, ends, np.searchsorted(starts, edges)


def word_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for every word, and where each text's words begin."""
    data, starts, ends, first = word_bounds(texts)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, n), out=total[1:])
    back = powers(pow(BASE, -1, 2**64), n)
    value = (total[ends] - total[starts]) * back[starts]
    return mix(value + (ends - starts).astype(np.uint64)), first
