"""Recursive splitting of text that is over budget; the one per-row Python helper here."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np

# Where an oversize text may be cut, coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", " ")

Measure = Callable[[int, int], int]
MeasureText = Callable[[str], Measure]


#: Per character: whether it is a letter or digit, and whether it is white space between tokens.
_kinds: dict[str, np.ndarray] = {}


def _kind(name: str) -> np.ndarray:
    if not _kinds:
        points = range(0x110000)
        _kinds["word"] = np.fromiter((chr(c).isalnum() for c in points), bool, len(points))
        _kinds["space"] = np.zeros(len(points), bool)
        _kinds["space"][[ord(c) for c in " \t\n\x0b\f\r"]] = True
    return _kinds[name]


def token_starts(text: str) -> list[int]:
    """Where the default tokens begin: runs of letters and digits, other visible characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _kind("word")[points]
    inside = np.zeros(len(points), bool)
    inside[1:] = word[1:] & word[:-1]
    return np.flatnonzero(~(inside | _kind("space")[points])).tolist()


def default_measure() -> MeasureText:
    """Token counts of any span of a text from one pass over it."""

    def bind(text: str) -> Measure:
        starts = token_starts(text)
        return lambda start, end: bisect_left(starts, end) - bisect_left(starts, start)

    return bind


def encoder_measure(load: Callable[[], Callable[[str], list]]) -> Callable[[], MeasureText]:
    """Token counts by a user's encoder, loaded once per task."""

    def bound() -> MeasureText:
        encode = load()
        return lambda text: lambda start, end: len(encode(text[start:end]))

    return bound


def _cut_anywhere(start: int, end: int, budget: int, measure: Measure) -> list[tuple[int, int]]:
    """Spans of as many characters as fit, for text without any separator left."""
    spans = []
    while start < end and measure(start, end) > budget:
        fits, beyond = start + 1, end
        while beyond - fits > 1:
            middle = (fits + beyond) // 2
            if measure(start, middle) <= budget:
                fits = middle
            else:
                beyond = middle
        spans.append((start, fits))
        start = fits
    return [*spans, (start, end)] if start < end else spans


def _atoms(text: str, start: int, end: int, budget: int, measure: Measure, level: int = 0
           ) -> list[tuple[int, int]]:
    """Adjoining spans within budget, cut at the coarsest separators that allow it."""
    if measure(start, end) <= budget or end - start < 2:
        return [(start, end)]
    if level == len(SEPARATORS):
        return _cut_anywhere(start, end, budget, measure)
    separator, spans = SEPARATORS[level], []
    while start < end:
        found = text.find(separator, start, end)
        stop = end if found < 0 else found + len(separator)
        spans += _atoms(text, start, stop, budget, measure, level + 1)
        start = stop
    return spans


def split_counted(text: str, budget: int, overlap: int, bind: MeasureText) -> list[tuple[str, int]]:
    """Pieces of at most ``budget`` tokens with their counts, as the sum of those of their parts."""
    budget = max(budget, 1)
    measure = bind(text)
    spans = _atoms(text, 0, len(text), budget, measure)
    sizes = [measure(a, b) for a, b in spans]
    pieces, first, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > budget:
            pieces.append((text[spans[first][0]:spans[i][0]].strip(), total))
            while first < i and (total > overlap or total + size > budget):
                total -= sizes[first]
                first += 1
        total += size
    pieces.append((text[spans[first][0]:].strip(), total))
    return [p for p in pieces if p[0]]


def split_to_budget(text: str, budget: int, overlap: int, bind: MeasureText) -> list[str]:
    """Pieces of at most ``budget`` tokens; each repeats up to ``overlap`` tokens before it."""
    return [piece for piece, _ in split_counted(text, budget, overlap, bind)]
