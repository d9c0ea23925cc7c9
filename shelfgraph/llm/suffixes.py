"""Suffix arrays of many short strings by induced sorting, and their permuted common prefixes.

Suffixes are classified as larger (L) or smaller (S) than their successor. Leftmost smaller suffixes are
named by a first induction, sorted by recursion on the names, and the rest is induced from them: an L or S
suffix takes its place in its bucket by the place of its successor. Buckets are induced in blocks, so
the work is array operations; a block is repeated while successors inside it still move.
"""

from __future__ import annotations

import numpy as np

BLOCKS = 24


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last suffix is."""
    n = len(text)
    step = np.sign(np.diff(text))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[at] > 0, True)


class _Buckets:
    """Bucket bounds of each symbol, and L and S positions in bucket order."""

    def __init__(self, text: np.ndarray, small: np.ndarray):
        size = int(text.max()) + 1
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=size)))
        larger, smaller = np.flatnonzero(~small), np.flatnonzero(small)
        self.larger = larger[np.argsort(text[larger], kind="stable")]
        self.smaller = smaller[np.argsort(text[smaller], kind="stable")]
        smaller_count = np.bincount(text[smaller], minlength=size)
        self.smaller_first = self.first[1:] - smaller_count


def _blocks(symbols: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of whole buckets of about equal size."""
    n = len(symbols)
    if not n:
        return []
    marks = np.unique(np.searchsorted(symbols, symbols[np.linspace(0, n - 1, BLOCKS + 1).astype(np.int64)]))
    marks = np.append(marks, n) if marks[-1] != n else marks
    return list(zip(marks[:-1].tolist(), marks[1:].tolist(), strict=True))


def _induce(text: np.ndarray, order: np.ndarray, zone: np.ndarray, place: np.ndarray, downwards: bool) -> None:
    """Set the place of the positions in order (sorted by symbol); equal keys share a place."""
    symbols = text[order]
    place[order] = zone[symbols]
    unsettled = np.zeros(len(text) + 1, bool)
    blocks = _blocks(symbols)
    for lo, hi in reversed(blocks) if downwards else blocks:
        own, symbol = order[lo:hi], symbols[lo:hi]
        key = symbol.astype(np.int64) << 34 | (place[own + 1] + 1)
        sequence = np.argsort(key)
        own, key = own[sequence], key[sequence]
        same = _first(np.append(True, key[1:] != key[:-1]))
        symbol = key >> 34
        held = zone[symbol] + same - _first(np.append(True, symbol[1:] != symbol[:-1]))
        unsettled[own] = True
        place[own] = held
        # successors inside the block part the ties of the positions before them, and those in turn
        while True:
            size = np.bincount(same, minlength=len(own))
            pending = ((size > 1) & (np.bincount(same, unsettled[own + 1], minlength=len(own)) > 0))[same]
            unsettled[own] = False
            if not pending.any():
                break
            own, held = own[pending], held[pending]
            key = held << 34 | (place[own + 1] + 1)
            sequence = np.argsort(key)
            own, held, key = own[sequence], held[sequence], key[sequence]
            same = _first(np.append(True, key[1:] != key[:-1]))
            held = held + same - _first(np.append(True, held[1:] != held[:-1]))
            unsettled[own] = True
            place[own] = held


def _first(starts: np.ndarray) -> np.ndarray:
    """For each row the index of the start at or before it."""
    return np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))


def ranks(text: np.ndarray) -> np.ndarray:
    """Rank of every suffix. The last symbol must be the only smallest one."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = classify(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    buckets = _Buckets(text, small)
    symbol = text[leftmost]
    count = np.bincount(symbol, minlength=len(buckets.first) - 1)
    zone = buckets.first[1:] - count
    place = np.full(n + 1, -1, np.int64)
    place[leftmost] = zone[symbol]
    _induce(text, buckets.larger, buckets.first, place, False)
    _induce(text, buckets.smaller, buckets.smaller_first, place, True)
    found, names = np.unique(place[leftmost], return_inverse=True)
    sub = names if len(found) == len(leftmost) else ranks(names)
    sequence = np.argsort(sub)
    by_symbol = sequence[np.argsort(symbol[sequence], kind="stable")]
    before = np.append(0, np.cumsum(count))
    place[leftmost[by_symbol]] = zone[symbol[by_symbol]] + np.arange(len(leftmost)) - before[symbol[by_symbol]]
    _induce(text, buckets.larger, buckets.first, place, False)
    _induce(text, buckets.smaller, buckets.smaller_first, place, True)
    return place[:n]


def join_strings(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One symbol array of all strings, each closed by a separator of its own, and where each string starts."""
    m = len(lengths)
    start = np.cumsum(lengths + 1) - lengths - 1
    text = np.empty(int(lengths.sum()) + m, np.int64)
    ends = start + lengths
    filled = np.ones(len(text), bool)
    filled[ends] = False
    text[filled] = data.astype(np.int64) + m
    text[ends] = np.arange(m)[::-1]
    return text, start


def common_prefixes(text: np.ndarray, rank: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """By text position: length of the common prefix with the suffix before it in sorted order.

    Where the symbols to the left agree, it is one less than the position before has; only the others
    are compared.
    """
    n = len(text)
    before = np.where(rank > 0, suffix[np.maximum(rank - 1, 0)], -1)
    at = np.arange(n)
    given = (at > 0) & (before > 0)
    given[1:] &= text[:-1] == text[np.maximum(before[1:] - 1, 0)]
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(~given & (before >= 0))
    other, length = before[live], 0
    while len(live):
        inside = (live + length < n) & (other + length < n)
        same = inside & (text[np.minimum(live + length, n - 1)] == text[np.minimum(other + length, n - 1)])
        live, other = live[same], other[same]
        length += 1
        out[live] = length
    anchor = np.maximum.accumulate(np.where(~given, at, 0))
    return np.maximum(out[anchor] - (at - anchor), 0)
