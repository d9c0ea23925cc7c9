"""Weighted-Jaccard signatures by hierarchical Poisson processes (BagMinHash).

The weight axis of an element is discretised to unit levels. Each level carries its own Poisson process of
marked points (time, register); a signature keeps, per register, the earliest point of all levels below
an element's weight. The levels are explored as a binary tree of merged processes: a node knows its
earliest point, one half inherits it and the other half's earliest point follows by an exponential step at
its own rate. Branches whose earliest point is later than every register need are never opened, so a heavy
element costs about the logarithm of its weight. Two signatures agree in a register with a probability
of exactly sum(min) / sum(max) of the weights.
"""

from __future__ import annotations

import numpy as np

from shelfgraph.llm import textbytes as tb

LEVELS = 20  # weights up to 2**LEVELS are told apart; heavier ones count as that
SPARE = 5.0


def _uniform(seed: np.ndarray, draw: int) -> np.ndarray:
    bits = tb.mix(seed + np.uint64((draw * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _step(seed: np.ndarray, draw: int) -> np.ndarray:
    return -np.log(_uniform(seed, draw))


def signatures(element: np.ndarray, weight: np.ndarray, bounds: np.ndarray, registers: int) -> np.ndarray:
    """(rows, registers) earliest times; row i holds elements bounds[i]:bounds[i+1], inf where it has none."""
    rows = len(bounds) - 1
    weight = np.minimum(weight, 1 << LEVELS)
    total = tb.sums(weight, bounds).astype(np.float64)
    out = np.full((rows, registers), np.inf)
    patience = SPARE
    pending = np.flatnonzero(total > 0)
    while len(pending):
        limit = np.zeros(rows)
        limit[pending] = registers * (np.log(registers) + patience) / total[pending]
        out[pending] = np.inf
        _earliest(element, weight, bounds, limit, out)
        pending = pending[np.isinf(out[pending]).any(axis=1)]
        patience *= 2
    return out


def _earliest(element, weight, bounds, limit, out) -> None:
    """Enter all points up to each row's limit into out."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    live = np.flatnonzero(limit[row] > 0)
    row, seed, weight = row[live], tb.mix(element[live]), weight[live]
    low = np.zeros(len(row), np.int64)
    time = _step(seed, 1) / (1 << LEVELS)
    for level in range(LEVELS - 1, -1, -1):
        near = np.flatnonzero(time <= limit[row])
        row, seed, weight, low, time = row[near], seed[near], weight[near], low[near], time[near]
        half = 1 << level
        inherits_left = _uniform(seed, 2) < 0.5
        later = time + _step(seed, 3) / half
        left = np.where(inherits_left, time, later)
        # the right half only counts where the weight reaches into it
        both = np.flatnonzero(weight > low + half)
        right = np.where(inherits_left[both], later[both], time[both])
        row, weight = np.append(row, row[both]), np.append(weight, weight[both])
        seed, low = np.append(tb.mix(seed ^ np.uint64(0xA5A5A5A5)), tb.mix(seed[both] ^ np.uint64(0x5A5A5A5A5A))), np.append(low, low[both] + half)
        time = np.append(left, right)
    registers = out.shape[1]
    flat = out.reshape(-1)
    draw = 4
    while True:
        near = np.flatnonzero(time <= limit[row])
        if not len(near):
            return
        row, seed, time = row[near], seed[near], time[near]
        register = (_uniform(seed, draw) * registers).astype(np.int64)
        np.minimum.at(flat, row * registers + register, time)
        time = time + _step(seed, draw + 1)
        draw += 2


def similarity(keys_a: np.ndarray, counts_a: np.ndarray, keys_b: np.ndarray, counts_b: np.ndarray) -> float:
    """Overlap of two multisets: sum(min) / sum(max). Keys are sorted and distinct."""
    shared = np.searchsorted(keys_b, keys_a)
    shared[shared == len(keys_b)] = 0
    hit = np.flatnonzero(keys_b[shared] == keys_a) if len(keys_b) else np.zeros(0, np.int64)
    common = np.minimum(counts_a[hit], counts_b[shared[hit]]).sum()
    whole = counts_a.sum() + counts_b.sum() - common
    return float(common / whole) if whole else 1.0
