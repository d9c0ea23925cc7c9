"""Bidirectional FM-index over a delimited vocabulary, searched for words one edit away.

The indexed text is $w1$w2$...$wn$. A state is a pair of suffix ranges, one among the sorted suffixes of the
text and one among those of the reversed text, of equal length; a state can be extended by a character at either end.
All states of all queries advance together as arrays.
"""

from __future__ import annotations

import numpy as np

END, MARK, FIRST = 0, 1, 2  # end of text, delimiter, first letter of the shard's alphabet


def suffix_order(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Start of each suffix in sorted order; the text ends with a unique least character."""
    n = len(text)
    bits = max(int(alphabet - 1).bit_length(), 1)
    span = 62 // bits
    key = np.zeros(n, np.int64)
    for k in range(span):
        key <<= bits
        key[: max(n - k, 0)] |= text[k:]
    while True:
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = np.diff(key[order]) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all() or span >= n:
            return order
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1  # span is less than n here
        key = rank * (n + 1) + after
        span *= 2


def occurrences(bwt: np.ndarray, alphabet: int) -> np.ndarray:
    """How often each character stands before each place."""
    out = np.zeros((len(bwt) + 1, alphabet), np.int32)
    out[np.arange(1, len(bwt) + 1), bwt] = 1
    return np.cumsum(out, axis=0, out=out)


class BiIndex:
    """Index of distinct words, given as one array of code points and word bounds."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        n = len(bounds) - 1
        self.letters, mapped = np.unique(codes, return_inverse=True)
        self.alphabet = len(self.letters) + FIRST
        text = np.full(len(codes) + n + 2, MARK, np.int64)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        text[np.arange(len(codes)) + owner + 1] = mapped.reshape(-1) + FIRST
        text[-1] = END
        self.size = len(text)
        order = suffix_order(text, self.alphabet)
        self.left = occurrences(text[order - 1], self.alphabet)
        # which word starts after a delimiter
        self.word_of = np.full(self.size, -1, np.int64)
        self.word_of[: self.size - 1][text[:-1] == MARK] = np.arange(n + 1)
        self.word_of = self.word_of[order]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.alphabet))[:-1]])
        back = np.concatenate([text[-2::-1], [END]])
        self.right = occurrences(back[suffix_order(back, self.alphabet) - 1], self.alphabet)

    def encode(self, codes: np.ndarray) -> np.ndarray:
        """Characters of queries; one that the index doesn't hold is -1."""
        place = np.minimum(np.searchsorted(self.letters, codes), max(len(self.letters) - 1, 0))
        return np.where(self.letters[place] == codes, place + FIRST, -1) if len(self.letters) else np.full(len(codes), -1)

    def children(self, low: np.ndarray, twin: np.ndarray, size: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every state and character: range on the extended side, range on the other side, length."""
        table = self.left if left else self.right
        first = table[low]
        count = table[low + size] - first
        shift = np.cumsum(count, axis=1, dtype=np.int64) - count
        return self.before[None, :] + first, twin[:, None] + shift, count


def _exact(index: BiIndex, pattern: np.ndarray, start: np.ndarray, stop: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Queries whose pattern[start:stop] occurs, with the ranges (extended side, other side, length)."""
    live = np.arange(len(start))
    low = np.zeros(len(start), np.int64)
    twin, size = low.copy(), np.full(len(start), index.size, np.int64)
    done: list[tuple[np.ndarray, ...]] = []
    at = start.copy()
    while len(live):
        over = at == stop[live]
        if over.any():
            done.append((live[over], low[over], twin[over], size[over]))
            live, low, twin, size, at = (x[~over] for x in (live, low, twin, size, at))
            if not len(live):
                break
        c = pattern[at]
        known = np.flatnonzero(c >= 0)
        live, low, twin, size, at, c = (x[known] for x in (live, low, twin, size, at, c))
        a, b, n = index.children(low, twin, size, left)
        pick = np.arange(len(c)), c
        low, twin, size = a[pick], b[pick], n[pick].astype(np.int64)
        some = np.flatnonzero(size)
        live, low, twin, size, at = (x[some] for x in (live, low, twin, size, at + 1))
    if not done:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*done))


def one_edit(index: BiIndex, codes: np.ndarray, bounds: np.ndarray, prefix_exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) one edit apart whose first half (or else second half) of the query is unchanged.

    The first half is matched from its last character to the delimiter before the word, then the
    search turns and extends across the second half with one error; the other scheme mirrors it.
    Each pair is given once.
    """
    length = np.diff(bounds)
    half = length // 2
    n = len(length)
    mapped = index.encode(codes)

    # patterns read outward: from the middle to the delimiter at either end
    def outward(leftward: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = (half if leftward else length - half) + 1
        stop = np.cumsum(size)
        start = stop - size
        owner = np.repeat(np.arange(n), size)
        k = np.arange(len(owner)) - start[owner]
        place = bounds[:-1][owner] + np.where(leftward, half[owner] - 1 - k, half[owner] + k)
        mark = k == size[owner] - 1
        out = np.where(mark, MARK, mapped[np.clip(place, 0, max(len(mapped) - 1, 0))]) if len(mapped) else np.full(len(owner), MARK)
        return out, start, stop

    held, h_start, h_stop = outward(prefix_exact)
    sought, s_start, s_stop = outward(not prefix_exact)
    query, twin, low, size = _exact(index, held, h_start, h_stop, left=prefix_exact)
    left = not prefix_exact  # the side that is extended now; its range comes first
    at = s_start[query]
    spent = np.zeros(len(query), bool)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    while len(query):
        c = sought[at]
        a, b, count = index.children(low, twin, size, left)
        rows = np.arange(len(query))
        good = np.flatnonzero((c >= 0) & (count[rows, c] > 0))
        closed = c[good] == MARK
        # whole words: the delimiter was read with the one edit spent
        ends = good[closed & spent[good]]
        if len(ends):
            whole = (a if left else b)[ends, MARK]
            pairs.append((query[ends], index.word_of[whole]))
        step = good[~closed]
        nxt = [(query[step], a[step, c[step]], b[step, c[step]], count[step, c[step]].astype(np.int64), at[step] + 1, spent[step])]
        fresh = np.flatnonzero(~spent)
        if len(fresh):
            row, letter = np.nonzero(count[fresh, FIRST:])
            row, letter = fresh[row], letter + FIRST
            extra = (query[row], a[row, letter], b[row, letter], count[row, letter].astype(np.int64), at[row], np.ones(len(row), bool))
            swap = (c[row] != MARK) & (c[row] != letter)
            nxt.append(extra)
            nxt.append((*(x[swap] for x in extra[:4]), at[row][swap] + 1, np.ones(int(swap.sum()), bool)))
            drop = fresh[c[fresh] != MARK]
            nxt.append((query[drop], low[drop], twin[drop], size[drop], at[drop] + 1, np.ones(len(drop), bool)))
        query, low, twin, size, at, spent = (np.concatenate(x) for x in zip(*nxt))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    query, word = (np.concatenate(x) for x in zip(*pairs))
    both = np.unique(query * (index.size + 1) + word)
    return both // (index.size + 1), both % (index.size + 1)
