"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words joined by single spaces. An item with an error budget
of e edits is cut into e + 1 pieces; a passage within the budget must hold one piece unchanged. Pieces
are found exactly: their first bytes by a table lookup at every position, the rest byte by byte. The passage
around a hit is verified with Myers' bit-parallel edit distance, many passages at a time.

Items travel to the tasks in groups of bounded bytes; each group is one pass over the documents.

Defined cases: null and empty texts match nothing. Items shorter than MIN_ITEM bytes after folding
are too short to be evidence and match nothing. Repeated items and documents each give their own rows.
Of several passages of one text the one with the fewest edits is reported, ties by the first. Empty
tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm import textbytes as tb

BUDGET = 0.08  # edits per byte of an item
MIN_ITEM = 24
SEED = 8  # bytes of a piece that are looked up at every position
GROUP_BYTES = 8 << 20  # items of one pass, as they are held by every task
TABLE_BITS = 20
POOL = 4096  # passages verified at once


def fold(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the folded texts, their offsets, and the place of each byte in the lower-cased text."""
    data, offsets = tb.flat(pc.utf8_lower(text))
    lettered = tb.LETTERED[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    # one space before each word but the first of a text
    keep = lettered.copy()
    if len(data):
        keep[:-1] |= lettered[1:] & ~fresh[1:-1]
    out = np.where(lettered, data, np.uint8(32))
    first = np.flatnonzero(fresh[:-1])
    keep[first] &= lettered[first]
    place = np.flatnonzero(keep)
    return out[place], np.searchsorted(place, offsets), place


@dataclass
class Items:
    ids: np.ndarray
    data: np.ndarray  # folded bytes of all items
    bounds: np.ndarray
    budget: np.ndarray
    seed: np.ndarray  # sorted first bytes of the pieces, with the columns below
    item: np.ndarray
    start: np.ndarray  # of the piece in its item
    length: np.ndarray

    def table(self) -> np.ndarray:
        bits = np.zeros(1 << TABLE_BITS, bool)
        bits[_slot(self.seed)] = True
        return bits


def _slot(seed: np.ndarray) -> np.ndarray:
    return ((seed * tb.GOLDEN) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def seeds(data: np.ndarray) -> np.ndarray:
    """The SEED bytes from each position on, as one number."""
    n = max(0, len(data) - SEED + 1)
    wide = data.astype(np.uint64)
    pair = wide[:-1] | wide[1:] << np.uint64(8)
    quad = pair[:-2] | pair[2:] << np.uint64(16)
    return (quad[:-4] | quad[4:] << np.uint64(32))[:n] if n else np.zeros(0, np.uint64)


def prepare(ids: list[int], texts: list[str], budget: float = BUDGET) -> Items:
    data, bounds, _ = fold(pa.array(texts, pa.string()))
    size = np.diff(bounds)
    allowed = np.floor(size * budget).astype(np.int64)
    # a piece must hold its seed
    allowed = np.minimum(allowed, np.maximum(size // SEED - 1, 0))
    item, start, length = [], [], []
    for i in np.flatnonzero(size >= MIN_ITEM):
        cuts = np.linspace(0, size[i], allowed[i] + 2).astype(np.int64)
        item.append(np.full(len(cuts) - 1, i))
        start.append(cuts[:-1])
        length.append(np.diff(cuts))
    item, start, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (item, start, length))
    at = bounds[item] + start
    seed = seeds(data)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(seed, kind="stable")
    return Items(np.array(ids, np.int64), data, bounds, allowed, seed[order], item[order], start[order], length[order])


def hits(items: Items, table: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, piece) of every exact piece occurrence in the bytes."""
    code = seeds(data)
    near = np.flatnonzero(table[_slot(code)])
    lo, hi = np.searchsorted(items.seed, code[near]), np.searchsorted(items.seed, code[near], side="right")
    count = hi - lo
    position = np.repeat(near, count)
    piece = np.repeat(lo - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum()) if count.sum() else np.zeros(0, np.int64)
    fits = position + items.length[piece] <= len(data)
    position, piece = position[fits], piece[fits]
    # the seed agrees; compare the rest byte by byte, dropping what differs
    origin = items.bounds[items.item] + items.start
    for k in range(SEED, int(items.length.max(initial=0))):
        same = (k >= items.length[piece]) | (data[np.minimum(position + k, len(data) - 1)] == items.data[np.minimum(origin[piece] + k, len(items.data) - 1)])
        position, piece = position[same], piece[same]
    return position, piece


def candidates(items: Items, position: np.ndarray, piece: np.ndarray, offsets: np.ndarray):
    """(row, item, from, to): passages to verify; hits on neighbouring diagonals share one."""
    row = np.searchsorted(offsets, position, side="right") - 1
    inside = position + items.length[piece] <= offsets[row + 1]
    position, piece, row = position[inside], piece[inside], row[inside]
    item = items.item[piece]
    diagonal = position - items.start[piece]
    order = np.lexsort((diagonal, item, row))
    row, item, diagonal = row[order], item[order], diagonal[order]
    e = items.budget[item]
    if not len(row):
        return row, item, diagonal, diagonal
    fresh = np.append(True, (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(diagonal) > e[1:]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row)) - 1
    row, item, e = row[first], item[first], e[first]
    size = np.diff(items.bounds)[item]
    return row, item, np.maximum(diagonal[first] - e, offsets[row]), np.minimum(diagonal[last] + size + e, offsets[row + 1])


def distances(items: Items, item: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item to a substring of data[start:stop], and where the first such ends.

    Myers' bit vectors for all passages at once; a pattern spans as many 64-bit words as it needs.
    """
    best, end = np.full(len(item), np.iinfo(np.int32).max, np.int64), start.copy()
    words = -(-np.diff(items.bounds)[item] // 64)
    for w in np.unique(words):
        own = np.flatnonzero(words == w)
        for part in np.array_split(own, max(1, -(-len(own) * int(w) // 16384))):
            best[part], end[part] = _myers(items, item[part], data, start[part], stop[part], int(w))
    return best, end


def _masks(items: Items, item: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Match masks (pattern, byte, word) of the distinct items, and the row of each."""
    distinct, row = np.unique(item, return_inverse=True)
    masks = np.zeros((len(distinct), 256, words), np.uint64)
    for k, i in enumerate(distinct):
        pattern = items.data[items.bounds[i] : items.bounds[i + 1]]
        at = np.arange(len(pattern))
        np.bitwise_or.at(masks, (k, pattern, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    return masks, row


def _myers(items, item, data, start, stop, words):
    masks, row = _masks(items, item, words)
    n = len(item)
    size = np.diff(items.bounds)[item]
    top_word, top_bit = (size - 1) // 64, ((size - 1) % 64).astype(np.uint64)
    one = np.uint64(1)
    plus, minus = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    score, best, end = size.copy(), size.copy(), start.copy()
    every = np.arange(n)
    for step in range(int((stop - start).max(initial=0))):
        live = start + step < stop
        char = data[np.minimum(start + step, len(data) - 1)]
        match = masks[row, char].T
        carry = np.zeros(n, np.uint64)
        rise_in = np.zeros(n, np.uint64)  # a match may start anywhere, so row 0 never rises
        fall_in = np.zeros(n, np.uint64)
        rises, falls = np.empty_like(plus), np.empty_like(plus)
        for w in range(words):
            eq, vp, vn = match[w], plus[w], minus[w]
            x = eq | vn
            part = (x & vp) + vp
            total = part + carry
            carry = ((part < vp) | (total < part)).astype(np.uint64)
            d0 = (total ^ vp) | x
            rise, fall = vn | ~(d0 | vp), vp & d0
            rises[w], falls[w] = rise, fall
            up = rise << one | rise_in
            down = fall << one | fall_in
            rise_in, fall_in = rise >> np.uint64(63), fall >> np.uint64(63)
            plus[w], minus[w] = down | ~(d0 | up), up & d0
        score += np.where(live, ((rises[top_word, every] >> top_bit) & one).astype(np.int64) - ((falls[top_word, every] >> top_bit) & one).astype(np.int64), 0)
        better = live & (score < best)
        best[better], end[better] = score[better], (start + step + 1)[better]
    return best, end


def search(items: Items, table: np.ndarray, text: pa.Array):
    """(row, item, distance, bytes from the first word to the passage's end) of every leak, by row then item.

    Passages of several slices are verified together.
    """
    found, pool, pooled = [], [], 0
    for lo, hi in tb.slices(text):
        data, offsets, place = fold(text[lo:hi])
        row, item, start, stop = candidates(items, *hits(items, table, data), offsets)
        if len(row):
            cut = np.repeat(start - np.append(0, np.cumsum(stop - start)[:-1]), stop - start) + np.arange((stop - start).sum())
            pool.append((row + lo, item, stop - start, data[cut], place[cut] - np.repeat(place[offsets[row]], stop - start)))
            pooled += len(row)
        if pooled >= POOL:
            found.append(_verify(items, pool))
            pool, pooled = [], 0
    if pool:
        found.append(_verify(items, pool))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4


def _verify(items: Items, pool):
    row, item, size, data, place = (np.concatenate(x) for x in zip(*pool, strict=True))
    stop = np.cumsum(size)
    distance, end = distances(items, item, data, stop - size, stop)
    good = np.flatnonzero(distance <= items.budget[item])
    order = good[np.lexsort((end[good], distance[good], item[good], row[good]))]
    first = order[np.flatnonzero(np.diff(row[order] * (len(items.ids) + 1) + item[order], prepend=-1))]
    return row[first], item[first], distance[first], place[end[first] - 1] + 1


def item_groups(benchmark: DataFrame, budget: float = BUDGET) -> Iterator[Items]:
    """The benchmark in groups of at most about GROUP_BYTES, each read on its own."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = 1 + total // GROUP_BYTES
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        rows.sort(key=lambda r: (r["item_id"], r["text"]))
        yield prepare([r["item_id"] for r in rows], [r["text"] for r in rows], budget)


def leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, distance, budget, passage_end (bytes from the text's first word on): one row per leak."""
    out = None
    for items in item_groups(benchmark, budget):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            table = known.table()
            for batch in batches:
                row, item, distance, end = search(known, table, tb.column(batch, "text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(known.ids[item]), pa.array(distance), pa.array(known.budget[item]), pa.array(end)],
                    names=["doc_id", "item_id", "distance", "budget", "passage_end"],
                )

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance long, budget long, passage_end long")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    for items in item_groups(benchmark, budget):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = shared.value.table()
            for batch in batches:
                row = search(shared.value, table, tb.column(batch, "text"))[0]
                clean = np.ones(batch.num_rows, bool)
                clean[row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
