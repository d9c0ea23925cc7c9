"""Packing of documents into training sequences by Karmarkar-Karp multiway differencing.

Every document is encoded, ended with an end id and cut: full windows become sequences of their own, the
rest is cut at five sixths again and again down to PIECE ids, since unlike sizes even out best. Each task gathers pieces into groups that just fit a fixed
number of windows, cutting the last piece where the group is full. A group is partitioned by
differencing: partial partitions with the widest spread are merged first, the fullest window of
one onto the emptiest of the other, until one partition with near-equal windows remains. If a window
exceeds the capacity, the group is dealt again to one window more.

Defined cases: null and empty texts are one piece, the end id. Rows that repeat a doc_id are packed each.
Ties are broken by the order of pieces, so a rerun of a task gives the same sequences. The last group of
a task may be partly filled; its windows are as many as needed and then equal. An empty table packs nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm import textbytes as tb
from shelfgraph.llm.subwords import VOCABULARY, Encoder
from shelfgraph.llm.tokenfiles import encode_rows

END = 1
CAPACITY = 2048
PIECE = 24
WINDOWS = 64  # windows of a full group
SLACK = 4  # ids per window left free for what differencing cannot even out
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Partition item indexes into windows of near-equal sum by largest differencing."""
    if not sizes:
        return [[] for _ in range(windows)]
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [i] + [None] * (windows - 1)))
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        sums = a + b[::-1]
        slots = [x if y is None else y if x is None else (x, y) for x, y in zip(left, reversed(right), strict=True)]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order] - sums[order[-1]]
        heapq.heappush(heap, (-int(sums[0]), number, sums, [slots[k] for k in order.tolist()]))
        number += 1
    return [_leaves(slot) for slot in heap[0][3]]


def _leaves(slot) -> list[int]:
    out, open_slots = [], [slot]
    while open_slots:
        x = open_slots.pop()
        if isinstance(x, tuple):
            open_slots.extend(x)
        elif x is not None:
            out.append(x)
    return sorted(out)


def fill(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most capacity; their count rises while differencing leaves one too full."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = [p for p in differencing(sizes, windows) if p]
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        windows += 1


class Packer:
    """Pieces of one task: groups them, fills windows, numbers sequences."""

    def __init__(self, task: int, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS):
        self.capacity, self.piece, self.windows = capacity, min(piece, capacity), windows
        self.room = windows * (capacity - min(SLACK, capacity // 64))
        self.sequence = task << 40
        self.held: list[tuple] = []
        self.size = 0
        self.rows: list[tuple] = []

    def _place(self, piece: tuple, offset: int) -> None:
        self.rows.append((*piece, self.sequence, offset))

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self._place((doc_id, start, ids[start : start + self.capacity], total), 0)
            self.sequence += 1
            start += self.capacity
        while start < total:
            rest = total - start
            size = rest if rest <= self.piece else rest * 5 // 6
            while size:
                part = min(size, self.room - self.size)
                self.held.append((doc_id, start, ids[start : start + part], total))
                self.size += part
                start, size = start + part, size - part
                if self.size == self.room:
                    self.close()

    def close(self) -> None:
        for window in fill([len(p[2]) for p in self.held], self.capacity) if self.held else []:
            offset = 0
            for i in window:
                self._place(self.held[i], offset)
                offset += len(self.held[i][2])
            self.sequence += 1
        self.held, self.size = [], 0

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        doc, start, ids, total, sequence, offset = zip(*rows, strict=True) if rows else [()] * 6
        longs = lambda v: pa.array(v, pa.int64())
        return pa.RecordBatch.from_arrays(
            [longs(doc), longs(start), longs([len(x) for x in ids]), tb.binary(ids), longs(total), longs(sequence), longs(offset)],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(vocabulary), Packer(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            text, doc = tb.column(batch, "text"), batch.column(0)
            for lo, hi in tb.slices(text):
                own = doc[lo:hi].to_pylist()
                for i, ids in encode_rows(encoder, text[lo:hi], end):
                    packer.add(own[i], ids)
                yield packer.take()
        packer.close()
        yield packer.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
