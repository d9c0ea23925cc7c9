"""Texts of an Arrow batch as flat byte arrays: slicing, words, hashes, per-document sums.

Every operator of the package walks its batches in slices of bounded bytes, so what a task computes
follows the slice (or the longest single text), not the batch or the partition. bounded_batches() bounds the
batches too.
Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
BATCH_BYTES = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
BASE = 0xD1342543DE82EF95


def mix(values: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (splitmix finaliser); equal in, equal out."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    """One random odd 64-bit value per byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN) | np.uint64(1)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n, kept for the worker's life."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 4096)
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        _powers[:] = [_ladder(np.uint64(BASE), size), _ladder(inverse, size)]
    return _powers[0], _powers[1]


def _ladder(step: np.uint64, size: int) -> np.ndarray:
    out = np.full(size, step, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8)] = True
    return table


#: Word delimiters: space and the control characters 09 to 0D.
BLANK = byte_table(b" \t\n\x0b\x0c\r")
#: Bytes of a lettered word: ASCII letters and digits, and every byte of a longer character.
LETTERED = byte_table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bounded_batches(spark: SparkSession) -> None:
    """Sends rows to Python in Arrow batches of about BATCH_BYTES (or one longer row) from now on, not in 10,000 rows of any size.

    All rows still arrive; a task's two processes and their buffers just hold fewer of them at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column by name, as plain strings without nulls."""
    array = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(array.type) and not pa.types.is_large_string(array.type):
        array = array.cast(pa.string())
    return pc.fill_null(array, "") if array.null_count else array


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each, from 0."""
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    buffers = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most limit bytes, or one longer text."""
    _, offsets = flat(array)
    start = 0
    while start < len(array):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(array))
        yield start, stop
        start = stop


class Words:
    """Words of some texts: byte ranges, owning row, 64-bit hash.

    inside: byte table of what belongs to a word. fold: hash ASCII letters in lower case.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: bool = False):
        n = len(data)
        self.rows = len(offsets) - 1
        member = np.zeros(n + 1, dtype=bool)
        np.take(inside, data, out=member[:n])
        fresh = np.zeros(n + 1, dtype=bool)
        fresh[offsets[:-1]] = True
        fresh[n] = True
        first = member[:n].copy()
        first[1:] &= ~member[: n - 1] | fresh[1:n]
        last = member[:n] & (~member[1:] | fresh[1:])
        self.start = np.flatnonzero(first)
        self.stop = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)
        self.hash = range_hash(prefix_hash(LOWER[data] if fold else data), self.start, self.stop)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte_codes()[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of bytes start..stop; equal byte strings have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64) * GOLDEN)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i, zero for empty ranges."""
    out = np.zeros((len(bounds) - 1,) + values.shape[1:], dtype=np.result_type(values, np.int64) if values.dtype.kind in "biu" else values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=out.dtype)
    return out


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of size consecutive words inside one row, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    combined = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        combined = combined * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + n]
    last = np.repeat(bounds[1:], np.diff(bounds))[:n]
    index = np.flatnonzero(np.arange(n) + size <= last)
    return mix(combined[index]), index


def crc32_of_id(name: str = "doc_id"):
    """Column: crc32 of the id written as text."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(name).cast("string").cast("binary"))


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def binary(arrays) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], type=pa.binary())
