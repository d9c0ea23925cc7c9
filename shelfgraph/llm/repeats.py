"""Exact removal of repeated byte strings by sharded suffix arrays.

A byte is removed where a string of `length` bytes covers it that also starts in a document with a smaller
id; strings are judged on the input. The work, every step of it linear in the input:

1. Texts are stored once in flushes of bounded bytes. Every window of `length` bytes has a smallest
   seed hash; maximal runs of windows with one seed are the units that travel. A flush files its
   distinct seeds by hash bucket.
2. A bucket finds the seeds that more than one document holds and answers each flush with its own.
3. A flush sends each distinct string under such seeds once, with its smallest doc_id, to the shard
   of its seed: equal windows have equal seeds, so they meet in one shard.
4. A shard builds suffix arrays of its strings by induced sorting and compares neighbours by
   permuted common prefixes; suffixes that share `length` bytes are one group with one smallest doc_id.
   A string that is alone under its seed has its windows to itself and isn't sorted.
5. A flush marks the windows whose group starts in a smaller document.

A passage in a third of all documents is one string per flush in steps 3 and 4. Flushes are bucketed by
their number, so the two answers meet the stored texts without moving these again. Filing drops nothing:
a truncated seed hash can only send a string too many.

Defined cases: null and empty texts, and texts shorter than `length`, lose nothing. Documents that
share an id are not smaller than one another. Rows without doc_id count as the largest id. Repeated
rows each get a result. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm import suffixes
from shelfgraph.llm import textbytes as tb
from shelfgraph.llm.durable import written

LENGTH = 50
SEED = 24
LONGEST_RUN = 64  # windows of one travelling string
FLUSH_BYTES = 4 << 20
SLICE = 256 << 10
BUCKET_BYTES = 16 << 20  # text per hash bucket and per shard
ARRAY_BYTES = 1 << 20  # symbols of one suffix array, as near as whole seeds allow
NO_ID = np.iinfo(np.int64).max
HASH_BITS = np.uint64(39)


class Runs:
    """Runs of windows with one seed in some texts: place of the first window, window count, seed, text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED):
        windows = len(data) - length + 1
        if windows <= 0:
            self.start = self.count = self.row = np.zeros(0, np.int64)
            self.seed = np.zeros(0, np.uint64)
            return
        prefix = tb.prefix_hash(data)
        _, down = tb.powers(len(data) + 1)
        value = (prefix[seed:] - prefix[:-seed]) * down[: len(data) - seed + 1]
        value ^= value >> np.uint64(32)
        value *= tb.MIX_1
        value ^= value >> np.uint64(29)
        least, span, width = value, 1, length - seed + 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = width - span
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        inside = np.zeros(windows, np.int8)
        counts = np.maximum(np.diff(offsets) - length + 1, 0)
        valid = np.zeros(windows + 1, np.int64)
        np.add.at(valid, np.minimum(offsets[:-1], windows), 1)
        np.add.at(valid, np.minimum(offsets[:-1] + counts, windows), -1)
        inside = np.cumsum(valid[:-1]) > 0
        edge = np.zeros(windows + 1, bool)
        edge[np.minimum(offsets, windows)] = True
        fresh = inside.copy()
        fresh[1:] &= (least[1:] != least[:-1]) | edge[1:windows] | ~inside[:-1]
        start = np.flatnonzero(fresh)
        ends = np.flatnonzero(inside & np.append(~inside[1:] | fresh[1:], True)) + 1
        # long runs, as of one repeated byte, are cut
        pieces = -(-(ends - start) // LONGEST_RUN)
        which = np.repeat(np.arange(len(start)), pieces)
        step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = start[which] + step * LONGEST_RUN
        self.count = np.minimum(ends[which] - self.start, LONGEST_RUN)
        self.seed = tb.mix(least[start])[which]
        self.row = np.searchsorted(offsets, self.start, side="right") - 1


def _keys(seed: np.ndarray) -> np.ndarray:
    return seed & ((np.uint64(1) << HASH_BITS) - np.uint64(1))


def _bucket(seed: np.ndarray, buckets: int) -> np.ndarray:
    return ((seed >> HASH_BITS) % np.uint64(buckets)).astype(np.int32)


def _narrow(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _wide(blob: bytes) -> np.ndarray:
    part = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :5] = part
    return out.view("<u8").reshape(-1)


def _flush_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, Runs]]:
    """(first byte of the slice, its runs), in slices of whole texts."""
    row = 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        runs = Runs(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], length)
        runs.row = runs.row + row
        yield int(offsets[row]), runs
        row = stop


def _file(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, buckets: int, length: int) -> tuple[list[int], list[bytes]]:
    """Distinct seeds of a flush by bucket; the lowest bit says that two documents of the flush hold it."""
    seeds, owner = [], []
    for _, runs in _flush_runs(data, offsets, length):
        seeds.append(runs.seed)
        owner.append(ids[runs.row])
    seed, doc = np.concatenate([*seeds, np.zeros(0, np.uint64)]), np.concatenate([*owner, np.zeros(0, np.int64)])
    if not len(seed):
        return [], []
    order = np.argsort(seed)
    seed, doc = seed[order], doc[order]
    first = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    entry, bucket = _keys(seed[first]) << np.uint64(1) | several.astype(np.uint64), _bucket(seed[first], buckets)
    order = np.lexsort((entry, bucket))
    entry, bucket = entry[order], bucket[order]
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return bucket[edge].tolist(), [_narrow(x) for x in np.split(entry, edge[1:])]


def _repeated(group: pa.Table) -> pa.Table:
    """Seeds of one bucket that two documents hold, as an answer to every flush that asked."""
    parts = group.column("part").to_pylist()
    asked = [_wide(blob) for blob in group.column("entries").to_pylist()]
    entry = np.concatenate(asked)
    flush = np.repeat(np.arange(len(asked)), [len(x) for x in asked])
    key = entry >> np.uint64(1)
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.flatnonzero(np.append(True, sorted_key[1:] != sorted_key[:-1]))
    size = np.diff(np.append(first, len(key)))
    several = np.add.reduceat((entry[order] & np.uint64(1)).astype(np.int64), first) > 0
    good = order[np.repeat((size > 1) | several, size)]
    good = good[np.argsort(flush[good], kind="stable")]
    edge = np.searchsorted(flush[good], np.arange(len(asked) + 1))
    kept = [i for i in range(len(asked)) if edge[i] < edge[i + 1]]
    bucket = group.column("bucket").to_pylist()[0]
    return pa.table(
        [pa.array([parts[i] for i in kept], pa.int64()), pa.array([bucket] * len(kept), pa.int32()), pa.array([_narrow(np.sort(key[good[edge[i] : edge[i + 1]]])) for i in kept], pa.binary())],
        names=["part", "bucket", "seeds"],
    )


class Strings:
    """The strings of a flush under repeated seeds, each once, and the runs that hold them."""

    def __init__(self, data, offsets, ids, answers, buckets: int, length: int):
        known = np.sort(np.concatenate([_wide(bytes(a["seeds"])) | np.uint64(a["bucket"]) << np.uint64(40) for a in answers] or [np.zeros(0, np.uint64)]))
        starts, counts, rows, seeds = [], [], [], []
        for base, runs in _flush_runs(data, offsets, length):
            wanted = _keys(runs.seed) | _bucket(runs.seed, buckets).astype(np.uint64) << np.uint64(40)
            at = np.searchsorted(known, wanted)
            at[at == len(known)] = 0
            hit = np.flatnonzero(known[at] == wanted) if len(known) else np.zeros(0, np.int64)
            starts.append(runs.start[hit] + base)
            counts.append(runs.count[hit])
            rows.append(runs.row[hit])
            seeds.append(runs.seed[hit])
        self.start, self.count, self.row = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (starts, counts, rows))
        seed = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        raw, size = data.tobytes(), self.count + length - 1
        seen: dict[bytes, int] = {}
        self.string = np.array([seen.setdefault(raw[a : a + n], len(seen)) for a, n in zip(self.start.tolist(), size.tolist(), strict=True)], np.int64)
        self.texts = list(seen)
        first = np.unique(self.string, return_index=True)[1]
        self.seed = seed[first]
        self.doc = np.full(len(seen), NO_ID)
        np.minimum.at(self.doc, self.string, ids[self.row])
        # by shard, then seed: the order in which they travel and in which answers come back
        self.shard = _bucket(self.seed, buckets)
        self.order = np.lexsort((np.arange(len(seen)), self.seed, self.shard))

    def shipments(self) -> list[dict]:
        out = []
        shard = self.shard[self.order]
        for lo, hi in _ranges(shard):
            own = self.order[lo:hi]
            texts = [self.texts[i] for i in own]
            out.append({
                "shard": int(shard[lo]),
                "seeds": self.seed[own].tobytes(),
                "docs": self.doc[own].tobytes(),
                "lengths": np.array([len(t) for t in texts], "<u2").tobytes(),
                "bytes": b"".join(texts),
            })
        return out


def _ranges(values: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return list(zip(edge.tolist(), np.append(edge[1:], len(values)).tolist(), strict=True))


def smallest_documents(texts: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For every window of every string: the smallest document among the strings that hold it."""
    lengths = np.array([len(t) for t in texts], np.int64)
    text, start = suffixes.join_strings(np.frombuffer(b"".join(texts), np.uint8), lengths)
    rank = suffixes.ranks(text)
    suffix = np.empty(len(text), np.int64)
    suffix[rank] = np.arange(len(text))
    shared = suffixes.common_prefixes(text, rank, suffix)
    edge = np.flatnonzero(np.append(True, shared[suffix][1:] < length))
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    least = np.minimum.reduceat(docs[owner][suffix], edge)
    by_place = np.empty(len(text), np.int64)
    by_place[suffix] = np.repeat(least, np.diff(np.append(edge, len(text))))
    return [by_place[a : a + n - length + 1] for a, n in zip(start.tolist(), lengths.tolist(), strict=True)]


def _shard(group: pa.Table, length: int) -> pa.Table:
    """Suffix arrays of one shard; the answer to each flush is in the order of its shipment."""
    import zstandard

    rows = group.to_pylist()
    parts, shards = [r["part"] for r in rows], [r["shard"] for r in rows]
    seeds = [np.frombuffer(r["seeds"], np.uint64) for r in rows]
    docs = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in rows])
    # equal strings of several flushes stand once in the array
    distinct: dict[bytes, int] = {}
    which = np.zeros(len(docs), np.int64)
    at = 0
    for r in rows:
        ends = np.cumsum(np.frombuffer(r["lengths"], "<u2").astype(np.int64)).tolist()
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            which[at] = distinct.setdefault(r["bytes"][a:b], len(distinct))
            at += 1
    edges = np.append(0, np.cumsum([len(s) for s in seeds]))
    least = np.full(len(distinct), NO_ID)
    np.minimum.at(least, which, docs)
    unique = list(distinct)
    seed = np.zeros(len(unique), np.uint64)
    seed[which] = np.concatenate(seeds)
    del rows, distinct
    order = np.argsort(seed, kind="stable")
    sizes = np.array([len(t) for t in unique], np.int64)
    windows = sizes - length + 1
    place = np.cumsum(windows) - windows
    # the windows of string i are flat[place[i]:place[i] + windows[i]]; those of a string alone under its seed stay as they are
    flat = np.repeat(least, windows)
    held: list[int] = []
    size = 0

    def work():
        for i, docs_of in zip(held, smallest_documents([unique[i] for i in held], least[held], length), strict=True):
            flat[place[i] : place[i] + windows[i]] = docs_of

    for lo, hi in _ranges(seed[order]):
        if hi - lo == 1:
            continue
        own, own_size = order[lo:hi].tolist(), int(sizes[order[lo:hi]].sum())
        if held and size + own_size > ARRAY_BYTES:
            work()
            held, size = [], 0
        held += own
        size += own_size
    if held:
        work()
    packer = zstandard.ZstdCompressor(level=1)
    blobs = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = which[lo:hi]
        ends = np.cumsum(windows[own])
        at = np.arange(ends[-1]) + np.repeat(place[own] - ends + windows[own], windows[own])
        blobs.append(packer.compress(flat[at].tobytes()))
    return pa.table([pa.array(parts, pa.int64()), pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "shard", "least"])


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(row["text"]) if row["text"] else b""
    return np.frombuffer(raw, np.uint8), np.frombuffer(row["bounds"], np.int64), np.frombuffer(row["ids"], np.int64)


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start and end bytes) of every document."""
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, volume // BUCKET_BYTES)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), volume // (8 * FLUSH_BYTES))
    flushes = f"repeats_{uuid.uuid4().hex}"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        for batch in batches:
            text, ids = tb.column(batch, "text"), _ids(batch.column(0))
            for lo, hi in tb.slices(text, FLUSH_BYTES):
                data, offsets = tb.flat(text[lo:hi])
                bucket, entries = _file(data, offsets, ids[lo:hi], buckets, length)
                filed = pa.StructArray.from_arrays([pa.array(bucket, pa.int32()), pa.array(entries, pa.binary())], names=["bucket", "entries"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), tb.binary([ids[lo:hi]]), tb.binary([offsets]), pa.array([packer.compress(data.tobytes())], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(bucket)], pa.int32()), filed)],
                    names=["part", "ids", "bounds", "text", "filed"],
                )
                number += 1

    schema = "part long, ids binary, bounds binary, text binary, filed array<struct<bucket: int, entries: binary>>"
    docs.select("doc_id", "text").mapInArrow(store, schema).write.bucketBy(tasks, "part").saveAsTable(flushes)
    stored = spark.table(flushes)

    filed = stored.select("part", F.explode("filed").alias("f")).select("part", "f.bucket", "f.entries")
    answers = filed.groupBy("bucket").applyInArrow(_repeated, "part long, bucket int, seeds binary")
    by_part = answers.groupBy("part").agg(F.collect_list(F.struct("bucket", "seeds")).alias("answers"))
    asked = written(by_part, "repeated-seeds")
    texts = stored.select("part", "ids", "bounds", "text")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, bounds, ids = _opened(row)
                out = Strings(data, bounds, ids, row["answers"], buckets, length).shipments()
                yield pa.RecordBatch.from_pylist([{"part": row["part"], **x} for x in out], schema=pa.schema([("part", pa.int64()), ("shard", pa.int32()), ("seeds", pa.binary()), ("docs", pa.binary()), ("lengths", pa.binary()), ("bytes", pa.binary())]))

    shipped = texts.join(asked, "part").mapInArrow(ship, "part long, shard int, seeds binary, docs binary, lengths binary, bytes binary")
    sorted_shards = shipped.groupBy("shard").applyInArrow(lambda group: _shard(group, length), "part long, shard int, least binary")
    least = sorted_shards.groupBy("part").agg(F.collect_list(F.struct("shard", "least")).alias("least"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _marked(row, buckets, length)

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>"
    return texts.join(asked, "part", "left").join(written(least, "smallest-documents"), "part", "left").mapInArrow(mark, out)


def _marked(row: dict, buckets: int, length: int) -> pa.RecordBatch:
    import zstandard

    data, bounds, ids = _opened(row)
    step = np.zeros(len(data) + 1, np.int32)
    if row["answers"]:
        strings = Strings(data, bounds, ids, row["answers"], buckets, length)
        opener = zstandard.ZstdDecompressor()
        answers = {a["shard"]: np.frombuffer(opener.decompress(a["least"]), np.int64) for a in row["least"] or []}
        size = np.array([len(t) - length + 1 for t in strings.texts], np.int64)
        # windows of string i are flat[place[i]:place[i] + size[i]]
        flat = np.concatenate([answers[s] for s in sorted(answers)] or [np.zeros(0, np.int64)])
        place = np.zeros(len(size), np.int64)
        place[strings.order] = np.cumsum(size[strings.order]) - size[strings.order]
        run = np.repeat(np.arange(len(strings.start)), strings.count)
        within = np.arange(len(run)) - np.repeat(np.cumsum(strings.count) - strings.count, strings.count)
        hit = flat[place[strings.string[run]] + within] < ids[strings.row[run]]
        at = strings.start[run[hit]] + within[hit]
        np.add.at(step, at, 1)
        np.add.at(step, at + length, -1)
    gone = np.cumsum(step[:-1]) > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first = gone.copy()
    first[1:] &= ~gone[:-1] | edge[1:-1]
    last = gone.copy()
    last[:-1] &= ~gone[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(bounds, starts, side="right") - 1
    spans = np.bincount(owner, minlength=len(ids)).astype(np.int64)
    raw, keep = data.tobytes(), ~gone
    removed = tb.sums(gone, bounds)
    digests = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        digests.append(hashlib.sha256(data[a:b][keep[a:b]].tobytes() if removed[i] else raw[a:b]).hexdigest())
    listed = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(spans)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(starts - bounds[owner]), pa.array(stops - bounds[owner])], names=["start", "stop"]),
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, mask=ids == NO_ID), pa.array(np.diff(bounds)), pa.array(removed.astype(np.int64)), pa.array(spans), pa.array(digests, pa.string()), listed],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
    )
