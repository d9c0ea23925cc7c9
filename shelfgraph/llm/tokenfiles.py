"""Token ids as binary files with a shared zstandard dictionary.

Texts are encoded with a public tokenizer and an end id. Each document's ids are one array (16-bit where
all ids fit, else 32-bit), compressed on its own with a dictionary that was trained on the arrays of a
bounded sample. Documents lie in ascending doc_id order: a range of ids is a shard, a shard is cut into
packs, and a pack row holds the frames, an index entry per document (id, offset, length, tokens) and the
dictionary's hash. Rows of packs live in Parquet, the container that Spark writes to and reads from any
store; a single document is fetched by filtering on the pack's id range and decompressing one frame.

Defined cases: null and empty texts hold the end id only. Rows that repeat a doc_id each keep a
document, ordered by their frames. Rows without a doc_id sort first. An empty table makes empty files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.llm import textbytes as tb
from shelfgraph.llm.durable import shared_path
from shelfgraph.llm.subwords import VOCABULARY, Encoder

END = 0
SAMPLE = 1000  # documents that the dictionary is trained on, chosen by hash
DICTIONARY_BYTES = 64 << 10
PACK_BYTES = 1 << 20
SHARD_ROWS = 4096
INDEX = np.dtype([("doc_id", "<i8"), ("null", "<u1"), ("offset", "<u4"), ("length", "<u4"), ("tokens", "<u8")])
PACKS = "shard int, pack int, first_doc long, last_doc long, documents int, shard_start long, tokens long, dictionary string, index binary, frames binary"


def serialize(ids: np.ndarray) -> bytes:
    """A width byte, then the ids."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" if small else b"\x04") + ids.astype("<u2" if small else "<u4").tobytes()


def deserialize(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.uint32)


def encode_rows(encoder: Encoder, text: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with the end id) of every text."""
    for lo, hi in tb.slices(text):
        ids, bounds = encoder.encode(*tb.flat(text[lo:hi]))
        for i in range(hi - lo):
            yield lo + i, np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end))


def train_dictionary(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> bytes:
    """A dictionary trained on the serialized ids of SAMPLE documents; empty where too few exist."""
    import zstandard

    chosen = docs.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([serialize(ids) for _, ids in encode_rows(encoder, tb.column(batch, "text"), end)], pa.binary())], names=["ids"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text")
    samples = sorted(bytes(r["ids"]) for r in texts.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def digest(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, shard_rows: int = SHARD_ROWS) -> None:
    """Encode docs (doc_id, text) into packs under path, with the dictionary beside them."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, vocabulary, end)
    name = digest(dictionary)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    rows = ids.count()
    shards = max(1, -(-rows // shard_rows))
    marks = [k / shards for k in range(1, shards)]
    edges = np.array(sorted(set(ids.approxQuantile("doc_id", marks, 0.1 / shards))) if marks else [], dtype=np.float64).astype(np.int64)
    shared = spark.sparkContext.broadcast((dictionary, edges))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bounds = shared.value
        encoder, compressor = Encoder(vocabulary), _compressor(known)
        for batch in batches:
            doc, text = batch.column(0), tb.column(batch, "text")
            shard = np.searchsorted(bounds, doc.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)
            for lo, hi in tb.slices(text):
                frames, tokens = [], []
                for _, ids in encode_rows(encoder, text[lo:hi], end):
                    frames.append(compressor.compress(serialize(ids)))
                    tokens.append(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(shard[lo:hi]), doc[lo:hi], pa.array(tokens, pa.int64()), pa.array(frames, pa.binary())], names=["shard", "doc_id", "tokens", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = None, 0, 0
        held: list[tuple] = []
        size = 0

        def close():
            index = np.zeros(len(held), INDEX)
            offset = 0
            for entry, (doc, tokens, frame) in zip(index, held, strict=True):
                entry["doc_id"], entry["null"], entry["offset"], entry["length"], entry["tokens"] = doc or 0, doc is None, offset, len(frame), tokens
                offset += len(frame)
            ids = [d for d, _, _ in held if d is not None]
            row = [[shard], [number], [min(ids, default=None)], [max(ids, default=None)], [len(held)], [start], [int(index["tokens"].sum())], [name], [index.tobytes()], [b"".join(f for _, _, f in held)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in PACKS.split(", ")])

        for batch in batches:
            for s, doc, tokens, frame in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (s != shard or size + len(frame) > PACK_BYTES):
                    yield close()
                    start += sum(t for _, t, _ in held)
                    number, held, size = number + 1, [], 0
                if s != shard:
                    shard, number, start = s, 0, 0
                held.append((doc, tokens, frame))
                size += len(frame)
        if held:
            yield close()

    frames = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(compress, "shard int, doc_id long, tokens long, frame binary")
    ordered = frames.repartition(shards, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "frame")
    ordered.mapInArrow(pack, PACKS).write.parquet(f"{path}/packs")
    spark.createDataFrame([(name, bytearray(dictionary))], "dictionary string, content binary").coalesce(1).write.parquet(f"{path}/dictionary")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    content = bytes(row["content"])
    if digest(content) != row["dictionary"]:
        raise ValueError(f"the dictionary under {path} does not have its recorded hash")
    return content


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens before the document), n_tokens, ids (little-endian, 32 bits each), from the files."""
    packs = spark.read.parquet(f"{path}/packs")
    # one row per shard: a shard's first token is the sum of the shards before it
    totals = {r["shard"]: r["n"] for r in packs.groupBy("shard").agg(F.sum("tokens").alias("n")).collect()}
    base, total = {}, 0
    for shard in sorted(totals):
        base[shard] = total
        total += totals[shard]
    shared = spark.sparkContext.broadcast((_dictionary(spark, path), base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, starts = shared.value
        name, decompressor = digest(dictionary), _decompressor(dictionary)
        for batch in batches:
            for shard, start, used, index, frames in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if used != name:
                    raise ValueError("a pack was compressed with another dictionary")
                entries = np.frombuffer(index, INDEX)
                ids = [deserialize(decompressor.decompress(frames[e["offset"] : e["offset"] + e["length"]])) for e in entries]
                tokens = np.array([len(x) for x in ids], np.int64)
                if not np.array_equal(tokens, entries["tokens"].astype(np.int64)):
                    raise ValueError("a pack's index disagrees with its frames")
                doc = pa.array(entries["doc_id"], mask=entries["null"] == 1)
                yield pa.RecordBatch.from_arrays([doc, pa.array(starts[shard] + start + np.cumsum(tokens) - tokens), pa.array(tokens), tb.binary(ids)], names=["doc_id", "start", "n_tokens", "ids"])

    return packs.select("shard", "shard_start", "dictionary", "index", "frames").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document: only the packs whose range holds it are read, one frame is decompressed."""
    decompressor = _decompressor(_dictionary(spark, path))
    near = spark.read.parquet(f"{path}/packs").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("shard", "pack")
    out = []
    for row in near.select("index", "frames").toLocalIterator():
        for e in np.frombuffer(row["index"], INDEX):
            if e["doc_id"] == doc_id and not e["null"]:
                out.append(deserialize(decompressor.decompress(bytes(row["frames"][e["offset"] : e["offset"] + e["length"]]))))
    return out


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write docs to new files on shared storage and read them back."""
    path = shared_path(docs.sparkSession, "tokens")
    write(docs, path, **options)
    return read(docs.sparkSession, path)
