"""Language-model scores: exact corpus unigrams, and a causal self-attention model on subword ids.

Texts are stored once in flushes: the word counts of each text, its subword ids, and the distinct words
of the flush filed by hash bucket with their counts in learnable texts. Buckets add the counts up over the
corpus and answer each flush; flushes are bucketed by their number, so an answer meets its flush without
moving it. The attention model takes the frequency of every subword, what follows what, and its weights from all
learnable texts: the first two are counted; of the weights, a bounded sample gives the start, then every window of every
learnable text is learnt from once, flush by flush, and the flushes' weights are averaged. Windows overlap so that each id is scored once.

Words are known by a 64-bit hash of their bytes with A-Z in lower case.

Defined cases: null and empty texts are one end token. Rows that repeat a doc_id are scored each. Rows
without a doc_id are learnable. With nothing to learn from, every count is 0 and the attention model keeps
its starting weights. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm import attention
from shelfgraph.llm import textbytes as tb
from shelfgraph.llm.durable import written
from shelfgraph.llm.subwords import VOCABULARY, Encoder

FLUSH_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
SAMPLE = 600  # learnable texts, chosen by hash, that give the weights from which the pass over all learnable texts starts
FIXED = 2.0**24  # weights are summed as whole multiples of its inverse
SIZE = 50257  # ids of the vocabulary; the end id follows them
END_WORD = np.uint64(0x7E57E17D00C5E17D)
TOTALS = -1  # the part under which a bucket reports its tokens and distinct words

STORED = "part long, ids binary, held binary, words binary, counts binary, rows binary, subwords binary, bounds binary, filed array<struct<bucket: int, words: binary, counts: binary>>"


def _packed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _opened(blob: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind) if blob else np.zeros(0, kind)


def word_table(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """Distinct words by bucket then hash, and each text's words as (index, count) pairs with their ranges."""
    words = tb.Words(data, offsets, ~tb.BLANK, fold=True)
    n = len(offsets) - 1
    key = np.append(words.hash, np.full(n, END_WORD))
    row = np.append(words.owner(), np.arange(n))
    distinct, inverse = np.unique(key, return_inverse=True)
    bucket = (distinct >> np.uint64(24)) % np.uint64(buckets)
    order = np.lexsort((distinct, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pair, count = np.unique(row << 32 | place[inverse], return_counts=True)
    return distinct[order], bucket[order].astype(np.int32), pair & 0xFFFFFFFF, count, np.searchsorted(pair >> 32, np.arange(n + 1))


def _even(size: int) -> int:
    """Bytes of a flush, so that a batch of that size falls into flushes of about one size, each of at most FLUSH_BYTES.

    A small rest would be learnt from several times over, to take as many steps as other flushes.
    """
    return min(FLUSH_BYTES, -(-size // max(1, -(-size // FLUSH_BYTES))) + tb.SLICE_BYTES // 16)


def _merge(key: tuple, group: pa.Table) -> pa.Table:
    """Corpus counts of one bucket's words, as an answer to every flush, and the bucket's totals."""
    words = [np.frombuffer(x, np.uint64) for x in group.column("words").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("counts").to_pylist()])
    distinct, inverse = np.unique(np.concatenate(words), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, inverse, counts)
    edges = np.append(0, np.cumsum([len(w) for w in words]))
    blobs = [_packed(total[inverse[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    parts = [*group.column("part").to_pylist(), TOTALS]
    blobs.append(np.array([total.sum(), (total > 0).sum()], np.int64).tobytes())
    return pa.table([pa.array(parts, pa.int64()), pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "bucket", "totals"])


def _sample(docs: DataFrame, vocabulary: str) -> list[np.ndarray]:
    """Ids of SAMPLE learnable texts."""
    chosen = docs.where("not held_out").select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            text = tb.column(batch, "text")
            for lo, hi in tb.slices(text):
                ids, bounds = encoder.encode(*tb.flat(text[lo:hi]))
                yield pa.RecordBatch.from_arrays([tb.binary(np.split(ids, bounds[1:-1]))], names=["ids"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(run, "ids binary").collect()
    return [np.frombuffer(x, np.uint32).astype(np.int64) for x in sorted(bytes(r["ids"]) for r in rows)]


def score(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text, held_out)."""
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, volume // BUCKET_BYTES)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), volume // (8 * FLUSH_BYTES))
    flushes = f"texts_{uuid.uuid4().hex}"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = Encoder(vocabulary), TaskContext.get().partitionId() << 32
        for batch in batches:
            text, held = tb.column(batch, "text"), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            doc = batch.column(0)
            for lo, hi in tb.slices(text, _even(len(tb.flat(text)[0]))):
                own = held[lo:hi]
                words, bucket, index, count, rows = word_table(*tb.flat(text[lo:hi]), buckets)
                learnt = np.bincount(index, count * np.repeat(~own, np.diff(rows)), minlength=len(words)).astype(np.uint32)
                edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                filed = pa.StructArray.from_arrays([pa.array(bucket[edges]), tb.binary(np.split(words, edges[1:])), tb.binary(np.split(learnt, edges[1:]))], names=["bucket", "words", "counts"])
                ids, sizes = [], []
                for a, b in tb.slices(text[lo:hi]):
                    found, bounds = encoder.encode(*tb.flat(text[lo + a : lo + b]))
                    ids.append(found)
                    sizes.append(np.diff(bounds))
                blobs = [
                    _int64(doc[lo:hi]).tobytes() + np.asarray(doc[lo:hi].is_null()).astype(np.uint8).tobytes(), own.tobytes(), _packed(index.astype(np.uint32)), _packed(count.astype(np.uint32)),
                    rows.astype(np.int64).tobytes(), _packed(np.concatenate(ids).astype(np.uint16)), np.append(0, np.cumsum(np.concatenate(sizes))).astype(np.int64).tobytes(),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), *(pa.array([x], pa.binary()) for x in blobs), pa.ListArray.from_arrays(pa.array([0, len(edges)], pa.int32()), filed)],
                    names=[c.split()[0] for c in STORED.split(", ")[:8]] + ["filed"],
                )
                number += 1

    docs.select("doc_id", "text", "held_out").mapInArrow(store, STORED).write.bucketBy(tasks, "part").saveAsTable(flushes)
    stored = spark.table(flushes)

    filed = stored.select("part", F.explode("filed").alias("f")).select("part", "f.bucket", "f.words", "f.counts")
    answers = written(filed.groupBy("bucket").applyInArrow(_merge, "part long, bucket int, totals binary"), "word-counts")
    totals = [np.frombuffer(bytes(r["totals"]), np.int64) for r in answers.where(F.col("part") == TOTALS).select("totals").collect()]
    tokens, kinds = (int(x) for x in np.sum(totals, axis=0)) if totals else (0, 0)
    counts = _subword_counts(stored)
    model = _trained(stored, attention.fit(counts, _sample(docs, vocabulary), follow=_followers(stored, counts)))
    shared = spark.sparkContext.broadcast(model)
    by_part = answers.where(F.col("part") != TOTALS).groupBy("part").agg(F.collect_list(F.struct("bucket", "totals")).alias("answers"))
    joined = stored.select("part", "ids", "words", "counts", "rows", "subwords", "bounds").join(by_part, "part")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _rated(row, tokens, kinds, shared.value)

    return joined.mapInArrow(rate, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _int64(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _subword_counts(stored: DataFrame) -> np.ndarray:
    """Counts of every subword id, and of the end, over all learnable texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for held, ids, bounds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                learnt = ~np.frombuffer(held, bool)
                keep = np.repeat(learnt, np.diff(np.frombuffer(bounds, np.int64)))
                total += np.bincount(_opened(ids, np.uint16)[keep], minlength=SIZE + 1)
                total[SIZE] += learnt.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(SIZE + 1, np.int64)
    for r in stored.select("held", "subwords", "bounds").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def _learnable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the learnable texts of each flush (held, subwords, bounds) and the offsets of each text in them."""
    for row in batch.to_pylist():
        own, sizes = ~np.frombuffer(row["held"], bool), np.diff(np.frombuffer(row["bounds"], np.int64))
        if own.any():
            yield _opened(row["subwords"], np.uint16)[np.repeat(own, sizes)].astype(np.int64), np.append(0, np.cumsum(sizes[own]))


def _followers(stored: DataFrame, counts: np.ndarray) -> np.ndarray:
    """attention.followers() of all learnable texts."""
    shared = stored.sparkSession.sparkContext.broadcast(attention.classify(counts.astype(float))[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(attention.FOLLOWERS, np.int64)
        for batch in batches:
            for ids, bounds in _learnable(batch):
                total += attention.followers(ids, bounds, shared.value)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["at", "n"])

    found = stored.select("held", "subwords", "bounds").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(attention.FOLLOWERS, np.int64)
    out.reshape(-1)[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def _trained(stored: DataFrame, start: attention.Model) -> attention.Model:
    """The model after a pass over all learnable texts; its values stay, as they are counted over all of them.

    Each flush learns on its own from the start, and the results are averaged by their windows. Sums are of
    whole numbers, so the order of flushes changes no score; which texts share a flush follows the table's files, so the same
    rows in other files train slightly other weights.
    """
    shared = stored.sparkSession.sparkContext.broadcast(start)
    names = sorted(start.weights.keys() - {"value"})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for ids, bounds in _learnable(batch):
                weights, n = attention.learnt(shared.value, ids, bounds)
                flat = np.concatenate([(weights[k] - shared.value.weights[k]).reshape(-1) for k in names]).astype(np.float64)
                one = np.append(np.round(flat * FIXED).astype(np.int64) * n, n)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "n"])

    rows = stored.select("held", "subwords", "bounds").mapInArrow(learn, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return start
    total = np.zeros(len(rows), np.int64)
    for r in rows:
        total[r["at"]] = r["n"]
    change, at = total[:-1] / FIXED / total[-1], 0
    weights = dict(start.weights)
    for k in names:
        old = start.weights[k]
        weights[k] = (old + change[at : at + old.size].reshape(old.shape)).astype(np.float32)
        at += old.size
    return attention.Model(start.kind, start.inner, weights)


def _rated(row: dict, tokens: int, kinds: int, model: attention.Model) -> pa.RecordBatch:
    answers = sorted(row["answers"], key=lambda a: a["bucket"])
    known = np.concatenate([_opened(a["totals"], np.int64) for a in answers])
    index, count = _opened(row["words"], np.uint32), _opened(row["counts"], np.uint32).astype(np.int64)
    rows, bounds = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["bounds"], np.int64)
    n = len(rows) - 1
    logs = np.log10((known + 1.0) / (tokens + kinds + 1.0))
    ids = _opened(row["subwords"], np.uint16)
    scored = np.zeros(n)
    for lo, hi in _texts(bounds):
        part = bounds[lo : hi + 1]
        scored[lo:hi] = attention.log10_probabilities(model, ids[part[0] : part[-1]].astype(np.int64), part - part[0])
    raw = row["ids"]
    doc = pa.array(np.frombuffer(raw[: 8 * n], np.int64), mask=np.frombuffer(raw[8 * n :], np.uint8) == 1)
    return pa.RecordBatch.from_arrays(
        [doc, pa.array(tb.sums(count, rows)), pa.array(tb.sums(count * (known[index] > 0), rows)), pa.array(np.full(n, tokens)), pa.array(tb.sums(count * logs[index], rows)), pa.array(scored)],
        names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def _texts(bounds: np.ndarray, limit: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most limit ids, or one longer text."""
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi
