"""Ranked lexical search over a length-stratified index.

Documents with an equal length normaliser m form a stratum: there a posting's impact depends on tf alone, so it is computed once per tf, and the largest tf of a
term bounds what the term can add in the stratum. The index holds the documents sorted by m, each with the postings of the terms that items ask for;
a task reads a run of it, forms postings by (term, tf) for every stratum, and visits strata in the order of their bounds.

1. One pass over the texts gives every document's length and postings; corpus counts come from that table.
2. The index is written in the order of m. Equal m is cut by row number, so a stratum of any size spreads over tasks.
3. Every stratum's bound for every item is taken from its largest tf; the FIRST strata with the highest bounds are searched first.
4. The k-th score found there is the item's bar. A second pass searches the other strata whose bound reaches the bar, which rises as better documents are found.
   A bound below the bar cannot hold a result, not even by a tie, so the results are exact.

Items go through in blocks of at most BLOCK_BYTES of text; terms are known by 64-bit hashes. Documents without a term count for nothing, as they have no
part in N or L.

Defined cases: null text has no terms. Each row is a document of its own: ids may repeat, and a null id is ranked after all others of its score.
Every item row gets its own list, null and repeated item ids too; items without terms give no rows. Very long texts are whole.
Empty tables give an empty result. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.llm import textbytes as tb
from shelfgraph.llm.durable import written

TOP = 20
FIRST = 8  # strata that are searched before the bar is set
BLOCK_BYTES = 8 << 20
SHARD = 4096  # documents of one stratum scored at a time
ACTIVE = 256  # items scored at a time
MERGE = 64  # lists of an item are merged in so many parts first
SALT = 12  # fixed values of the score: 1000 * tf + 12 * m
TABLE_BITS = 18


@dataclass
class Block:
    """Items as (item, term, repeats) triples over sorted term hashes."""

    ids: list  # item ids, by row
    vocabulary: np.ndarray  # sorted hashes
    item: np.ndarray
    term: np.ndarray
    repeats: np.ndarray

    def table(self) -> np.ndarray:
        """Which leading hash bits occur, so that most words are told apart by one look-up."""
        out = np.zeros(1 << TABLE_BITS, bool)
        out[(self.vocabulary >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        return out


def terms_of(texts: pa.Array) -> tb.Words:
    return tb.Words(*tb.flat(texts), tb.LETTERED, fold=True)


def prepare(rows: list) -> Block:
    found = terms_of(pa.array([text or "" for _, text in rows], pa.string()))
    vocabulary, term = np.unique(found.hash, return_inverse=True)
    key, repeats = np.unique(found.owner() * max(len(vocabulary), 1) + term.reshape(-1), return_counts=True)
    return Block([i for i, _ in rows], vocabulary, key // max(len(vocabulary), 1), key % max(len(vocabulary), 1), repeats.astype(np.int64))


def blocks(items: DataFrame) -> Iterator[Block]:
    """The items in blocks of bounded bytes, one at a time on the driver."""
    rows, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").encode())
        if rows and size + n > BLOCK_BYTES:
            yield prepare(rows)
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += n
    if rows:
        yield prepare(rows)


FACTS = "doc_id long, n long, term array<int>, tf array<int>"


def postings(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, n, term, tf: every document with a term, and its postings of the block's terms."""
    shared = docs.sparkSession.sparkContext.broadcast((block.vocabulary, block.table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shared.value
        for batch in batches:
            texts = tb.column(batch, "text")
            for a, b in tb.slices(texts):
                found = terms_of(texts.slice(a, b - a))
                seen = np.flatnonzero(table[(found.hash >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]) if len(known) else np.zeros(0, np.int64)
                place = np.searchsorted(known, found.hash[seen])
                seen, place = (x[known[np.minimum(place, len(known) - 1)] == found.hash[seen]] for x in (seen, place)) if len(known) else (seen, place)
                row = np.searchsorted(found.bounds, seen, side="right") - 1
                key, tf = np.unique(row * max(len(known), 1) + place, return_counts=True)
                counts = np.bincount(key // max(len(known), 1), minlength=b - a)
                full = np.flatnonzero(found.counts)
                term = tb.list_array((key % max(len(known), 1)).astype(np.int32), counts[full], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(full)).cast(pa.int64()), pa.array(found.counts[full].astype(np.int64)), term, tb.list_array(tf.astype(np.int32), counts[full], pa.int32())],
                    names=["doc_id", "n", "term", "tf"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, FACTS)


def document_frequencies(facts: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    for r in facts.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1000000000 * tf) // (1000 * tf + SALT * m)


@dataclass
class Stratum:
    """Postings of some documents of equal m, in runs of equal (term, tf), largest tf first."""

    m: int
    rows: np.ndarray  # of the batch
    term: np.ndarray  # distinct, ascending
    first: np.ndarray  # first posting of each term
    gain: np.ndarray  # impact of each posting
    local: np.ndarray  # its document
    best: np.ndarray  # largest impact of each term


def strata(batch: pa.RecordBatch) -> Iterator[Stratum]:
    """Runs of equal m of a batch in the order of m, cut at SHARD documents."""
    m = batch.column(batch.schema.get_field_index("m")).to_numpy()
    lists = batch.column(batch.schema.get_field_index("term"))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets, shift = offsets - offsets[0], offsets[0]
    term = lists.values.to_numpy()[shift : shift + offsets[-1]]
    counts = batch.column(batch.schema.get_field_index("tf"))
    tf = counts.values.to_numpy()[counts.offsets[0].as_py() :][: offsets[-1]]
    edges = np.append(np.flatnonzero(np.diff(m, prepend=m[:1] - 1)), len(m))
    for a, z in zip(edges[:-1], edges[1:]):
        for s in range(a, z, SHARD):
            e = min(z, s + SHARD)
            mine = slice(offsets[s], offsets[e])
            t, f = term[mine], tf[mine]
            local = np.repeat(np.arange(e - s), np.diff(offsets[s : e + 1]))
            order = np.lexsort((local, -f, t))
            t, f, local = t[order], f[order], local[order]
            first = np.flatnonzero(np.diff(t, prepend=-1))
            levels, level = np.unique(f, return_inverse=True)
            gain = impact(levels, int(m[s]))[level.reshape(-1)]  # once per tf
            yield Stratum(int(m[s]), np.arange(s, e), t[first], first, gain, local, gain[first])


def bounds_of(stratum: Stratum, block: Block, weight: np.ndarray) -> np.ndarray:
    """The most that a document of the stratum can score for each item."""
    best = np.zeros(len(weight), np.int64)
    best[stratum.term] = stratum.best
    return tb.sums(weight[block.term] * best[block.term] * block.repeats, np.searchsorted(block.item, np.arange(len(block.ids) + 1)))


class Leaders:
    """The k best documents of each item so far: score, id, whether the id is null."""

    def __init__(self, k: int, bar: np.ndarray):
        self.k, self.bar = k, bar.copy()
        self.held: dict[int, np.ndarray] = {}

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        good = np.flatnonzero(scores >= max(self.bar[item], 1))
        if not len(good):
            return
        new = np.stack([scores[good], ids[good], absent[good].astype(np.int64)], axis=1)
        both = np.concatenate([self.held[item], new]) if item in self.held else new
        order = np.lexsort((both[:, 1], both[:, 2], -both[:, 0]))[: self.k]
        self.held[item] = both[order]
        if len(order) == self.k:
            self.bar[item] = max(self.bar[item], both[order[-1], 0])

    def rows(self, block: Block) -> pa.RecordBatch:
        item = np.repeat(np.array(list(self.held), np.int64), [len(x) for x in self.held.values()])
        data = np.concatenate([np.zeros((0, 3), np.int64), *self.held.values()])
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(data[:, 1], mask=data[:, 2] == 1), pa.array(data[:, 0])], names=["item", "doc_id", "score"])


def visit(stratum: Stratum, items: np.ndarray, block: Block, weight: np.ndarray, ids: np.ndarray, absent: np.ndarray, best: Leaders) -> None:
    """Scores of all documents of a stratum for some items."""
    slot = np.full(len(weight), -1)
    slot[stratum.term] = np.arange(len(stratum.term))
    ends = np.append(stratum.first[1:], len(stratum.local))
    edge = np.searchsorted(block.item, np.arange(len(block.ids) + 1))
    n = len(stratum.rows)
    for s in range(0, len(items), ACTIVE):
        some = items[s : s + ACTIVE]
        total = np.zeros((len(some), n), np.int64)
        for k, item in enumerate(some):
            mine = np.arange(edge[item], edge[item + 1])
            at = slot[block.term[mine]]
            mine, at = mine[at >= 0], at[at >= 0]
            scale = weight[block.term[mine]] * block.repeats[mine]
            size = ends[at] - stratum.first[at]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - stratum.first[at], size)
            np.add.at(total[k], stratum.local[place], stratum.gain[place] * np.repeat(scale, size))
        for k, item in enumerate(some):
            best.offer(int(item), total[k], ids[stratum.rows], absent[stratum.rows])


def first_strata(index: DataFrame, block: Block, weight: np.ndarray) -> DataFrame:
    """item, m of the strata with the highest bounds of each item, at most FIRST."""
    shared = index.sparkSession.sparkContext.broadcast((block, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, scale = shared.value
        for batch in batches:
            for stratum in strata(batch):
                bound = bounds_of(stratum, items, scale)
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), stratum.m)), pa.array(bound[some])], names=["item", "m", "bound"])

    tops = index.select("m", "term", "tf").mapInArrow(run, "item long, m long, bound long").groupBy("item", "m").agg(F.max("bound").alias("bound"))
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    return tops.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST).select("item", "m")


def candidates(index: DataFrame, block: Block, weight: np.ndarray, k: int, bar: np.ndarray, first: dict[int, set[int]], opening: bool) -> DataFrame:
    """item, doc_id, score: each task's k best documents of every item, in the first strata or in all others."""
    shared = index.sparkSession.sparkContext.broadcast((block, weight, bar, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, scale, least, chosen = shared.value
        best = Leaders(k, least)
        for batch in batches:
            name = batch.column(batch.schema.get_field_index("doc_id"))
            absent = name.is_null().to_numpy(zero_copy_only=False)
            ids = name.fill_null(0).to_numpy()
            parts = list(strata(batch))
            ceilings = [bounds_of(p, items, scale) for p in parts]
            for p in sorted(range(len(parts)), key=lambda p: -int(ceilings[p].max(initial=0))):
                now = np.zeros(len(items.ids), bool)
                now[list(chosen.get(parts[p].m, ()))] = True
                now = (now == opening) & (ceilings[p] >= np.maximum(best.bar, 1))
                visit(parts[p], np.flatnonzero(now), items, scale, ids, absent, best)
        yield best.rows(items)

    return index.mapInArrow(run, "item long, doc_id long, score long")


def leading(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, with rank; lists are merged in parts, so no task takes the lists of all tasks."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = found.withColumn("part", F.spark_partition_id() % MERGE)
    for keys in (["item", "part"], ["item"]):
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return part.select("item", "rank", "doc_id", "score")


def search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    spark = docs.sparkSession
    facts = written(postings(docs, block), "postings")
    corpus = facts.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    n_docs, n_terms = corpus["n_docs"], corpus["n_terms"]
    weight = weights(n_docs, document_frequencies(facts, len(block.vocabulary)))
    m = F.lit(75) + F.expr(f"(25L * n * {n_docs}L) div {max(n_terms, 1)}L")
    laid = facts.where(F.size("term") > 0).select(m.cast("long").alias("m"), F.xxhash64(F.monotonically_increasing_id()).alias("cut"), "doc_id", "term", "tf")
    index = written(laid.repartitionByRange("m", "cut").sortWithinPartitions("m").drop("cut"), "strata")
    first: dict[int, set[int]] = {}
    for r in first_strata(index, block, weight).toLocalIterator():
        first.setdefault(r["m"], set()).add(r["item"])
    bar = np.zeros(len(block.ids), np.int64)
    opened = written(leading(candidates(index.where(F.col("m").isin(list(first))), block, weight, k, bar, first, True), k), "opened")
    for r in opened.where(F.col("rank") == k).toLocalIterator():
        bar[r["item"]] = r["score"]
    rest = candidates(index, block, weight, k, bar, first, False)
    ranked = leading(rest.unionByName(opened.select("item", "doc_id", "score")), k)
    # ids of the items: as many rows as the block has items
    names = spark.createDataFrame([(k, i) for k, i in enumerate(block.ids)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    out = None
    for block in blocks(items):
        found = written(search_block(docs, block, k), "ranked")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
