"""Near-duplicate classes: weighted five-word shingles, BagMinHash bands, verified multiset overlap.

Texts with equal shingle multisets are one node, so exact copies cost one row each. Nodes meet where a
band of their signatures agrees. A bucket is not expanded to pairs: each member is paired with one
centre, at first the node that shares most buckets, which among edited copies is their original. Pairs
whose registers agree far below the threshold are dropped, the others verified by multiset overlap, and
verified links form components. Buckets whose members still lie in several components are dealt
again, with another centre in every bucket, and small ones pair by pair. What is still open then is
finished: the nodes outside a bucket's greatest component meet all nodes of the bucket, block against block. Such a cell
computes the overlap of all its pairs as one matrix product over the shingles that both blocks hold, and returns only links that join two of its
trees, so its output is linear in its nodes however many of its pairs are alike. Classes are the components of verified links.

Bands of 5 registers out of 150 miss a pair of similarity 0.8 with probability 7e-6.

Defined cases: words are `[^\\x20\\x09-\\x0D]+` in lower case. A text of one to four words has one shingle,
all its words. Texts without a word, null included, are equal to one another. Rows that repeat a
doc_id are rows of their own; rows without one belong to a class but never name it: a class of such rows only is named null. A class
is named by its least doc_id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfgraph.llm import bagminhash
from shelfgraph.llm import textbytes as tb
from shelfgraph.llm.components import components
from shelfgraph.llm.durable import written

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 30
ROWS = 5
SMALL = 6  # buckets of so many nodes are tested pair by pair in the last of the rounds with a centre
STARS = 2  # rounds with one centre in each bucket, before the pairs that these leave over
BLOCK = 512  # nodes of a bucket that are compared with another block at once
STRIP = 8192  # shingles of two blocks that are multiplied at once
BROADCAST_IDS = 4_000_000  # ids of crowded nodes, or of documents to drop, that a task holds at most (32 MB); more are joined by shuffle
#: Least share of agreeing registers of a pair that is worth verifying: six deviations below 0.8.
LIKELY = 0.6


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, their counts, and the range of each text."""
    words = tb.Words(*tb.flat(text), ~tb.BLANK, fold=True)
    key, index = tb.windows(words.hash, words.bounds, SHINGLE)
    owner = words.owner()
    row = owner[index]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            whole, at = tb.windows(words.hash, words.bounds, n)
            pick = np.searchsorted(at, words.bounds[short])
            key, row = np.append(key, whole[pick]), np.append(row, short)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(key)))
    return key[first], counts, np.searchsorted(row[first], np.arange(len(text) + 1))


def node_keys(key: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """16 bytes for the multiset of each text."""
    weight = counts.astype(np.uint64)
    one = tb.sums(tb.mix(key) * weight, bounds)
    two = tb.sums(tb.mix(key ^ tb.GOLDEN) * weight, bounds)
    return [a.tobytes() + b.tobytes() for a, b in zip(one, two, strict=True)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = tb.column(batch, "text")
        for lo, hi in tb.slices(text):
            key, counts, bounds = shingles(text[lo:hi])
            times = bagminhash.signatures(key, counts, bounds, BANDS * ROWS)
            parts = times.view(np.uint64).reshape(hi - lo, BANDS, ROWS)
            band = np.zeros((hi - lo, BANDS), np.uint64)
            for r in range(ROWS):
                band = tb.mix(band * tb.MIX_2 + parts[:, :, r])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[lo:hi],
                    pa.array(node_keys(key, counts, bounds), pa.binary()),
                    pa.array(tb.sums(counts, bounds)),
                    tb.list_array(band.view(np.int64).reshape(-1), np.full(hi - lo, BANDS), pa.int64()),
                    tb.binary((tb.mix(times.view(np.uint64)) & np.uint64(255)).astype(np.uint8)),
                ],
                names=["doc_id", "node", "size", "bands", "sketch"],
            )


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles for verification: 32 bits of each hash, sorted, with counts."""
    for batch in batches:
        text = tb.column(batch, "text")
        for lo, hi in tb.slices(text):
            key, counts, bounds = shingles(text[lo:hi])
            keys, sizes = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                short, inverse = np.unique((key[a:b] >> np.uint64(32)).astype(np.uint32), return_inverse=True)
                keys.append(short)
                total = np.minimum(np.bincount(inverse, counts[a:b], minlength=len(short)), 2**32 - 1).astype(np.uint32)
                # without repeats the counts go without saying
                sizes.append(total if (total != 1).any() else total[:0])
            yield pa.RecordBatch.from_arrays([pa.array(node_keys(key, counts, bounds), pa.binary()), tb.binary(keys), tb.binary(sizes)], names=["node", "keys", "counts"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for blobs in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            keys_a, counts_a, keys_b, counts_b = (np.frombuffer(x, np.uint32) for x in blobs)
            counts_a, counts_b = (c if len(c) else np.ones(len(k), np.uint32) for k, c in ((keys_a, counts_a), (keys_b, counts_b)))
            good.append(bagminhash.similarity(keys_a, counts_a.astype(np.int64), keys_b, counts_b.astype(np.int64)) >= SIMILARITY - 1e-12)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "linked"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose registers agree often enough to be worth verifying."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for i in (2, 3))
        share = (a == b).mean(axis=1) if len(a) else np.zeros(0)
        yield batch.select(["a", "b"]).filter(pa.array((share - 1 / 256) / (1 - 1 / 256) >= LIKELY))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) for every document."""
    return memberships(docs).select("doc_id", "class_id")


def memberships(docs: DataFrame) -> DataFrame:
    """doc_id, node, component, class_id: one row per document, with the key of its text and of its class."""
    described = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_describe, "doc_id long, node binary, size long, bands array<long>, sketch binary"), "described")
    same = [F.first(c).alias(c) for c in ("size", "bands", "sketch")]  # equal in all rows of a node
    nodes = written(described.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *same), "nodes")
    exploded = nodes.where("size > 0").select("node", F.posexplode("bands").alias("band", "value"))
    keyed = exploded.select(F.xxhash64("band", "value").alias("key"), "node")
    crowded = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = written(keyed.join(crowded, "key"), "buckets")
    degrees = buckets.groupBy("node").agg(F.sum("members").alias("degree"))
    facts = written(degrees.join(nodes.select("node", "size", "doc_id", "sketch"), "node"), "crowded-nodes")
    wanted = facts.select("doc_id").distinct()
    # a counted, bounded list of ids goes to the texts; otherwise both are shuffled
    wanted = F.broadcast(wanted) if facts.count() <= BROADCAST_IDS else wanted
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = named.join(wanted, "doc_id", "left_semi").select("text")
    spelt = "node binary, keys binary, counts binary"
    spellings = texts.mapInArrow(_spell, spelt)
    # nodes without any id are found by their own key
    nameless = facts.where("doc_id is null").select("node")
    if not nameless.isEmpty():
        spellings = spellings.unionByName(named.where("doc_id is null").select("text").mapInArrow(_spell, spelt).join(nameless, "node", "left_semi"))
    spelled = written(spellings.dropDuplicates(["node"]), "spelled")

    known, tested = facts.select("node", F.col("node").alias("component")), None
    for turn in range(STARS):
        pairs = _pairs(buckets, facts.drop("sketch", "doc_id").join(known, "node"), turn)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        sketches = facts.select("node", "sketch")
        both = pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
        likely = both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_agree, "a binary, b binary")
        result = _tested(likely, spelled)
        tested = result.select("a", "b") if tested is None else tested.unionByName(result.select("a", "b"))
        known = _merged(known, result)
    # all other pairs of crowded buckets whose ends still lie in different components
    known = _merged(known, written(_crossing(buckets, known, spelled), "crossing"))
    named = described.select("doc_id", "node").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return named.select("doc_id", "node", "component").join(least, "component").select("doc_id", "node", "component", "class_id")


def _tested(pairs: DataFrame, spelled: DataFrame) -> DataFrame:
    """a, b, linked of every pair."""
    joined = pairs.join(spelled.toDF("a", "keys_a", "counts_a"), "a").join(spelled.toDF("b", "keys_b", "counts_b"), "b")
    return written(joined.select("a", "b", "keys_a", "counts_a", "keys_b", "counts_b").mapInArrow(_verify, "a binary, b binary, linked boolean"), "tested")


def _merged(known: DataFrame, result: DataFrame) -> DataFrame:
    """node, component of all nodes after the links of result."""
    found = result.where("linked").select("a", "b")
    if found.isEmpty():
        return known
    # new links join the components so far, which are stars round their least node
    grouped = components(found.unionByName(known.where("node <> component").toDF("a", "b")))
    return written(known.select("node").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node")), "components")


def _columns(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle copy and size of each node's multiset: the t-th copy of a shingle is an element of its own."""
    key = [np.frombuffer(k, np.uint32) for k in keys]
    count = [np.frombuffer(c, np.uint32) if len(c) else np.ones(len(k), np.uint32) for k, c in zip(key, counts, strict=True)]
    flat, times = np.concatenate([*key, np.zeros(0, np.uint32)]).astype(np.uint64), np.concatenate([*count, np.zeros(0, np.uint32)]).astype(np.int64)
    row = np.repeat(np.arange(len(key)), [len(k) for k in key])
    copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(row, times), np.repeat(flat << np.uint64(32), times) | copy.astype(np.uint64), np.array([c.sum() for c in count], np.float64)


def _dense(row: np.ndarray, at: np.ndarray, rows: int, low: int, high: int) -> np.ndarray:
    out = np.zeros((rows, high - low), np.float32)
    mine = (at >= low) & (at < high)
    out[row[mine], at[mine] - low] = 1.0
    return out


def overlaps(left: tuple, right: tuple) -> np.ndarray:
    """Whether each pair of two blocks of multisets (keys, counts) reaches SIMILARITY; exact."""
    (row_a, key_a, size_a), (row_b, key_b, size_b) = _columns(*left), _columns(*right)
    both = np.intersect1d(key_a, key_b)
    shared = np.zeros((len(size_a), len(size_b)))
    held_a, held_b = np.isin(key_a, both), np.isin(key_b, both)
    at_a, at_b = np.searchsorted(both, key_a[held_a]), np.searchsorted(both, key_b[held_b])
    for low in range(0, len(both), STRIP):
        high = min(low + STRIP, len(both))
        shared += _dense(row_a[held_a], at_a, len(size_a), low, high) @ _dense(row_b[held_b], at_b, len(size_b), low, high).T
    whole = size_a[:, None] + size_b[None, :] - shared
    return shared >= (SIMILARITY - 1e-12) * whole


def _cross(cell: pa.Table) -> pa.Table:
    """Verified links of a cell that join two trees of its nodes; nodes of one component are joined from the start."""
    side = cell.column("left").to_numpy(zero_copy_only=False)
    node, component = (cell.column(n).to_pylist() for n in ("node", "component"))
    blobs = [cell.column(n).to_pylist() for n in ("keys", "counts")]
    at, to = np.flatnonzero(side), np.flatnonzero(~side)
    pick = lambda rows: tuple([blob[i] for i in rows] for blob in blobs)
    tree: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while tree.get(x, x) != x:
            tree[x] = tree.get(tree[x], tree[x])
            x = tree[x]
        return x

    names, code = np.unique(np.array([*component, b""], object)[:-1], return_inverse=True)
    linked = overlaps(pick(at), pick(to)) & (code[at][:, None] != code[to][None, :])
    i, j = np.nonzero(linked)
    # one link is enough between the same two components
    _, first = np.unique(code[at[i]] * len(names) + code[to[j]], return_index=True)
    a, b = [], []
    for x, y in zip(at[i[first]], to[j[first]], strict=True):
        one, two = root(component[x]), root(component[y])
        if one != two:
            tree[one] = two
            a.append(max(node[x], node[y]))
            b.append(min(node[x], node[y]))
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "linked": pa.array([True] * len(a), pa.bool_())})


def _crossing(buckets: DataFrame, known: DataFrame, spelled: DataFrame) -> DataFrame:
    """Links a, b that connect whatever is connected inside the buckets of more than SMALL nodes across components.

    One end of a link that matters is outside the bucket's greatest component. Those nodes meet all nodes of the bucket in cells
    of two blocks; a bucket of any size is dealt to many cells.
    """
    filed = buckets.where(F.col("members") > SMALL).select("key", "node").join(known, "node")
    parts = filed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("most < n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    held = written(filed.join(mixed.select("key", "main", blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("most")).alias("owns")), "key"), "open-buckets")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = held.where("component <> main").select("key", mine("owns").alias("own"), others("blocks").alias("block"), F.lit(True).alias("left"), "node", "component")
    right = held.select("key", others("owns").alias("own"), mine("blocks").alias("block"), F.lit(False).alias("left"), "node", "component")
    cells = left.unionByName(right).join(spelled, "node")
    return cells.groupBy("key", "own", "block").applyInArrow(_cross, "a binary, b binary, linked boolean")


def _pairs(buckets: DataFrame, placed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a > b) of nodes in one bucket and different components: each member with its bucket's centre.

    The first round's centre is the node of greatest degree; later rounds take any, another in each bucket.
    Small buckets give all their pairs from the second round on.
    """
    filed = buckets.join(placed, "node")
    rank = F.struct("degree", F.xxhash64("node"), "node") if turn == 0 else F.struct(F.xxhash64("node", "key", F.lit(turn)), F.col("node"))
    open_buckets = filed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max_by(F.struct("node", "size", "component"), rank).alias("centre")).where("lo <> hi")
    other = F.col("centre")
    paired = filed.join(open_buckets.select("key", "centre"), "key").select("node", "size", "component", other["node"].alias("other"), other["size"].alias("other_size"), other["component"].alias("other_component"))
    if turn:
        small = filed.where(F.col("members") <= SMALL)
        left = small.select("key", "node", "size", "component")
        right = small.select("key", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("component").alias("other_component"))
        paired = paired.unionByName(left.join(right, "key").drop("key"))
    fits = (F.col("component") != F.col("other_component")) & (F.least("size", "other_size") >= F.lit(SIMILARITY) * F.greatest("size", "other_size"))
    return paired.where(fits).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the node of each text in column _node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = tb.column(batch, "text")
            nodes = [k for lo, hi in tb.slices(text) for k in node_keys(*shingles(text[lo:hi]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], names=[*batch.schema.names, "_node"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_node", T.BinaryType())]))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id, with all columns of docs.

    Rows are judged by their own text: of rows that share an id only one whose text belongs to the class that the id names stays. A row without
    an id stays only where no row of its class has one, and one such row for each class.
    """
    found = written(memberships(docs), "classes")
    firsts = found.where("doc_id = class_id")
    again = written(found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated-ids")
    gone = written(found.where("doc_id <> class_id").select("doc_id").unionByName(again).distinct(), "gone-ids")
    # a counted, bounded list of ids goes to the documents, whose texts then stay where they are; otherwise both are shuffled
    wanted = docs.where(F.col("doc_id").cast("long").isNotNull())
    known = wanted.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)
    if not again.isEmpty():
        rows = _keyed(docs.join(again, "doc_id", "left_semi").select(docs.columns))
        mine = firsts.select("doc_id", F.col("node").alias("_node")).distinct()
        known = known.unionByName(rows.join(mine, ["doc_id", "_node"], "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))
    nameless = found.where("doc_id IS NULL AND class_id IS NULL").select(F.col("node").alias("_node"), "component").distinct()
    if not found.where("doc_id IS NULL").isEmpty():
        rows = _keyed(docs.where("doc_id IS NULL")).join(nameless.withColumnRenamed("component", "_component"), "_node")
        known = known.unionByName(rows.dropDuplicates(["_component"]).select(docs.columns))
    return known
