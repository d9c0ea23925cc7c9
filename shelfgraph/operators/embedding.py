"""Structural node embeddings by very sparse random projection (FastRP, Chen et al. 2019).

Every node starts from a sparse random vector. A propagation replaces a node's vector
by the L2-normalised mean of its neighbours' vectors, and the embedding is
a weighted sum of the propagations.

Nodes with the same neighbours (as a multiset) have the same vector after every
propagation, whatever their own starting vectors. They are therefore merged into one class
up front: the loop runs over classes, and a third of a catalogue made of
copies costs as much as one product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .skew import hot_keys, split_join

# Fixed values of the reference configuration.
DIMENSION = 256
ITERATION_WEIGHTS = (0.0, 1.0, 1.0, 1.0, 1.0)
SEED = 42


@dataclass(frozen=True)
class NodeClasses:
    """Classes of nodes with equal neighbourhoods, and their embeddings."""

    membership: DataFrame  # (node_key, cls); nodes without edges are absent
    vectors: DataFrame  # (cls, embedding array<double>)


def start_digests(keys: Sequence[str], blocks: int, seed: int):
    """md5 of "seed:key:block" for every key and block from 0, as a uint8 array (keys, blocks, 16).

    All messages of at most 55 bytes, the usual ones, are one md5 round of 64 bytes, computed side by side.
    """
    import hashlib

    import numpy as np

    head = f"{seed}:".encode()
    coded = [str(key).encode() for key in keys]
    length = np.array([len(c) for c in coded], dtype=np.int64)
    out = np.empty((len(coded), blocks, 16), np.uint8)
    tails = [f":{block}".encode() for block in range(blocks)]
    room = 55 - len(head) - max((len(t) for t in tails), default=0)
    for i in np.flatnonzero(length > room):
        out[i] = np.frombuffer(b"".join(hashlib.md5(head + coded[i] + t).digest() for t in tails), np.uint8).reshape(blocks, 16)
    short = np.flatnonzero(length <= room)
    chunk = max(1, 8192 // max(1, blocks))
    for low in range(0, len(short), chunk):
        at = short[low : low + chunk]
        n, width = len(at), max(1, int(length[at].max()))
        text = np.zeros((n, blocks, 64), np.uint8)
        text[:, :, : len(head)] = np.frombuffer(head, np.uint8)
        key = np.frombuffer(b"".join(coded[i].ljust(width, b"\0") for i in at), np.uint8).reshape(n, width)
        text[:, :, len(head) : len(head) + width] = key[:, None, :]
        row, end = np.arange(n), len(head) + length[at]
        for block, tail in enumerate(tails):
            for j, byte in enumerate(tail + b"\x80"):
                text[row, block, end + j] = byte
            bits = (end + len(tail)) * 8
            text[:, block, 56], text[:, block, 57] = bits & 255, bits >> 8
        words = np.ascontiguousarray(text.reshape(-1, 64).view("<u4").T)
        out[at] = _md5_blocks(words).reshape(n, blocks, 16)
    return out


def _md5_blocks(words):
    """md5 of single blocks, words (16, n) of uint32: (n, 16) bytes (RFC 1321)."""
    import numpy as np

    sine = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint32)
    turns = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in first)
    for i in range(64):
        if i < 16:
            mixed, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, g = c ^ (b | ~d), 7 * i % 16
        mixed += a
        mixed += sine[i]
        mixed += words[g]
        a, d, c = d, c, b
        b = b + ((mixed << np.uint32(turns[i])) | (mixed >> np.uint32(32 - turns[i])))
    state = np.stack([x + y for x, y in zip((a, b, c, d), first)], axis=1)
    return state.astype("<u4").view(np.uint8)


def starting_sums(edges: DataFrame, dimension: int, seed: int) -> DataFrame:
    """(cls, part array<double>): partial sums of the neighbours' starting vectors.

    The vector of a node is a function of its key alone, so no join or
    shuffle of vectors is needed. An md5 digest of "seed:key:block" holds
    eight 16-bit numbers; number modulo 6 gives +sqrt(3) for 0, -sqrt(3) for 1,
    otherwise 0. Any engine with md5 can repeat it, at any parallelism.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        blocks = -(-dimension // 8)
        value = np.array([3**0.5, -(3**0.5), 0.0, 0.0, 0.0, 0.0])
        for batch in batches:
            keys, at = np.unique(batch["dst"].to_numpy(dtype=str), return_inverse=True)
            raw = start_digests(keys, blocks, seed).tobytes()
            digit = (np.frombuffer(raw, dtype=">u2").reshape(len(keys), blocks * 8) % 6)[:, :dimension]
            start = value[digit]
            owner, group = np.unique(batch["cls"].to_numpy(dtype=str), return_inverse=True)
            order = np.argsort(group, kind="stable")
            first = np.searchsorted(group[order], np.arange(len(owner)))
            part = np.empty((len(owner), dimension))
            for low in range(0, dimension, 64):  # column strips keep the gathered copy small
                part[:, low : low + 64] = np.add.reduceat(start[at[order], low : low + 64], first, axis=0)
            yield pd.DataFrame({"cls": owner, "part": list(part)})

    return edges.select("cls", "dst").mapInPandas(sums, "cls string, part array<double>")


def _unit(vectors: DataFrame) -> DataFrame:
    return Normalizer(p=2.0, inputCol="_raw", outputCol="vec").transform(vectors).select("cls", "vec")


def propagate(class_edges: DataFrame, hubs: DataFrame, vectors: DataFrame) -> DataFrame:
    """One propagation: (cls, vec) from class edges (cls, dcls, w, hub) and the hubs (dcls).

    Edges to hubs, the bulk of a catalogue graph, are moved to their owner first, as
    short rows, and meet a broadcast of the at most HOT_SHARE hub vectors
    there: their sum needs no shuffle of vectors. An owner has at most one edge per hub, so
    these groups are bounded too. Edges to other nodes take a shuffle join, balanced
    because no such node has many edges, and are summed inside each map task before they are
    sent on, so a hub as owner costs one vector per task.
    Scaling a sum does not change its direction, so sums stand for means.
    """
    targets = vectors.select(F.col("cls").alias("dcls"), "vec")
    weight = F.col("w").cast("double")
    to_hubs = class_edges.where("hub").select("cls", "dcls", "w")
    hub_vectors = targets.join(F.broadcast(hubs), "dcls", "left_semi")
    hub_sums = (
        to_hubs.repartition("cls")
        .join(F.broadcast(hub_vectors), "dcls")
        .groupBy("cls")
        .agg(Summarizer.sum(F.col("vec"), weight).alias("vec"))
        .withColumn("w", F.lit(1.0))
    )
    others = class_edges.where("NOT hub").join(targets, "dcls").select("cls", "vec", weight.alias("w"))
    summed = hub_sums.unionByName(others).groupBy("cls").agg(Summarizer.sum(F.col("vec"), F.col("w")).alias("_raw"))
    return _unit(summed)


def neighbourhood_classes(edges: DataFrame) -> DataFrame:
    """(node_key, degree, cls): cls is equal for nodes with equal neighbour multisets.

    The class is a digest of two additive 64-bit hashes and the degree; it combines before
    the shuffle and never gathers a neighbour list.
    """
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    return (
        edges.groupBy(F.col("src").alias("node_key"))
        .agg(
            F.count("*").alias("degree"),
            total(F.xxhash64("dst")).alias("_a"),
            total(F.xxhash64("dst", F.lit("second"))).alias("_b"),
        )
        .select("node_key", "degree", F.md5(F.concat_ws(":", "degree", "_a", "_b")).alias("cls"))
    )


def embed_classes(
    edges: DataFrame,
    dimension: int = DIMENSION,
    iteration_weights: Sequence[float] = ITERATION_WEIGHTS,
    seed: int = SEED,
) -> NodeClasses:
    """Embeddings per class over edges (src, dst) that hold both directions.

    Entry i of iteration_weights (from 0) weighs propagation i + 1. The
    published documentation of the procedure reads the list that way; a comment next
    to the configuration reads entry 0 as the node itself, which
    would be weights [1, 1, 1, 1] here.
    """
    edges = stage(edges, "edges")
    classes = stage(neighbourhood_classes(edges), "classes")
    total = edges.count()
    hubs = hot_keys(classes, "node_key", total, "degree")

    # One representative per class stands for all its members' (identical) edges.
    chosen = classes.groupBy("cls").agg(F.min("node_key").alias("src"))
    hub_src = hubs.withColumnRenamed("node_key", "src")
    own_edges = stage(split_join(edges, chosen, "src", hub_src).select("cls", "dst"), "own-edges")
    hub_dst = hubs.withColumnRenamed("node_key", "dst")
    named = classes.select(F.col("node_key").alias("dst"), F.col("cls").alias("dcls"))
    weighted_edges = stage(
        split_join(own_edges, named, "dst", hub_dst).groupBy("cls", "dcls").agg(F.count("*").alias("w")),
        "weighted",
    )
    fan_out = weighted_edges.groupBy("dcls").agg(F.count("*").alias("n"))
    class_hubs = stage(hot_keys(fan_out, "dcls", weighted_edges.count()), "hubs")
    flag = F.broadcast(class_hubs.withColumn("hub", F.lit(True)))
    class_edges = stage(
        weighted_edges.join(flag, "dcls", "left").withColumn("hub", F.coalesce("hub", F.lit(False))), "class-edges"
    )

    first = starting_sums(own_edges, dimension, seed).groupBy("cls").agg(
        Summarizer.sum(array_to_vector("part")).alias("_raw")
    )
    weighted: list[tuple[float, DataFrame]] = []
    current = None
    for weight in iteration_weights:
        current = stage(_unit(first) if current is None else propagate(class_edges, class_hubs, current), "propagation")
        if weight:
            weighted.append((weight, current))
    parts = [v.select("cls", "vec", F.lit(float(w)).alias("w")) for w, v in weighted]
    if not parts:
        raise ValueError("at least one iteration weight must be non-zero")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    vectors = union.groupBy("cls").agg(
        vector_to_array(Summarizer.sum(F.col("vec"), F.col("w"))).alias("embedding")
    )
    return NodeClasses(classes.select("node_key", "cls"), vectors)


def fastrp(
    nodes: DataFrame,
    edges: DataFrame,
    dimension: int = DIMENSION,
    iteration_weights: Sequence[float] = ITERATION_WEIGHTS,
    self_influence: float = 0.0,
    seed: int = SEED,
) -> DataFrame:
    """(node_key, embedding) for every node; zeros for a node without edges."""
    result = embed_classes(edges, dimension, iteration_weights, seed)
    zeros = F.array_repeat(F.lit(0.0), dimension)
    embedded = (
        nodes.select("node_key")
        .join(result.membership, "node_key", "left")
        .join(result.vectors, "cls", "left")
        .select("node_key", F.coalesce("embedding", zeros).alias("embedding"))
    )
    if not self_influence:
        return embedded
    own = starting_sums(nodes.select(F.col("node_key").alias("cls"), F.col("node_key").alias("dst")), dimension, seed)
    norm = F.sqrt(F.aggregate("part", F.lit(0.0), lambda a, x: a + x * x))
    share = F.when(norm > 0, F.lit(self_influence) / norm).otherwise(F.lit(0.0))
    own = own.withColumn("_share", share).select(
        F.col("cls").alias("node_key"), F.transform("part", lambda x: x * F.col("_share")).alias("_own")
    )
    return embedded.join(own, "node_key").select(
        "node_key", F.zip_with("embedding", "_own", lambda a, b: a + b).alias("embedding")
    )
