"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.durable import written


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of links (a, b).

    Alternates between hanging all larger neighbours of a node on its least one and all smaller ones, until
    nothing changes. Every node's neighbours meet in aggregates and joins, never in one list.
    """
    edges = written(_ordered(links), "edges")
    seen = _fingerprint(edges)
    while True:
        edges = written(_star(_star(_both(edges), larger=True), larger=False), "edges")
        last, seen = seen, _fingerprint(edges)
        if seen == last:
            break
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal edge sets; two sums of row hashes tell others apart."""
    rows = [F.col("a"), F.col("b")]
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64(*rows)), F.sum(F.crc32(F.concat(*[F.col(c).cast("binary") for c in ("a", "b")])))).first())


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node a to the smaller node b."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a")
    if larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return moved.where("a <> b").distinct()
