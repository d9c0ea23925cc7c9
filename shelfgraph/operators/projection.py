"""Homogeneous undirected view of chosen node and edge kinds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import EDGE_ENDS, NODE_KEYS, CatalogGraph

# Brands are left out: a brand node is a hub that makes all its products look alike.
# Brand affinity enters later, as a score bonus.
DEFAULT_NODES = ("product", "category", "segment", "parameter")
DEFAULT_EDGES = ("belongs_to", "child_of", "in_segment", "has_parameter")


def node_key(label: str, columns: Sequence[str | Column]) -> Column:
    return F.concat_ws(":", F.lit(label), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])


def project_graph(
    graph: CatalogGraph, labels: Sequence[str] = DEFAULT_NODES, edge_kinds: Sequence[str] = DEFAULT_EDGES
) -> tuple[DataFrame, DataFrame]:
    """(nodes(node_key, label, id), edges(src, dst)); each edge appears in both directions.

    Parallel edges are kept. `id` is the first key column, the product id for products.
    """
    nodes = reduce(
        DataFrame.unionByName,
        [
            getattr(graph, label).select(
                node_key(label, NODE_KEYS[label]).alias("node_key"),
                F.lit(label).alias("label"),
                F.col(NODE_KEYS[label][0]).alias("id"),
            )
            for label in labels
        ],
    )
    parts = []
    for kind in edge_kinds:
        (from_cols, from_label, _), (to_cols, to_label, _) = EDGE_ENDS[kind]
        if from_label not in labels or to_label not in labels:
            continue
        ends = F.array(node_key(from_label, from_cols), node_key(to_label, to_cols))
        # Both directions from one scan of the edge table.
        parts.append(
            getattr(graph, kind)
            .select(ends.alias("e"))
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("e")[0].alias("src"), F.col("e")[1].alias("dst")),
                        F.struct(F.col("e")[1].alias("src"), F.col("e")[0].alias("dst")),
                    )
                ).alias("d")
            )
            .select("d.src", "d.dst")
        )
    return nodes, reduce(DataFrame.unionByName, parts)


def projection_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per measure: nodeCount and relationshipCount (an undirected edge counts twice)."""
    return (
        nodes.agg(F.count("*").alias("value"))
        .select(F.lit("nodeCount").alias("measure"), "value")
        .unionByName(
            edges.agg(F.count("*").alias("value")).select(F.lit("relationshipCount").alias("measure"), "value")
        )
    )
