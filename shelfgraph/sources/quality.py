"""Constraints a graph store would enforce, as validation jobs over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import EDGE_ENDS, NODE_KEYS, CatalogGraph


def _key_text(columns: list[str]) -> F.Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("key")


def duplicate_keys(graph: CatalogGraph) -> DataFrame:
    """(node, key, copies) for every key held by more than one node; empty when sound."""
    parts = [
        getattr(graph, name)
        .groupBy(*keys)
        .agg(F.count("*").alias("copies"))
        .where("copies > 1")
        .select(F.lit(name).alias("node"), _key_text(keys), "copies")
        for name, keys in NODE_KEYS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def unique_key_report(graph: CatalogGraph) -> DataFrame:
    """(node, distinct_keys, duplicated_keys) per node kind."""
    parts = [
        getattr(graph, name)
        .groupBy(*keys)
        .agg(F.count("*").alias("copies"))
        .agg(
            F.count("*").alias("distinct_keys"),
            F.count_if(F.col("copies") > 1).alias("duplicated_keys"),
        )
        .select(F.lit(name).alias("node"), "distinct_keys", "duplicated_keys")
        for name, keys in NODE_KEYS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def dangling_edges(graph: CatalogGraph) -> DataFrame:
    """(edge, missing, key, edges) for edge ends without a node; empty when sound.

    Edge ends are reduced to distinct keys with counts before the anti join, so a
    hub end costs one row per map task and not its whole edge list.
    """
    parts = []
    for edge, ends in EDGE_ENDS.items():
        for columns, node, keys in ends:
            counted = getattr(graph, edge).groupBy(*columns).agg(F.count("*").alias("edges"))
            nodes = getattr(graph, node).select([F.col(k).alias(f"n_{k}") for k in keys])
            match = reduce(
                lambda a, b: a & b, [F.col(c) == F.col(f"n_{k}") for c, k in zip(columns, keys)]
            )
            parts.append(
                counted.join(nodes, match, "left_anti").select(
                    F.lit(edge).alias("edge"), F.lit(node).alias("missing"), _key_text(columns), "edges"
                )
            )
    return reduce(DataFrame.unionByName, parts)


def edge_end_report(graph: CatalogGraph) -> DataFrame:
    """(edge, missing, ends, dangling) per edge end: distinct end keys and those without a node."""
    parts = []
    for edge, ends in EDGE_ENDS.items():
        for columns, node, keys in ends:
            counted = getattr(graph, edge).select(*columns).distinct()
            nodes = getattr(graph, node).select([F.col(k).alias(f"n_{k}") for k in keys]).distinct()
            match = reduce(
                lambda a, b: a & b, [F.col(c) == F.col(f"n_{k}") for c, k in zip(columns, keys)]
            )
            parts.append(
                counted.join(nodes, match, "left")
                .agg(
                    F.count("*").alias("ends"),
                    F.count_if(F.col(f"n_{keys[0]}").isNull()).alias("dangling"),
                )
                .select(F.lit(edge).alias("edge"), F.lit(node).alias("node"), "ends", "dangling")
            )
    return reduce(DataFrame.unionByName, parts)
