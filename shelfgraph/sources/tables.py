"""Parquet storage of the graph and of the derived similarity edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .schema import SCHEMAS, SIMILAR_TO, CatalogGraph

_CLUSTER_BY = {
    "made_by": "productId",
    "belongs_to": "categoryId",
    "has_parameter": "productId",
    "product": "productId",
}


def read_graph(spark: SparkSession, root: str) -> CatalogGraph:
    """Graph over parquet with declared schemas, so no footer inference at plan time."""
    return CatalogGraph(
        **{name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in SCHEMAS.items()}
    )


def write_graph(graph: CatalogGraph, root: str) -> None:
    """Replace every table. Large tables are range-clustered on their lookup key,
    so point lookups skip row groups by min/max statistics."""
    for name, table in graph.tables().items():
        rows = table.select([F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]])
        key = _CLUSTER_BY.get(name)
        if key:
            rows = rows.repartitionByRange(F.col(key), *[c for c in rows.columns[:2] if c != key])
            rows = rows.sortWithinPartitions(key)
        rows.write.mode("overwrite").parquet(f"{root}/{name}")


def clear_graph(spark: SparkSession, root: str) -> None:
    """Leave every table empty but readable."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")


def write_similar_to(edges: DataFrame, path: str, seen: Observation | None = None, measures: Sequence[Column] = ()) -> None:
    """Replace all derived edges in one overwrite, clustered by source for serving lookups.

    seen takes the measures of the rows as they are written, behind the exchange: finding its ranges reads the rows once more.
    """
    rows = (
        edges.select([F.col(f.name).cast(f.dataType) for f in SIMILAR_TO])
        .repartitionByRange("sourceId", "targetId")
        .sortWithinPartitions("sourceId", F.desc("score"), "targetId")
    )
    if seen is not None:
        rows = rows.observe(seen, *measures)
    rows.write.mode("overwrite").parquet(path)


def read_similar_to(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIMILAR_TO).parquet(path)
