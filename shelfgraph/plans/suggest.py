"""Product suggestions read from the stored similarity edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paging import Page, normalize, one_page
from ..operators.expand import product_brands
from ..operators.skew import hot_keys, split_join
from ..sources.schema import CatalogGraph

# Fixed value of the public contract: the score, bonus included, from which an edge is served.
MIN_SIMILARITY = 0.8

SCORED_COLUMNS = [
    "productId", "productName", "productDescription", "brandId", "brandName", "similarityScore", "sameBrand",
]


def served_edges(similar_to: DataFrame, min_score: float = MIN_SIMILARITY) -> DataFrame:
    """Edges that pass the threshold; the filter reaches the edge table's scan."""
    return similar_to.where(F.col("score") >= min_score)


def scored_rows(graph: CatalogGraph, edges: DataFrame, few: bool = False) -> DataFrame:
    """(sourceId, scored product columns): each edge with its target product and optional brand.

    few: the edges are those of one product, at most k, and travel to the products; no product
    or brand edge is shuffled. Otherwise a target that many products point to is met by a broadcast of its
    record (at most HOT_SHARE such targets), and the other targets by a balanced join.
    """
    plain = graph.product.select(F.col("productId").alias("targetId"), "productName", "productDescription")
    if few:
        wanted = F.broadcast(edges.select("targetId").distinct())
        made_by = graph.made_by.join(wanted, graph.made_by.productId == wanted.targetId, "left_semi")
        brands = product_brands(graph, made_by).withColumnRenamed("productId", "targetId")
        joined = plain.join(F.broadcast(edges), "targetId").join(F.broadcast(brands), "targetId", "left")
    else:
        counts = edges.groupBy("targetId").agg(F.count("*").alias("n"))
        hot = hot_keys(counts, "targetId", edges.count())
        named = split_join(edges, plain, "targetId", hot)
        # one row per target, so that a target of several brands stays one row on either side of the join
        brands = product_brands(graph).groupBy(F.col("productId").alias("targetId")).agg(
            F.collect_list(F.struct("brandId", "brandName")).alias("_brands")
        )
        listed = split_join(named, brands, "targetId", hot, "left")
        joined = listed.withColumn("_brand", F.explode_outer("_brands")).select("*", "_brand.brandId", "_brand.brandName")
    return joined.withColumn("productId", F.col("targetId")).select(
        "sourceId",
        "productId",
        "productName",
        "productDescription",
        "brandId",
        "brandName",
        F.col("score").alias("similarityScore"),
        F.coalesce("sameBrand", F.lit(False)).alias("sameBrand"),
    )


def best_first() -> list:
    return [F.desc("similarityScore"), F.asc("productId"), F.asc_nulls_last("brandId")]


def recommendations(
    graph: CatalogGraph, similar_to: DataFrame, product_id: int, page: int = 1, page_size: int = 0,
    min_score: float = MIN_SIMILARITY,
) -> Page:
    """Suggestions for one product. Only out-edges count: similarity is directed."""
    page, page_size = normalize(page, page_size)
    edges = served_edges(similar_to, min_score).where(F.col("sourceId") == product_id)
    rows = scored_rows(graph, edges, few=True).select(*SCORED_COLUMNS).orderBy(*best_first())
    return Page(one_page(rows, page, page_size), edges.count(), page, page_size)


def all_recommendations(graph: CatalogGraph, similar_to: DataFrame, min_score: float = MIN_SIMILARITY) -> DataFrame:
    """Suggestions for every product, with their position and the product's total.

    A source has at most the k edges the similarity build gave it, so a window per source is small.
    """
    rows = scored_rows(graph, served_edges(similar_to, min_score))
    source = W.partitionBy("sourceId")
    # The total counts edges, not rows: a target with two brands is two rows of one edge.
    return rows.select(
        "sourceId",
        F.row_number().over(source.orderBy(*best_first())).cast("bigint").alias("position"),
        F.size(F.collect_set("productId").over(source)).cast("bigint").alias("total"),
        *SCORED_COLUMNS,
    )


def other_brand(rows: DataFrame) -> DataFrame:
    """Rows of a cut page whose product is of another brand."""
    return rows.where(~F.col("sameBrand"))
