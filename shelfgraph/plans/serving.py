"""Materialised suggestion pages: build, look up, invalidate.

This takes the place of a read-through result cache. Pages of all products are
computed in one job and stored as (cache_key, payload) rows with an expiry time. `sources/page_store.py` keeps
them in a stored table and refills misses by `refill`; the functions here work on any table of such rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paging import MAX_PAGE_SIZE, has_more, normalize, page_of_position, total_pages
from ..functions.text import key_page_size, serving_key
from ..session import stage
from ..sources.schema import CatalogGraph
from .suggest import MIN_SIMILARITY, SCORED_COLUMNS, all_recommendations

# Fixed value of the reference configuration.
TTL_MINUTES = 30

ITEM_TYPE = (
    "productId: bigint, productName: string, productDescription: string, brandId: bigint, "
    "brandName: string, similarityScore: double, sameBrand: boolean"
)
PAYLOAD_TYPE = (
    f"struct<similarProducts: struct<items: array<struct<{ITEM_TYPE}>>, "
    "totalCount: bigint, page: bigint, pageSize: bigint, totalPages: bigint, hasMore: boolean>>"
)


def expiry(computed_at: Column, ttl_minutes: int = TTL_MINUTES) -> Column:
    return computed_at + F.make_dt_interval(mins=F.lit(ttl_minutes))


def recommendation_pages(
    graph: CatalogGraph, similar_to: DataFrame, page_size: int = 20, min_score: float = MIN_SIMILARITY, products: DataFrame | None = None
) -> DataFrame:
    """(productId, page, totalCount, pageSize, totalPages, hasMore, items) for every product, or for products(productId).

    A product without suggestions has one empty page, as its lookup would return.
    Items per group are bounded by the page size.
    """
    _, page_size = normalize(1, page_size)
    if products is not None:
        some = products.select("productId").distinct()
        similar_to = similar_to.join(some.withColumnRenamed("productId", "sourceId"), "sourceId", "left_semi")
    rows = all_recommendations(graph, similar_to, min_score).withColumn(
        "page", page_of_position(F.col("position"), page_size)
    )
    entry = F.struct("position", *SCORED_COLUMNS)
    filled = (
        rows.groupBy(F.col("sourceId").alias("productId"), "page")
        .agg(F.first("total").alias("totalCount"), F.array_sort(F.collect_list(entry)).alias("_items"))
    )
    items = F.transform(
        F.coalesce("_items", F.array().cast(f"array<struct<position: bigint, {ITEM_TYPE}>>")),
        lambda e: F.struct(*[e[c].alias(c) for c in SCORED_COLUMNS]),
    )
    every = graph.product.select("productId")
    return (
        (every if products is None else every.join(some, "productId", "left_semi"))
        .join(filled, "productId", "left")
        .select(
            "productId",
            F.coalesce("page", F.lit(1)).cast("bigint").alias("page"),
            F.coalesce("totalCount", F.lit(0)).cast("bigint").alias("totalCount"),
            F.lit(page_size).cast("bigint").alias("pageSize"),
            items.alias("items"),
        )
        .withColumns(
            {
                "totalPages": total_pages(F.col("totalCount"), F.col("pageSize")),
                "hasMore": has_more(F.col("page"), F.col("totalCount"), F.col("pageSize")),
            }
        )
    )


def payload() -> Column:
    """camelCase JSON document of a page row; absent values are written as null."""
    return F.to_json(
        F.struct(
            F.struct("items", "totalCount", "page", "pageSize", "totalPages", "hasMore").alias("similarProducts")
        ),
        {"ignoreNullFields": "false"},
    )


def serving_table(pages: DataFrame, computed_at: Column, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """(cache_key, product_id, payload, computed_at, expires_at) rows of computed pages."""
    return pages.select(
        serving_key(F.col("productId"), F.col("page"), F.col("pageSize")).alias("cache_key"),
        F.col("productId").alias("product_id"),
        payload().alias("payload"),
        computed_at.alias("computed_at"),
        expiry(computed_at, ttl_minutes).alias("expires_at"),
    )


def refill(graph: CatalogGraph, similar_to: DataFrame, as_of: Column, min_score: float = MIN_SIMILARITY) -> Callable[[DataFrame], DataFrame]:
    """What a page store computes on a miss: the pages of the missed products only, in the page sizes that were asked for.

    Keys that a request cannot have, such as a page size above the maximum, get no page.
    """

    def compute(missed: DataFrame) -> DataFrame:
        sized = missed.withColumn("size", key_page_size(F.col("cache_key")))
        sized = stage(sized.where(F.col("size").between(1, MAX_PAGE_SIZE)).select(F.col("product_id").alias("productId"), "size").distinct(), "missed")
        sizes = sorted(r["size"] for r in sized.select("size").distinct().collect())  # at most MAX_PAGE_SIZE
        parts = [recommendation_pages(graph, similar_to, n, min_score, sized.where(F.col("size") == n)) for n in sizes]
        parts = parts or [recommendation_pages(graph, similar_to, 1, min_score, sized.limit(0))]
        return serving_table(reduce(DataFrame.unionByName, parts), as_of)

    return compute


def read_payload(text: Column) -> Column:
    return F.from_json(text, PAYLOAD_TYPE)


def look_up(requests: DataFrame, table: DataFrame, as_of: Column) -> DataFrame:
    """Requests (cache_key) with hit flag and payload; an expired page is a miss."""
    fresh = table.where(F.col("expires_at") > as_of).select("cache_key", "payload")
    return requests.join(fresh, "cache_key", "left").withColumn("hit", F.col("payload").isNotNull())


def invalidate(table: DataFrame, changed: DataFrame) -> DataFrame:
    """The table without any page of the changed products (column productId)."""
    gone = changed.select(F.col("productId").alias("product_id")).distinct()
    return table.join(gone, "product_id", "left_anti").select(table.columns)


def invalidate_prefix(table: DataFrame, prefix: str) -> DataFrame:
    """The table without the keys that start with the prefix ("recs:" clears it)."""
    return table.where(~F.col("cache_key").startswith(prefix))
