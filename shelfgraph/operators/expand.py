"""One-hop expands shared by the catalogue queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import CatalogGraph


def by_name(name: str, key: str) -> list[Column]:
    """Ascending name with nulls last, then id, so equal names page the same way every time."""
    return [F.asc_nulls_last(name), F.asc(key)]


def collated(name: str, collation: str | None) -> Column:
    """Sort key of a name: its own binary order, or a language-aware one."""
    return F.collate(name, collation) if collation else F.col(name)


def product_brands(graph: CatalogGraph, made_by: DataFrame | None = None) -> DataFrame:
    """(productId, brandId, brandName): edge and node joined first, so that an
    optional expand never yields a brand id without its name. made_by: only these edges."""
    named = graph.brand.select("brandId", F.col("name").alias("brandName"))
    return (graph.made_by if made_by is None else made_by).join(named, "brandId").select("productId", "brandId", "brandName")


def with_brand(products: DataFrame, graph: CatalogGraph) -> DataFrame:
    """Optional brand of each product row: one row per brand, or one with nulls."""
    return products.drop("brandId").join(product_brands(graph), "productId", "left")


def product_rows(graph: CatalogGraph) -> DataFrame:
    """Product records with their brand. categoryId is the product's own property."""
    plain = graph.product.select("productId", "productName", "productDescription", "categoryId")
    return with_brand(plain, graph).select(
        "productId", "productName", "productDescription", "brandId", "brandName", "categoryId"
    )


def members(graph: CatalogGraph) -> DataFrame:
    """(categoryId, productId) as a set: a repeated membership edge changes no co-member."""
    return graph.belongs_to.select("categoryId", "productId").distinct()


def brand_product_counts(graph: CatalogGraph) -> DataFrame:
    """Products per brand, zero included. Edges are counted before they meet the brands,
    so a brand with a third of all products costs one row per map task."""
    counted = graph.made_by.groupBy("brandId").agg(F.count("*").alias("productCount"))
    return graph.brand.select("brandId", F.col("name").alias("brandName")).join(counted, "brandId", "left").withColumn(
        "productCount", F.coalesce("productCount", F.lit(0)).cast("bigint")
    )
