"""Segments, products of a category, product detail, related products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paging import Page, normalize, one_page
from ..functions.text import not_found_text
from ..operators.expand import by_name, collated, members, product_brands, product_rows
from ..operators.ranking import first_per_key, sliced_positions, with_page
from ..session import stage
from ..sources.schema import CatalogGraph

PRODUCT_COLUMNS = ["productId", "productName", "productDescription", "brandId", "brandName", "categoryId"]


# ---- segments -------------------------------------------------------------------------------


def segments(graph: CatalogGraph, page: int = 1, page_size: int = 0) -> Page:
    page, page_size = normalize(page, page_size)
    rows = graph.segment.select("segmentId", "segmentName").orderBy(*by_name("segmentName", "segmentId"))
    return Page(one_page(rows, page, page_size), graph.segment.count(), page, page_size)


# ---- products of a category -----------------------------------------------------------------


def category_product_rows(graph: CatalogGraph) -> DataFrame:
    """Direct members only; one row per membership and brand."""
    rows = product_rows(graph).withColumnRenamed("categoryId", "_own")
    return (
        graph.belongs_to.select("productId", F.col("categoryId").alias("listedCategoryId"))
        .join(rows, "productId")
        .select("listedCategoryId", *PRODUCT_COLUMNS[:-1], F.col("_own").alias("categoryId"))
    )


def products_by_category(graph: CatalogGraph, category_id: int, page: int = 1, page_size: int = 0) -> Page:
    """One category. The key filter reaches the membership scan, and only its rows are joined."""
    page, page_size = normalize(page, page_size)
    chosen = graph.belongs_to.where(F.col("categoryId") == category_id).select("productId")
    # The total counts memberships, before brands multiply rows.
    total = chosen.count()
    rows = (
        chosen.join(product_rows(graph), "productId")
        .select(*PRODUCT_COLUMNS)
        .orderBy(*by_name("productName", "productId"), F.asc_nulls_last("brandId"))
    )
    return Page(one_page(rows, page, page_size), total, page, page_size)


def category_product_pages(graph: CatalogGraph, page_size: int = 20) -> DataFrame:
    """Every page of every category at once."""
    _, page_size = normalize(1, page_size)
    order = [*by_name("productName", "productId"), F.asc_nulls_last("brandId")]
    placed = sliced_positions(category_product_rows(graph), ["listedCategoryId"], order).drop("total")
    totals = graph.belongs_to.groupBy(F.col("categoryId").alias("listedCategoryId")).agg(
        F.count("*").alias("total")
    )
    # One total per category against many rows: adaptive execution broadcasts it when
    # it is small and splits the skewed partitions when it is not.
    return with_page(placed.join(totals, "listedCategoryId"), page_size)


# ---- product detail -------------------------------------------------------------------------


def product_details(
    graph: CatalogGraph, products: DataFrame | None = None, collation: str | None = None
) -> DataFrame:
    """Products with their brand and parameter list (empty, never null).

    Parameters are in name order: binary, or by a collation such as "UNICODE".
    """
    base = graph.product if products is None else graph.product.join(products, "productId", "left_semi")
    # Several brands: the lowest id, by a plain aggregate that combines before the shuffle.
    brand = product_brands(graph).groupBy("productId").agg(
        F.min(F.struct("brandId", "brandName")).alias("_brand")
    )
    place = collated("parameterName", collation).alias("_place")
    traits = (
        graph.has_parameter.join(
            graph.parameter.select("parameterId", "value", "parameterName"), ["parameterId", "value"]
        )
        .groupBy("productId")
        .agg(F.array_sort(F.collect_list(F.struct(place, "parameterName", "parameterId", "value"))).alias("_traits"))
    )
    parameters = F.transform(
        F.coalesce("_traits", F.array()),
        lambda t: F.struct(
            t["parameterId"].alias("parameterId"), t["parameterName"].alias("parameterName"), t["value"].alias("value")
        ),
    )
    return (
        base.select("productId", "productName", "productDescription", "categoryId")
        .join(brand, "productId", "left")
        .join(traits, "productId", "left")
        .select(
            "productId",
            "productName",
            "productDescription",
            F.col("_brand.brandId").alias("brandId"),
            F.col("_brand.brandName").alias("brandName"),
            "categoryId",
            parameters.alias("parameters"),
        )
    )


def product_detail(graph: CatalogGraph, product_id: int) -> DataFrame:
    """One product; a KeyError with the public message when there is none."""
    here = F.col("productId") == product_id
    narrowed = CatalogGraph(
        **{
            **graph.tables(),
            "product": graph.product.where(here),
            "made_by": graph.made_by.where(here),
            "has_parameter": graph.has_parameter.where(here),
        }
    )
    row = product_details(narrowed)
    if row.isEmpty():
        raise KeyError(not_found_text("Product", product_id))
    return row


# ---- related products (shared category) -----------------------------------------------------


def related_products(graph: CatalogGraph, product_id: int, page: int = 1, page_size: int = 0) -> Page:
    page, page_size = normalize(page, page_size)
    mine = graph.belongs_to.where(F.col("productId") == product_id).select("categoryId").distinct()
    related = (
        graph.belongs_to.join(mine, "categoryId", "left_semi")
        .where(F.col("productId") != product_id)
        .select("productId")
        .distinct()
    )
    rows = (
        related.join(product_rows(graph), "productId")
        .select(*PRODUCT_COLUMNS)
        .distinct()
        .orderBy(*by_name("productName", "productId"), F.asc_nulls_last("brandId"))
    )
    return Page(one_page(rows, page, page_size), related.count(), page, page_size)


# Category sets up to this size are counted by inclusion and exclusion (255 subsets);
# wider ones, rare in a catalogue, by bitmaps of products.
NARROW = 8


def category_bitmaps(pairs: DataFrame) -> DataFrame:
    """(categoryId, _range, _bits): the products of pairs(productId, categoryId) as bitmaps over ranges of product numbers.

    Products are numbered without gaps, so a category has at most one bitmap of 4 KB for every 32,768 products.
    """
    products = pairs.select(F.lit(1).alias("_all"), "productId").distinct()
    numbered = sliced_positions(products, ["_all"], [F.asc("productId")]).select("productId", "position")
    place = pairs.join(numbered, "productId").select(
        "categoryId", F.bitmap_bucket_number("position").alias("_range"), F.bitmap_bit_position("position").alias("_bit")
    )
    return place.groupBy("categoryId", "_range").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def reached(sets: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(_set, _reach): products in at least one category of each distinct set, from the bitmaps.

    Bitmaps combine before the shuffle, so a category that most sets hold costs a task one bitmap per set and range.
    """
    joined = sets.select("_set", F.explode("_set").alias("categoryId")).join(bitmaps, "categoryId")
    merged = joined.groupBy("_set", "_range").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    return merged.groupBy("_set").agg(F.sum(F.bitmap_count("_bits")).alias("_reach"))


def related_totals(graph: CatalogGraph) -> DataFrame:
    """(productId, total): distinct other products that share a category, for every product.

    No product pairs are formed. The size of a union of categories follows from
    the sizes of their intersections, and the size of an intersection is the number of
    products whose own category set contains it: one grouped count over the subsets
    of each product's set. Cost is linear in memberships however large a category is. The union of a wide set is the
    union of its categories' bitmaps, once per distinct set.
    """
    pairs = stage(members(graph), "members")
    degree = pairs.groupBy("productId").agg(F.count("*").alias("_k"))
    narrow = (
        pairs.join(degree.where(F.col("_k") <= NARROW), "productId")
        .groupBy("productId")
        .agg(F.array_sort(F.collect_list("categoryId")).alias("_set"))
    )
    wide = pairs.join(degree.where(F.col("_k") > NARROW), "productId").select("productId", "categoryId")

    # Products with the same set have the same total, so work on distinct sets.
    sets = narrow.groupBy("_set").agg(F.count("*").alias("_same"))
    masks = F.sequence(F.lit(1), F.expr("shiftleft(1, size(_set)) - 1"))
    subsets = sets.withColumn("_mask", F.explode(masks)).withColumn(
        "_subset",
        F.expr("filter(_set, (c, i) -> (_mask & shiftleft(1, i)) != 0)"),
    )
    within = subsets.groupBy("_subset").agg(F.sum("_same").alias("_n"))
    sign = F.when(F.size("_subset") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    narrow_union = (
        subsets.select("_set", "_subset")
        .join(within, "_subset")
        .groupBy("_set")
        .agg(F.sum(sign * F.col("_n")).alias("_reach"))
    )

    if degree.where(F.col("_k") > NARROW).isEmpty():
        set_total = narrow_union.select("_set", (F.col("_reach") - 1).alias("total"))
        totals = narrow.join(set_total, "_set").select("productId", "total")
    else:
        # Wide products, from both sides: what each wide set reaches, and the wide products that narrow sets reach.
        wide_sets = stage(wide.groupBy("productId").agg(F.array_sort(F.collect_list("categoryId")).alias("_set")), "wide")
        distinct_sets = wide_sets.select("_set").distinct()
        wide_total = wide_sets.join(reached(distinct_sets, category_bitmaps(pairs)), "_set").select("productId", (F.col("_reach") - 1).alias("total"))
        extra = reached(sets.select("_set"), category_bitmaps(wide)).withColumnRenamed("_reach", "_wide")
        set_total = narrow_union.join(extra, "_set", "left").select(
            "_set", (F.col("_reach") + F.coalesce("_wide", F.lit(0)) - 1).alias("total")
        )
        totals = narrow.join(set_total, "_set").select("productId", "total").unionByName(wide_total)
    every = graph.product.select("productId").join(totals, "productId", "left")
    return every.select("productId", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))


def related_pages(graph: CatalogGraph, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of related products for every product at once.

    Only the head of each category is joined: the first n rows of a product's list lie
    among the first n + 1 products (one may be itself) of each of its categories.
    So a membership meets one bounded list instead of its whole category.
    """
    page, page_size = normalize(page, page_size)
    need = page * page_size
    named = graph.product.select("productId", "productName", "productDescription", "categoryId")
    listed = stage(members(graph), "members").withColumnRenamed("categoryId", "_shared")
    head = first_per_key(
        listed.join(named.select("productId", "productName"), "productId"),
        ["_shared"], by_name("productName", "productId"), need + 1,
    )
    brands = first_per_key(
        product_brands(graph).join(head.select("productId").distinct(), "productId", "left_semi"),
        ["productId"], [F.asc("brandId")], need,
    )
    # Field order is the row order: nulls last by an explicit flag, then name, id, brand.
    entry = F.struct(
        F.col("productName").isNull().alias("_unnamed"), "productName", "productId",
        F.col("brandId").isNull().alias("_unbranded"), "brandId", "brandName", "productDescription", "categoryId",
    )
    heads = (
        head.select("_shared", "productId")
        .join(named, "productId")
        .join(brands, "productId", "left")
        .groupBy("_shared")
        .agg(F.array_sort(F.collect_list(entry)).alias("_head"))
    )

    kinds = listed.groupBy("productId").agg(F.count("*").alias("_k"), F.min("_shared").alias("_shared"))
    # One category: the list is that category's head without the product itself.
    single = (
        kinds.where("_k = 1")
        .join(heads, "_shared")
        .select(F.col("productId").alias("sourceId"), F.expr("filter(_head, e -> e.productId != productId)").alias("_list"))
    )
    # Several: merge the heads, once per distinct row.
    several = (
        listed.join(kinds.where("_k > 1").select("productId"), "productId", "left_semi")
        .join(heads, "_shared")
        .select(F.col("productId").alias("sourceId"), F.explode("_head").alias("_e"))
        .where(F.col("sourceId") != F.col("_e.productId"))
        .distinct()
    )
    several = (
        first_per_key(several, ["sourceId"], [F.asc("_e")], need)
        .groupBy("sourceId")
        .agg(F.array_sort(F.collect_list("_e")).alias("_list"))
    )
    return (
        single.unionByName(several)
        .select("sourceId", F.posexplode(F.slice("_list", need - page_size + 1, page_size)).alias("_at", "_e"))
        .select(
            "sourceId",
            (F.col("_at") + 1 + need - page_size).cast("bigint").alias("position"),
            *[F.col(f"_e.{c}").alias(c) for c in PRODUCT_COLUMNS],
        )
    )
