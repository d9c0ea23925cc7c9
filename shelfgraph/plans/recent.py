"""Recently viewed products per user: each item once, newest first, a few per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.expand import product_brands
from ..operators.ranking import first_per_key
from ..sources.schema import CatalogGraph

# Fixed value of the public contract.
MAX_RECENT = 6


def newest_first() -> list:
    return [F.desc("viewed_at"), F.asc("productId")]


def recent_items(views: DataFrame, keep: int = MAX_RECENT) -> DataFrame:
    """(user_id, productId, viewed_at, position) from views(user_id, productId, viewed_at).

    Viewing an item again only moves it to the front, so its last view decides. Both
    steps combine before their shuffles: a user with a third of all events sends at most
    one row per item and then `keep` rows per task. Views without an item or a time are dropped.
    """
    views = views.where(F.col("productId").isNotNull() & F.col("viewed_at").isNotNull())
    last = views.groupBy("user_id", "productId").agg(F.max("viewed_at").alias("viewed_at"))
    kept = first_per_key(last, ["user_id"], newest_first(), keep)
    position = F.row_number().over(W.partitionBy("user_id").orderBy(*newest_first()))
    return kept.withColumn("position", position.cast("bigint"))


def with_display(items: DataFrame, graph: CatalogGraph) -> DataFrame:
    """Add the columns a front end shows; viewedAt is epoch milliseconds."""
    brand = product_brands(graph).groupBy("productId").agg(F.min(F.struct("brandId", "brandName")).alias("_b"))
    shown = graph.product.select("productId", "productName", "categoryId").join(brand, "productId", "left")
    return items.join(shown, "productId").select(
        "user_id",
        "position",
        "productId",
        "productName",
        F.col("_b.brandName").alias("brandName"),
        "categoryId",
        F.col("_b.brandId").alias("brandId"),
        F.unix_millis("viewed_at").alias("viewedAt"),
    )
