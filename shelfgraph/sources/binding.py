"""Catalogue graph derived from a parts table and an events table.

The rules (which products get a second category, no brand, no parameters or no
description) shape the data: they give every query optional edges and
multi-membership to deal with. They select nothing away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import CatalogGraph

# Category numbers by noun and by part type, alphabetical.
NOUNS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
# Segments are the rows of the region table; which nouns each holds. A region without nouns is an empty segment.
SEGMENT_NOUNS = {0: ["gizmo", "widget"], 1: ["anvil", "bolt", "gear", "rod"], 2: ["plate", "ring"]}

REGION_SCHEMA = T.StructType([T.StructField("r_regionkey", T.IntegerType()), T.StructField("r_name", T.StringType())])

PART_SCHEMA = T.StructType(
    [
        T.StructField("p_partkey", T.LongType()),
        T.StructField("p_name", T.StringType()),
        T.StructField("p_brand", T.StringType()),
        T.StructField("p_type", T.StringType()),
        T.StructField("p_size", T.IntegerType()),
        T.StructField("p_retailprice", T.DoubleType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

def _no_time() -> Column:
    return F.lit(None).cast("timestamp")


def _index_of(value: Column, names: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), value).cast("bigint")


def bind_parts(part: DataFrame, region: DataFrame) -> CatalogGraph:
    noun = F.element_at(F.split("p_name", " "), 2)
    noun_id = _index_of(noun, NOUNS)
    type_code = noun_id * 100 + _index_of(F.col("p_type"), TYPES)
    band = F.floor(F.col("p_size") / 10).cast("bigint")
    leaf_id = type_code * 10 + band

    product = part.select(
        F.col("p_partkey").alias("productId"),
        F.col("p_name").alias("productName"),
        F.when(F.col("p_partkey") % 10 != 0, F.concat_ws(" ", "p_type", "p_name")).alias("productDescription"),
        F.substring("p_brand", 7, 10).cast("bigint").alias("brandId"),
        leaf_id.alias("categoryId"),
        _no_time().alias("created_at"),
    )
    brand = part.select(
        F.substring("p_brand", 7, 10).cast("bigint").alias("brandId"), F.col("p_brand").alias("name")
    ).distinct().withColumn("created_at", _no_time())

    # One pass over the parts gives all three category levels and their parent links.
    levels = F.array(
        F.struct(noun_id.alias("id"), noun.alias("name"), F.lit(None).cast("bigint").alias("parent")),
        F.struct(type_code.alias("id"), F.concat_ws("/", noun, "p_type").alias("name"), noun_id.alias("parent")),
        F.struct(
            leaf_id.alias("id"),
            F.concat_ws("/", noun, F.col("p_type"), band.cast("string")).alias("name"),
            type_code.alias("parent"),
        ),
    )
    category = (
        part.select(F.explode(levels).alias("c"))
        .select("c.*")
        .distinct()
        .select(
            F.col("id").alias("categoryId"),
            F.col("name").alias("categoryName"),
            F.col("parent").alias("parentCategoryId"),
            _no_time().alias("created_at"),
        )
    )
    child_of = category.where(F.col("parentCategoryId").isNotNull()).select(
        F.col("categoryId").alias("childId"), F.col("parentCategoryId").alias("parentId")
    )
    memberships = F.when(F.col("p_partkey") % 7 == 0, F.array(leaf_id, noun_id)).otherwise(F.array(leaf_id))
    belongs_to = part.select(
        F.col("p_partkey").alias("productId"), F.explode(memberships).alias("categoryId")
    )
    made_by = part.where(F.col("p_partkey") % 17 != 0).select(
        F.col("p_partkey").alias("productId"), F.substring("p_brand", 7, 10).cast("bigint").alias("brandId")
    )

    def trait(number: int, name: str, value: Column) -> Column:
        return F.struct(
            F.lit(number).cast("bigint").alias("parameterId"), F.lit(name).alias("parameterName"),
            value.alias("value"),
        )

    traits = F.array(
        trait(1, "Adjective", F.element_at(F.split("p_name", " "), 1)),
        trait(2, "Type", F.col("p_type")),
        trait(3, "Size", F.col("p_size").cast("string")),
        trait(4, "PriceBand", F.floor(F.col("p_retailprice") / 100).cast("string")),
    )
    held = part.where(F.col("p_partkey") % 23 != 0).select(
        F.col("p_partkey").alias("productId"), F.explode(traits).alias("t")
    ).select("productId", "t.*")
    has_parameter = held.select("productId", "parameterId", "value")
    parameter = (
        held.select("parameterId", "parameterName", "value")
        .distinct()
        .withColumns({"created_at": _no_time(), "updated_at": _no_time()})
    )
    segment = region.select(F.col("r_regionkey").cast("bigint").alias("segmentId"), F.col("r_name").alias("segmentName"))
    by_noun = F.create_map(*[F.lit(x) for key, nouns in SEGMENT_NOUNS.items() for n in nouns for x in (n, key)])
    in_segment = category.where(F.col("categoryId") < 1000).select(
        "categoryId",
        F.try_element_at(by_noun, F.element_at(F.split("categoryName", "/"), 1)).cast("bigint").alias("segmentId"),
    ).where(F.col("segmentId").isNotNull())
    return CatalogGraph(
        product, brand, category, parameter, segment, made_by, belongs_to, has_parameter, child_of, in_segment
    )


def view_events(events: DataFrame) -> DataFrame:
    """(user_id, productId, viewed_at) of the view events; works on batch and stream alike."""
    return events.where(F.col("event_type") == "view").select(
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("productId"),
        F.col("ts").cast("timestamp").alias("viewed_at"),
    )


def read_part(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PART_SCHEMA).parquet(f"{folder}/part.parquet")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{folder}/events.parquet")


def bind_folder(spark: SparkSession, folder: str) -> CatalogGraph:
    region = spark.read.schema(REGION_SCHEMA).parquet(f"{folder}/region.parquet")
    return bind_parts(read_part(spark, folder), region)
