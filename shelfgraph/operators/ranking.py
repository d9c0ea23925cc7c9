"""Positions and pages per key, safe for keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paging import has_more, page_of_position, total_pages
from ..session import stage


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First n rows per key. The limit is pushed below the shuffle, so a key of
    any size contributes at most n rows per map task."""
    position = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_position", position).where(F.col("_position") <= n).drop("_position")


def sliced_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slices: int | None = None
) -> DataFrame:
    """Add 1-based `position` within each key and the key's `total`, for all rows.

    A plain window would bring a whole key into one task. Here rows are
    range-partitioned on (keys, order), so a large key spans several slices of
    similar size; each row is numbered inside its slice and shifted by the count of
    the key's earlier slices. The slice number is frozen by staging, because
    a recomputed range partitioning may place its bounds elsewhere. `order` has to
    end in a unique column, which is also what lets one key be split anywhere.
    """
    ranged = [F.col(k) for k in keys] + list(order)
    spread = df.repartitionByRange(slices, *ranged) if slices else df.repartitionByRange(*ranged)
    sliced = stage(spread.withColumn("_slice", F.spark_partition_id()), "slices")

    # Row count: at most one per key plus one per slice boundary.
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    by_key = W.partitionBy(*keys)
    offsets = per_slice.select(
        *keys,
        "_slice",
        F.coalesce(
            F.sum("_n").over(by_key.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_n").over(by_key).alias("total"),
    )
    local = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order))
    return (
        sliced.withColumn("_local", local)
        .join(offsets, [*keys, "_slice"])
        .withColumn("position", (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_local", "_before", "_slice")
    )


def with_page(positioned: DataFrame, page_size: int, total: str = "total") -> DataFrame:
    """Add page, totalPages and hasMore to rows that carry position and total."""
    return positioned.withColumn("page", page_of_position(F.col("position"), page_size)).withColumns(
        {
            "totalPages": total_pages(F.col(total), page_size),
            "hasMore": has_more(F.col("page"), F.col(total), page_size),
        }
    )
