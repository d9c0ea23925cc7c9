"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so by counting
# there can never be more than HOT_SHARE hot keys: that bounds every broadcast below.
HOT_SHARE = 1000


def hot_keys(counts: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """At most HOT_SHARE keys of a (key, count) table that sums to total."""
    return counts.where(F.col(count) * HOT_SHARE > total).select(key)


def split_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join on key, with right unique per key.

    Rows of hot keys meet a broadcast of the at most HOT_SHARE matching right
    rows and never move; all other rows take the ordinary shuffle join, whose
    partitions are now balanced.
    """
    hot = F.broadcast(hot.select(key))
    hot_right = F.broadcast(right.join(hot, key, "left_semi"))
    hot_part = left.join(hot, key, "left_semi").join(hot_right, key, how)
    cold_part = left.join(hot, key, "left_anti").join(right, key, how)
    return hot_part.unionByName(cold_part)
