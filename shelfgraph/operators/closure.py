"""Everything reachable below a set of roots over child-to-parent edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def closure(child_of: DataFrame, roots: DataFrame, max_levels: int | None = None, label: str | None = None) -> DataFrame:
    """(rootId, categoryId, depth): each root with all its descendants, itself at depth 0.

    Path doubling. After round i everything less than 2^i levels below a root is known, and the jumps are the pairs exactly 2^i levels
    apart: one join extends the known part and the jumps by the jumps, so the rounds are the logarithm of the depth.
    A node with several parents is reported once, at its least depth: the first part of a shortest path is
    shortest itself, so keeping the least depth loses nothing. A cycle ends the walk, because a round that reaches nothing
    new proves that nothing lies further down. Each round is one staged table; only its number is on the driver.

    label names a column of child_of; then `path` holds its values from below the root down to the category, on a shortest path.
    """
    way = F.array(label) if label else F.array().cast("array<boolean>")
    edges = child_of.where(F.col("parentId").isNotNull() & F.col("childId").isNotNull()).select(
        F.lit(True).alias("jump"), F.col("parentId").alias("a"), F.col("childId").alias("b"), F.lit(1).alias("depth"), way.alias("path")
    )
    nothing = F.array().cast(edges.schema["path"].dataType)
    start = roots.select(F.lit(False).alias("jump"), F.col("categoryId").alias("a"), F.col("categoryId").alias("b"), F.lit(0).alias("depth"), nothing.alias("path"))
    at = stage(_least(start.unionByName(edges).withColumn("fresh", F.lit(True))), "closure")
    length = 1
    while max_levels is None or length <= max_levels:
        hop = at.where("jump").select(F.col("a").alias("_from"), F.col("b").alias("_to"), F.col("depth").alias("_by"), F.col("path").alias("_on"))
        further = at.join(hop, at.b == hop._from).select(
            "jump", "a", F.col("_to").alias("b"), (F.col("depth") + F.col("_by")).alias("depth"), F.concat("path", "_on").alias("path"), F.lit(True).alias("fresh")
        )
        at = stage(_least(at.where("NOT jump").withColumn("fresh", F.lit(False)).unionByName(further)), "closure")
        length *= 2
        left = at.agg(F.max("jump").alias("jumps"), F.max(F.col("fresh") & ~F.col("jump")).alias("grown")).first()
        if not (left["jumps"] and left["grown"]):
            break
    reached = at.where("NOT jump").select(F.col("a").alias("rootId"), F.col("b").alias("categoryId"), "depth", *(["path"] if label else []))
    return reached if max_levels is None else reached.where(F.col("depth") <= max_levels)


def _least(walks: DataFrame) -> DataFrame:
    """One row per pair: its shortest walk, fresh if none of its walks was known."""
    best = F.min(F.struct("depth", "path")).alias("w")
    return walks.groupBy("jump", "a", "b").agg(best, F.min("fresh").alias("fresh")).select("jump", "a", "b", "w.depth", "w.path", "fresh")
