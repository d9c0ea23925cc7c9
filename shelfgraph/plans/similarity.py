"""The nightly similarity build: projection, embeddings, neighbours, brand bonus."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.embedding import DIMENSION, ITERATION_WEIGHTS, SEED, embed_classes
from ..operators.neighbours import CELL_ROWS, CUTOFF, SCORE_DECIMALS, TOP_K, expand_groups, nearest_groups, nearest_of
from ..operators.projection import project_graph
from ..operators.refine import refined_groups
from ..session import released, stage
from ..sources.schema import CatalogGraph
from ..sources.tables import read_similar_to, write_similar_to

# Fixed value of the reference configuration.
BRAND_BONUS = 0.01


def same_brand_pairs(pairs: DataFrame, made_by: DataFrame) -> DataFrame:
    """Distinct (sourceId, targetId) of the given pairs that share a brand.

    Starts from the pairs, so the work is linear in them; the products of a
    brand are never paired with one another.
    """
    edges = made_by.select("productId", "brandId")
    by_source = pairs.select("sourceId", "targetId").join(
        edges.withColumnRenamed("productId", "sourceId"), "sourceId"
    )
    by_target = edges.withColumnRenamed("productId", "targetId")
    # Whether a target has a brand is asked per distinct (target, brand), which a popular
    # target shares among all its pairs.
    return by_source.join(by_target, ["targetId", "brandId"], "left_semi").select("sourceId", "targetId").distinct()


def brand_boost(edges: DataFrame, made_by: DataFrame, bonus: float = BRAND_BONUS) -> DataFrame:
    """Add the bonus once to pairs that share at least one brand, and flag them.

    A pure function of raw edges: building again from raw edges never adds a bonus twice. The
    flag is null for other pairs, as stored; readers coalesce it. Scores may exceed 1.
    """
    flagged = same_brand_pairs(edges, made_by).withColumn("sameBrand", F.lit(True))
    return edges.join(flagged, ["sourceId", "targetId"], "left").select(
        "sourceId",
        "targetId",
        F.when(F.col("sameBrand"), F.col("score") + bonus).otherwise(F.col("score")).alias("score"),
        "sameBrand",
    )


@dataclass(frozen=True)
class ProductGroups:
    """Products in groups of equal neighbourhoods, and one vector per group."""

    held: DataFrame  # (id, key)
    groups: DataFrame  # (key, grp, n)
    vectors: DataFrame  # (id, vec) by the least product id of the group


def product_groups(
    graph: CatalogGraph, dimension: int = DIMENSION, iteration_weights: Sequence[float] = ITERATION_WEIGHTS, seed: int = SEED, seen: Observation | None = None
) -> ProductGroups:
    """seen counts the projected nodes and the products among them while they are read."""
    nodes, edges = project_graph(graph)
    if seen is not None:
        product = F.when(F.col("label") == "product", 1)
        nodes = nodes.observe(seen, F.count("*").alias("nodes"), F.count(product).alias("products"))
    embedded = embed_classes(edges, dimension, iteration_weights, seed)
    products = nodes.where(F.col("label") == "product").select("node_key", "id")
    held = stage(
        products.join(embedded.membership, "node_key").select("id", F.col("cls").alias("key")), "held"
    )
    groups = stage(held.groupBy("key").agg(F.min("id").alias("grp"), F.count("*").alias("n")), "groups")
    vectors = embedded.vectors.join(groups, embedded.vectors.cls == groups.key).select(
        F.col("grp").alias("id"), F.col("embedding").alias("vec")
    )
    return ProductGroups(held, groups, vectors)


def neighbour_edges(
    graph: CatalogGraph,
    k: int = TOP_K,
    cutoff: float = CUTOFF,
    dimension: int = DIMENSION,
    iteration_weights: Sequence[float] = ITERATION_WEIGHTS,
    seed: int = SEED,
    scale: str = "raw",
    decimals: int = SCORE_DECIMALS,
    cell_rows: int = CELL_ROWS,
    probes: int | None = None,
    exact: bool = False,
    seen: Observation | None = None,
) -> DataFrame:
    """(sourceId, targetId, score) between products, before the brand bonus.

    Neighbours are found between classes of products with equal neighbourhoods and then
    given to the members, so copies of a product are compared once. The neighbour graph is refined in rounds, each linear in
    the classes; `exact` compares what the bound leaves, up to all classes, and `probes` only the nearest cells.
    """
    p = product_groups(graph, dimension, iteration_weights, seed, seen)
    if exact or probes is not None:
        near = nearest_groups(p.vectors, k, cutoff, decimals, scale, cell_rows, probes)
    else:
        near = refined_groups(p.vectors, k, cutoff, decimals, scale, cell_rows)
    return expand_groups(p.held, p.groups, stage(near, "near"), k, cutoff)


def neighbour_recall(graph: CatalogGraph, edges: DataFrame, every: int = 50, k: int = TOP_K, cutoff: float = CUTOFF, **params) -> DataFrame:
    """sources, exactEdges, recall of edges(sourceId, targetId), for the products whose id is divisible by `every`.

    Those products are compared with all others in blocks; a product without an exact neighbour has nothing to be recalled.
    """
    p = product_groups(graph, **params)
    mine = p.held.where(F.col("id") % every == 0).select("key").distinct()
    asked = p.groups.join(mine, "key", "left_semi").select(F.col("grp").alias("id"))
    near = stage(nearest_of(p.vectors, asked, k, cutoff), "near-asked")
    exact = stage(expand_groups(p.held, p.groups, near, k, cutoff).where(F.col("sourceId") % every == 0), "exact")
    found = edges.where(F.col("sourceId") % every == 0).select("sourceId", "targetId", F.lit(1).alias("found"))
    return exact.join(found, ["sourceId", "targetId"], "left").agg(
        F.count_distinct("sourceId").alias("sources"),
        F.count("*").alias("exactEdges"),
        F.coalesce(F.sum("found") / F.count("*"), F.lit(1.0)).alias("recall"),
    )


def build_similar_to(graph: CatalogGraph, bonus: float = BRAND_BONUS, **params) -> DataFrame:
    """(sourceId, targetId, score, sameBrand): cut to the best k first, then boosted."""
    return brand_boost(neighbour_edges(graph, **params), graph.made_by, bonus)


def write_build(graph: CatalogGraph, path: str, bonus: float = BRAND_BONUS, **params) -> DataFrame:
    """Run the whole job: replace the edges at path, release everything it staged, and return the run's summary.

    The counters ride on the job's own passes: nodes as the projection is read, edges as they are written, so nothing is
    read again for them. A counter is a few numbers per task, because each task sends its own to the driver; percentiles need
    every score and are taken from the written table.
    Every projected node counts as embedded; one without edges has the zero vector. All products count as compared.
    """
    spark = graph.product.sparkSession
    nodes, edges = Observation(), Observation()
    with released(spark):
        measures = [
            F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.avg("score").alias("mean"),
            F.stddev_pop("score").alias("dev"),
        ]
        write_similar_to(build_similar_to(graph, bonus, seen=nodes, **params), path, edges, measures)
        n, e = nodes.get, edges.get
        levels = score_levels(read_similar_to(spark, path), (0.5, 0.9, 0.99))
    mark = lambda v: None if v is None else float(v)
    row = (n["nodes"], n["products"], e["n"], *(mark(e[x]) for x in ("low", "high", "mean", "dev")), *map(mark, levels))
    return spark.createDataFrame(
        [row],
        "nodePropertiesWritten bigint, nodesCompared bigint, relationshipsWritten bigint, minScore double, maxScore double, meanScore double, "
        "stdDev double, p50 double, p90 double, p99 double",
    )


def score_levels(edges: DataFrame, shares: Sequence[float]) -> list[float | None]:
    """For each share, the least score that at least this share of the edges does not exceed.

    Exact. Equal scores are counted first; their counts are put in order slice by slice, and the driver holds one
    total per slice.
    """
    counted = edges.where(F.col("score").isNotNull()).groupBy("score").agg(F.count("*").alias("n"))
    sliced = stage(counted.repartitionByRange("score").withColumn("slice", F.spark_partition_id()), "scores")
    totals = {r["slice"]: r["n"] for r in sliced.groupBy("slice").agg(F.sum("n").alias("n")).collect()}
    total, before, wanted = sum(totals.values()), 0, []
    if not total:
        return [None] * len(shares)
    ranks = [max(1, math.ceil(share * total)) for share in shares]
    for number in sorted(totals):
        held = [i for i, rank in enumerate(ranks) if before < rank <= before + totals[number]]
        if held:
            upto = F.sum("n").over(W.partitionBy("slice").orderBy("score")) + before
            rows = sliced.where(F.col("slice") == number).select("score", upto.alias("upto"))
            level = rows.agg(*[F.min(F.when(F.col("upto") >= ranks[i], F.col("score"))) for i in held]).first()
            wanted += zip(held, level)
        before += totals[number]
    return [level for _, level in sorted(wanted)]


def score_summary(edges: DataFrame) -> DataFrame:
    """Stored edges: how many, of how many sources that kept one, and how their scores spread."""
    return edges.agg(
        F.count("*").alias("relationshipsWritten"),
        F.count_distinct("sourceId").alias("sources"),
        F.round(F.min("score"), 6).alias("minScore"),
        F.round(F.max("score"), 6).alias("maxScore"),
        F.round(F.avg("score"), 6).alias("meanScore"),
        F.round(F.stddev_pop("score"), 6).alias("stdDev"),
        # Exact percentiles keep one counter per distinct value, so they are taken of six decimals.
        *[F.round(F.percentile(F.round("score", 6), p / 100), 6).alias(f"p{p}") for p in (50, 90, 99)],
    )
