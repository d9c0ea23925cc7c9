"""Category trees: roots, subtrees, and their nested rendering.

The flat tree (one row per category) is the distributed form. The nested JSON
document is a rendering of one page of roots, as a catalogue front end shows it. Numbered trees
hold the interval of every subtree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paging import Page, normalize, one_page
from ..operators.closure import closure
from ..operators.expand import by_name, collated
from ..operators.ranking import sliced_positions
from ..session import stage
from ..sources.schema import CatalogGraph

FLAT_COLUMNS = ["categoryId", "categoryName", "parentCategoryId", "segmentId", "segmentName"]


def roots(graph: CatalogGraph) -> DataFrame:
    """Categories without a parent edge; the parentCategoryId property plays no part."""
    has_parent = graph.child_of.select(F.col("childId").alias("categoryId"))
    return graph.category.join(has_parent, "categoryId", "left_anti").select("categoryId", "categoryName")


def segment_roots(graph: CatalogGraph, segment_id: int | None = None) -> DataFrame:
    """(segmentId, root) for roots that are themselves in a segment."""
    edges = graph.in_segment
    if segment_id is not None:
        edges = edges.where(F.col("segmentId") == segment_id)
    edges = edges.join(graph.segment.select("segmentId"), "segmentId", "left_semi")
    return roots(graph).join(edges, "categoryId").select("segmentId", "categoryId", "categoryName")


def roots_page(candidates: DataFrame, page: int, page_size: int) -> DataFrame:
    return one_page(candidates.orderBy(*by_name("categoryName", "categoryId")), page, page_size)


def flat_categories(graph: CatalogGraph) -> DataFrame:
    """Each category with one parent and one segment.

    With several of either, the pair kept is the least by (parent, segment), nulls
    last: taken as a minimum, so it combines before the shuffle.
    """
    parent = graph.child_of.join(
        graph.category.select(F.col("categoryId").alias("parentId")), "parentId", "left_semi"
    ).select(F.col("childId").alias("categoryId"), F.col("parentId").alias("parentCategoryId"))
    segment = graph.in_segment.join(graph.segment, "segmentId")
    # Parent and segment are independent optional edges, so the least pair is the pair of the least.
    parent = parent.groupBy("categoryId").agg(F.min("parentCategoryId").alias("parentCategoryId"))
    segment = segment.groupBy("categoryId").agg(F.min(F.struct("segmentId", "segmentName")).alias("_s"))
    return (
        graph.category.select("categoryId", "categoryName")
        .join(parent, "categoryId", "left")
        .join(segment, "categoryId", "left")
        .select(
            "categoryId", "categoryName", "parentCategoryId",
            F.col("_s.segmentId").alias("segmentId"), F.col("_s.segmentName").alias("segmentName"),
        )
    )


def flat_tree(graph: CatalogGraph, root_ids: DataFrame) -> DataFrame:
    """(rootId, depth, flat columns) of all categories under the given roots."""
    return closure(graph.child_of, root_ids.select("categoryId")).join(flat_categories(graph), "categoryId").select(
        "rootId", "depth", *FLAT_COLUMNS
    )


def child_counts(graph: CatalogGraph) -> DataFrame:
    """Direct children per category, zero included."""
    counted = graph.child_of.groupBy(F.col("parentId").alias("categoryId")).agg(F.count("*").alias("children"))
    return graph.category.select("categoryId", "categoryName").join(counted, "categoryId", "left").select(
        "categoryId", "categoryName", F.coalesce("children", F.lit(0)).cast("bigint").alias("children")
    )


def _placed(flat: DataFrame, root_ids: DataFrame, collation: str | None = None) -> DataFrame:
    """(rootId, depth, path, flat columns) of all categories under the roots; paths sort them as a walk from the root does.

    `flat` holds each category once, as flat_categories gives it, so every category has one kept parent link. Siblings
    are ordered by name (binary, or by a collation such as "UNICODE"), then id. A category is entered once per root, so a cycle is cut.
    """
    nodes = flat.select(*FLAT_COLUMNS)
    links = nodes.where(F.col("parentCategoryId").isNotNull()).select(
        F.col("categoryId").alias("childId"),
        F.col("parentCategoryId").alias("parentId"),
        F.struct(collated("categoryName", collation).alias("place"), F.col("categoryId").alias("id")).alias("step"),
    )
    asked = nodes.join(root_ids, "categoryId", "left_semi").select("categoryId")
    return closure(links, asked, label="step").join(nodes, "categoryId")


def numbered_tree(flat: DataFrame, root_ids: DataFrame, collation: str | None = None) -> DataFrame:
    """(rootId, left, right, depth, flat columns): every category with the interval of its subtree.

    A category's `left` is its number on a walk through its root's tree, parents first; its subtree is exactly the rows of that root whose
    left lies between its own left and right. So one sorted table serves every subtree as a range, without a join.
    Rows are numbered in slices of the walk, so a tree of any size spreads over tasks.
    """
    rows = _placed(flat, root_ids, collation)
    walked = stage(sliced_positions(rows, ["rootId"], [F.asc("path")]), "walk")
    # each category counts for itself and for every category on its path
    above = F.array_distinct(F.concat(F.array("rootId"), F.transform("path", lambda s: s["id"])))
    sizes = walked.select("rootId", F.explode(above).alias("categoryId")).groupBy("rootId", "categoryId").agg(F.count("*").alias("_size"))
    return walked.join(sizes, ["rootId", "categoryId"]).select(
        "rootId", F.col("position").alias("left"), (F.col("position") + F.col("_size") - 1).alias("right"), "depth", *FLAT_COLUMNS
    )


def nested_trees(flat: DataFrame, root_ids: DataFrame, collation: str | None = None) -> DataFrame:
    """(categoryId, categoryName, tree): one JSON document per root, in one pass over all of them.

    The categories of a root are walked in the order of their paths; each writes its own opening, and closes
    as many levels as the next one lies higher. A leaf has null children.
    """
    rows = _placed(flat, root_ids, collation)
    own = F.to_json(
        F.struct(
            "categoryId",
            "categoryName",
            "parentCategoryId",
            F.col("segmentId").alias("catalogSegmentId"),
            F.col("segmentName").alias("catalogSegmentName"),
        ),
        {"ignoreNullFields": "false"},
    )
    # The children are spliced in before the closing brace.
    opening = rows.withColumn("_own", own).withColumn("text", F.expr("left(_own, length(_own) - 1)"))
    walk = opening.groupBy("rootId").agg(F.array_sort(F.collect_list(F.struct("path", "depth", "text", "categoryName"))).alias("w"))
    # after the last category everything up to the root is closed
    following = F.concat(F.slice(F.transform("w", lambda n: n["depth"]), F.lit(2), F.size("w")), F.array(F.lit(0)))
    parts = F.zip_with("w", following, lambda n, after: F.struct(n["text"].alias("text"), n["depth"].alias("depth"), after.alias("after")))

    def written(n):
        ends = F.concat(F.lit("null}"), F.repeat(F.lit("]}"), n["depth"] - n["after"]), F.when(n["after"] > 0, ",").otherwise(""))
        return F.concat(n["text"], F.lit(',"subCategories":'), F.when(n["after"] > n["depth"], "[").otherwise(ends))

    return walk.select(
        F.col("rootId").alias("categoryId"), F.col("w")[0]["categoryName"].alias("categoryName"), F.array_join(F.transform(parts, written), "").alias("tree")
    )


def _tree_page(flat: DataFrame, chosen: DataFrame, collation: str | None = None) -> DataFrame:
    trees = nested_trees(flat, chosen.select("categoryId"), collation)
    if collation:
        return trees.orderBy(collated("categoryName", collation).asc_nulls_last(), "categoryId")
    return trees.orderBy(*by_name("categoryName", "categoryId"))


def category_trees(
    graph: CatalogGraph, page: int = 1, page_size: int = 0, collation: str | None = None
) -> Page:
    """A page of root trees. Roots are cut first and only those are expanded."""
    page, page_size = normalize(page, page_size)
    flat = stage(flat_categories(graph), "flat")
    every = stage(roots(graph), "roots")
    return Page(_tree_page(flat, roots_page(every, page, page_size), collation), every.count(), page, page_size)


def segment_trees(
    graph: CatalogGraph, segment_id: int, page: int = 1, page_size: int = 0, collation: str | None = None
) -> Page:
    """A page of the segment's root trees; descendants are kept whatever their segment."""
    page, page_size = normalize(page, page_size)
    flat = stage(flat_categories(graph), "flat")
    # A category may be in several segments, so membership is read from the edges.
    every = stage(segment_roots(graph, segment_id), "segment-roots")
    return Page(_tree_page(flat, roots_page(every, page, page_size), collation), every.count(), page, page_size)


def all_segment_trees(graph: CatalogGraph, collation: str | None = None) -> DataFrame:
    """(segmentId, categoryId, categoryName, tree): the root trees of every segment, each tree built once."""
    flat = stage(flat_categories(graph), "flat")
    places = stage(segment_roots(graph), "segment-roots")
    trees = nested_trees(flat, places.select("categoryId").distinct(), collation)
    return places.select("segmentId", "categoryId").join(trees, "categoryId").select("segmentId", "categoryId", "categoryName", "tree")


def segment_intervals(graph: CatalogGraph, collation: str | None = None) -> DataFrame:
    """(segmentId, rootId, left, right, depth, flat columns): the same trees as rows, for trees of any size."""
    flat = stage(flat_categories(graph), "flat")
    places = stage(segment_roots(graph), "segment-roots")
    numbered = numbered_tree(flat, places.select("categoryId").distinct(), collation)
    mine = places.select(F.col("segmentId").alias("treeSegmentId"), F.col("categoryId").alias("rootId"))
    return numbered.join(mine, "rootId").select("treeSegmentId", "rootId", "left", "right", "depth", *FLAT_COLUMNS)


def category_subtree(graph: CatalogGraph, category_id: int) -> Page:
    """One category's tree; an unknown id gives an empty page.

    Only what lies below the category is read on. A category below it with several parents hangs on the least
    of those inside the subtree; the category itself keeps its own parent.
    """
    asked = graph.category.where(F.col("categoryId") == category_id).select("categoryId")
    reached = stage(closure(graph.child_of, asked).select("categoryId").distinct(), "reached")
    inside = (
        graph.child_of.join(reached.select(F.col("categoryId").alias("parentId")), "parentId", "left_semi")
        .groupBy(F.col("childId").alias("categoryId"))
        .agg(F.min("parentId").alias("_inside"))
    )
    own = F.when(F.col("categoryId") == category_id, F.col("parentCategoryId"))
    flat = (
        flat_categories(graph)
        .join(reached, "categoryId", "left_semi")
        .join(inside, "categoryId", "left")
        .withColumn("parentCategoryId", own.otherwise(F.col("_inside")))
    )
    flat = stage(flat.select(*FLAT_COLUMNS), "flat")
    found = flat.where(F.col("categoryId") == category_id).count()
    return Page(_tree_page(flat, flat.where(F.col("categoryId") == category_id)), found, 1, found)
