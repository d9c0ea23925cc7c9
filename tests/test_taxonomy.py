import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from shelfgraph.operators.closure import closure
from shelfgraph.plans import taxonomy

FLAT = "categoryId long, categoryName string, parentCategoryId long, segmentId long, segmentName string"


def build(spark, rows, roots):
    flat = spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], FLAT)
    ids = spark.createDataFrame([(r,) for r in roots], "categoryId long")
    trees = taxonomy.nested_trees(flat, ids).orderBy(F.asc_nulls_last("categoryName"), "categoryId")
    return [json.loads(r.tree) for r in trees.collect()]


ORCHARD = [
    (40, "Orchard", None, 3, "Outdoor"), (41, "Pear", 40, 3, "Outdoor"), (43, "Apple", 40), (42, "Apple", 40),
    (51, "Crates", 43), (52, "Baskets", 43), (53, "Lids", 52), (54, "Handles", 53), (60, "Barn", None, 7, "Indoor"),
]


def names(tree):
    return [(c["categoryId"], c["categoryName"]) for c in tree["subCategories"] or []]


def test_trees_nest_sort_by_name_then_id_and_keep_their_fields(spark):
    barn, orchard = build(spark, ORCHARD, [40, 60])
    assert barn["categoryName"] == "Barn" and barn["subCategories"] is None
    assert names(orchard) == [(42, "Apple"), (43, "Apple"), (41, "Pear")]
    assert list(orchard) == ["categoryId", "categoryName", "parentCategoryId", "catalogSegmentId", "catalogSegmentName", "subCategories"]
    assert (orchard["catalogSegmentId"], orchard["catalogSegmentName"]) == (3, "Outdoor")
    plain, full, pear = orchard["subCategories"]
    assert plain["subCategories"] is None and pear["subCategories"] is None and plain["catalogSegmentName"] is None
    assert names(full) == [(52, "Baskets"), (51, "Crates")]


def test_a_tree_is_as_deep_as_its_data(spark):
    [node] = build(spark, ORCHARD, [43])
    path = []
    while node:
        path.append(node["categoryId"])
        node = node["subCategories"][0] if node["subCategories"] else None
    assert path == [43, 52, 53, 54]


def test_children_sorted_by_collation(spark):
    rows = [(9, "Attic"), (3, "lamps", 9), (4, "Easels", 9), (5, "Pens", 9), (6, "Stools", 9)]
    flat = spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], FLAT)
    ids = spark.createDataFrame([(9,)], "categoryId long")
    order = {}
    for collation in (None, "UNICODE"):
        tree = json.loads(taxonomy.nested_trees(flat, ids, collation).first().tree)
        order[collation] = [c["categoryName"] for c in tree["subCategories"]]
    assert order[None] == ["Easels", "Pens", "Stools", "lamps"]
    assert order["UNICODE"] == ["Easels", "lamps", "Pens", "Stools"]


def test_no_rows_no_trees(spark):
    assert build(spark, [], [40]) == []


def test_quotes_in_names_stay_valid_json(spark):
    [root] = build(spark, [(1, 'say "hi" \\ ,'), (2, "}]{", 1)], [1])
    assert root["categoryName"] == 'say "hi" \\ ,' and root["subCategories"][0]["categoryName"] == "}]{"


def test_roots_follow_edges_not_the_parent_property(micro):
    ids = {r.categoryId for r in taxonomy.roots(micro).collect()}
    assert ids == {1, 8, 9}  # 8 names a parent but has no edge; 6 and 7 form a cycle


def reachable(edges, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for child, parent in edges:
            if parent == at and child not in seen:
                seen.add(child)
                todo.append(child)
    return seen


def test_closure_equals_search_and_stops_on_cycles(micro):
    edges = [tuple(r) for r in micro.child_of.collect()]
    every = micro.category.select("categoryId")
    expected = {(r.categoryId, c) for r in every.collect() for c in reachable(edges, r.categoryId)}
    rows = closure(micro.child_of, every).collect()
    assert len(rows) == len(expected)
    assert {(r.rootId, r.categoryId) for r in rows} == expected


def depths(edges, start):
    found, level, depth = {start: 0}, [start], 0
    while level:
        depth += 1
        level = sorted({c for c, p in edges if p in level} - set(found))
        found.update((c, depth) for c in level)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_closure_depths_of_random_graphs(spark, seed):
    """Several parents, cycles, self-loops, repeated and null edges; least depths, with and without a limit."""
    rng = random.Random(seed)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(rng.choice([8, 16, 30]))] + [(1, 1), (2, 3), (2, 3)]
    child_of = spark.createDataFrame(edges + [(None, 1), (1, None)], "childId long, parentId long")
    roots = spark.createDataFrame([(r,) for r in (0, 1, 5, 5, 99)], "categoryId long")
    want = {(r, c, d) for r in (0, 1, 5, 99) for c, d in depths(edges, r).items()}
    assert sorted(tuple(r) for r in closure(child_of, roots).collect()) == sorted(want)
    limited = closure(child_of, roots, max_levels=3).collect()
    assert sorted(tuple(r) for r in limited) == sorted(w for w in want if w[2] <= 3)
    labelled = closure(child_of.withColumn("name", F.concat(F.lit("n"), "childId")), roots, label="name").collect()
    assert len(labelled) == len(want) and all(len(r.path) == r.depth and (r.path or [f"n{r.categoryId}"])[-1] == f"n{r.categoryId}" for r in labelled)


def test_a_chain_of_2000_levels_takes_few_rounds(spark, monkeypatch):
    module = sys.modules[closure.__module__]
    rounds = []
    monkeypatch.setattr(module, "stage", lambda df, label, real=module.stage: rounds.append(label) or real(df, label))
    chain = spark.range(2000).selectExpr("id + 1 as childId", "id as parentId")
    rows = closure(chain, spark.createDataFrame([(0,)], "categoryId long"))
    assert rows.count() == 2001 and rows.where("depth <> categoryId").isEmpty()
    assert len(rounds) - 1 <= 12


def nested_in_python(rows, root):
    kids = lambda at: sorted((r for r in rows if r[2] == at), key=lambda r: (r[1], r[0]))
    def node(r):
        below = [node(c) for c in kids(r[0])]
        return {"categoryId": r[0], "categoryName": r[1], "parentCategoryId": r[2], "catalogSegmentId": None, "catalogSegmentName": None, "subCategories": below or None}
    return node(next(r for r in rows if r[0] == root))


@pytest.mark.parametrize("seed", range(3))
def test_random_trees_and_their_intervals(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "c", "d"]), rng.choice([None, *range(i)]) if i else None) for i in range(60)]
    tops = [r[0] for r in rows if r[2] is None]
    assert sorted(json.dumps(t) for t in build(spark, rows, tops)) == sorted(json.dumps(nested_in_python(rows, t)) for t in tops)
    monkeypatch.setattr(taxonomy, "sliced_positions", lambda df, keys, order, real=taxonomy.sliced_positions: real(df, keys, order, 5))
    flat = spark.createDataFrame([r + (None, None) for r in rows], FLAT)
    number = {(r.rootId, r.categoryId): r for r in taxonomy.numbered_tree(flat, spark.createDataFrame([(t,) for t in tops], "categoryId long")).collect()}

    def walk(tree, root, at):
        row = number.pop((root, tree["categoryId"]))
        assert row.left == at
        for child in tree["subCategories"] or []:
            at = walk(child, root, at + 1)
        assert row.right == at
        return at

    for top in tops:
        walk(nested_in_python(rows, top), top, 1)
    assert not number


def test_all_segments_trees_equal_the_trees_of_each_segment(micro):
    every = {(r.segmentId, r.categoryId): r.tree for r in taxonomy.all_segment_trees(micro).collect()}
    single = {(s, r.categoryId): r.tree for s in (1, 2) for r in taxonomy.segment_trees(micro, s).items.collect()}
    assert every == single and every
    spans = taxonomy.segment_intervals(micro).collect()
    assert {(r.treeSegmentId, r.categoryId) for r in spans if r.depth == 0} == set(every)


def test_two_parents_and_two_segments_keep_the_least(micro):
    row = taxonomy.flat_categories(micro).where("categoryId = 5").collect()
    assert [tuple(r) for r in row] == [(5, "Shared", 2, 1, "Outdoor")]


def test_subtree_keeps_parent_outside_it(micro):
    page = taxonomy.category_subtree(micro, 2)
    [tree] = [json.loads(r.tree) for r in page.items.collect()]
    assert tree["parentCategoryId"] == 1
    assert [c["categoryName"] for c in tree["subCategories"]] == ["Shared", "Small pumps"]
    assert (page.total_count, page.page_size, page.total_pages, page.has_more) == (1, 1, 1, False)


def test_subtree_holds_children_whose_least_parent_lies_outside(micro):
    [tree] = [json.loads(r.tree) for r in taxonomy.category_subtree(micro, 3).items.collect()]
    assert names(tree) == [(5, "Shared")]


def test_unknown_subtree_is_an_empty_page(micro):
    page = taxonomy.category_subtree(micro, 999)
    assert page.items.collect() == []
    assert (page.total_count, page.total_pages, page.has_more) == (0, 0, False)


def test_cycle_subtree_is_cut(micro):
    [tree] = [json.loads(r.tree) for r in taxonomy.category_subtree(micro, 6).items.collect()]
    assert tree["subCategories"][0]["categoryId"] == 7
    assert tree["subCategories"][0]["subCategories"] is None


def test_root_pages_count_roots_and_expand_only_the_page(micro):
    page = taxonomy.category_trees(micro, 1, 2)
    trees = [json.loads(r.tree) for r in page.items.collect()]
    assert [t["categoryName"] for t in trees] == ["Garden", "Outside"]
    assert (page.total_count, page.total_pages, page.has_more) == (3, 2, True)


def test_segment_roots_are_roots_in_the_segment_with_all_descendants(micro):
    page = taxonomy.segment_trees(micro, 1)
    [tree] = [json.loads(r.tree) for r in page.items.collect()]
    assert tree["categoryId"] == 1 and page.total_count == 1  # 5 and 10 are in it but are no roots
    pumps = [c for c in tree["subCategories"] if c["categoryName"] == "Pumps"]
    assert pumps[0]["catalogSegmentName"] == "Indoor"


@pytest.mark.parametrize("segment", [2, 77])
def test_segment_without_roots(micro, segment):
    page = taxonomy.segment_trees(micro, segment)
    assert page.items.collect() == [] and page.total_count == 0


def test_child_counts(micro):
    counts = {r.categoryId: r.children for r in taxonomy.child_counts(micro).collect()}
    assert counts[1] == 3 and counts[4] == 0 and len(counts) == 11
