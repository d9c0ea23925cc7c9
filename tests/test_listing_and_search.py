import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from shelfgraph.functions.text import is_searchable_text, search_pattern_text
from shelfgraph.plans import listing, search
from shelfgraph.sources import quality, tables


def with_belongs(graph, rows):
    spark = graph.product.sparkSession
    return dataclasses.replace(graph, belongs_to=spark.createDataFrame(rows, "productId long, categoryId long"))


def test_segments_sorted_and_counted(micro):
    page = listing.segments(micro, 1, 1)
    assert [r.segmentName for r in page.items.collect()] == ["Indoor"]
    assert (page.total_count, page.total_pages, page.has_more) == (2, 2, True)


def test_category_lists_direct_members_once_per_brand_but_counts_members(micro):
    page = listing.products_by_category(micro, 1)
    rows = [(r.productId, r.brandId) for r in page.items.collect()]
    assert rows == [(1, 1), (1, 2), (2, 1), (2, 2)]  # nothing from child category 3 or 4
    assert page.total_count == 2


def test_listed_category_is_the_products_own(micro):
    rows = listing.products_by_category(micro, 3).items.collect()
    assert [(r.productId, r.categoryId) for r in rows] == [(6, 2)]


def test_pages_cover_the_list_without_overlap(micro):
    one = [tuple(r) for r in listing.products_by_category(micro, 2).items.collect()]
    cut = []
    for number in (1, 2, 3, 4):
        cut += [tuple(r) for r in listing.products_by_category(micro, 2, number, 2).items.collect()]
    assert cut == one and len(one) == 6


def test_bulk_pages_equal_single_pages(micro):
    bulk = listing.category_product_pages(micro, 2).collect()
    for category in (1, 2, 3, 4):
        single = listing.products_by_category(micro, category, 2, 2)
        mine = sorted((r for r in bulk if r.listedCategoryId == category and r.page == 2), key=lambda r: r.position)
        assert [(r.productId, r.brandId) for r in mine] == [(r.productId, r.brandId) for r in single.items.collect()]
        for r in mine:
            assert (r.total, r.totalPages, r.hasMore) == (single.total_count, single.total_pages, single.has_more)


def test_detail_takes_lowest_brand_and_sorts_parameters(micro):
    rows = {r.productId: r for r in listing.product_details(micro).collect()}
    assert len(rows) == 9
    assert rows[1].brandId == 1
    assert [(p.parameterName, p.value) for p in rows[1].parameters] == [("Age", "3"), ("Colour", "blue"), ("Colour", "red")]
    assert rows[3].parameters == [] and rows[3].brandId is None and rows[3].productName is None
    assert listing.product_detail(micro, 1).collect() == [rows[1]]


def test_detail_with_a_collation(micro):
    rows = {r.productId: r for r in listing.product_details(micro, collation="UNICODE").collect()}
    assert [p.parameterName for p in rows[1].parameters] == ["Age", "Colour", "Colour"] and rows[3].parameters == []


def test_unknown_product_is_an_error(micro):
    with pytest.raises(KeyError, match="Product with id '123' was not found."):
        listing.product_detail(micro, 123)


def test_related_is_distinct_without_self(micro):
    page = listing.related_products(micro, 1)
    assert [(r.productId, r.brandId) for r in page.items.collect()] == [(2, 1), (2, 2), (4, 2), (5, 2)]
    assert page.total_count == 3  # distinct products, while rows multiply per brand


def random_membership(seed, products=40, categories=14):
    rng = random.Random(seed)
    rows = []
    for p in range(products):
        wanted = rng.choice([0, 1, 1, 1, 2, 3, 5, 9, 11])  # 9 and 11 exceed the narrow bound
        rows += [(p, c) for c in rng.sample(range(categories), wanted)]
    rows += [(p, 0) for p in range(0, products, 3)]  # one category holds a third, with repeats
    return rows


def brute_related(rows, products):
    by_category = {}
    for p, c in rows:
        by_category.setdefault(c, set()).add(p)
    found = {p: set() for p in range(products)}
    for group in by_category.values():
        for p in group:
            found[p] |= group
    return {p: s - {p} for p, s in found.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_related_totals_and_pages_against_brute_force(spark, micro, seed):
    rows = random_membership(seed)
    named = [(p, None if p % 13 == 0 else f"n{p % 5}", None, None, None, None) for p in range(40)]
    brands = [(p, b) for p in range(40) for b in (1, 2)[: p % 3]]
    graph = dataclasses.replace(
        with_belongs(micro, rows),
        product=spark.createDataFrame(named, micro.product.schema),
        made_by=spark.createDataFrame(brands, micro.made_by.schema),
    )
    expected = brute_related(rows, 40)
    totals = {r.productId: r.total for r in listing.related_totals(graph).collect()}
    assert totals == {p: len(s) for p, s in expected.items()}

    name = {p: n for p, n, *_ in named}
    brand_of = {p: sorted(b for q, b in brands if q == p) or [None] for p in range(40)}
    for page, size in ((1, 4), (2, 4), (1, 50)):
        got = {}
        for r in sorted(listing.related_pages(graph, page, size).collect(), key=lambda r: r.position):
            got.setdefault(r.sourceId, []).append((r.productId, r.brandId))
        for p, others in expected.items():
            ordered = sorted(others, key=lambda q: (name[q] is None, name[q] or "", q))
            full = [(q, b) for q in ordered for b in brand_of[q]]
            assert got.get(p, []) == full[(page - 1) * size : page * size], (p, page, size)


def test_a_hot_category_of_wide_products_forms_no_product_pairs(spark, micro):
    """A third of all products share one category and have more than eight each."""
    rng = random.Random(8)
    rows = [(p, 0) for p in range(0, 300, 3)] + [(p, c) for p in range(0, 300, 3) for c in rng.sample(range(1, 60), 9)]
    rows += [(p, rng.randrange(60)) for p in range(300) if p % 3 and p % 7]
    graph = dataclasses.replace(
        with_belongs(micro, [(10**9 * p, c) for p, c in rows]), product=spark.createDataFrame([(10**9 * p, None, None, None, None, None) for p in range(300)], micro.product.schema)
    )
    found = listing.related_totals(graph)
    assert {r.productId // 10**9: r.total for r in found.collect()} == {p: len(s) for p, s in brute_related(rows, 300).items()}


def rows_of(found, kind):
    return [(r.id, r.relatedName) for r in found if r.kind == kind]


def test_search_lists(micro):
    found = sorted(search.global_search(micro, "alpha", 10).collect(), key=lambda r: (r.kind, r.position))
    assert rows_of(found, "product") == [(9, None), (1, "Alphabrand"), (1, "Beta Works")]
    assert rows_of(found, "category") == [(11, "Garden")]
    brands = [(r.id, r.productCount) for r in found if r.kind == "brand"]
    assert brands == [(1, 2), (9, 0)]  # most products first; a brand without products stays


def test_search_limit_is_per_kind(micro):
    found = search.global_search(micro, "alpha", 1).collect()
    assert sorted(r.kind for r in found) == ["brand", "category", "product"]


@pytest.mark.parametrize("term", ["", " ", "a", None])
def test_search_guard(micro, term):
    assert search.global_search(micro, term, 5).collect() == []


@pytest.mark.parametrize("term, ids", [("c++ (NEW)", {6}), (".*", set()), ("two", set()), ("CAFé", {8}), ("CAFÉ", set()), ("o\nl", {7})])
def test_search_terms_are_literal(micro, term, ids):
    assert {r.id for r in search.search_kind(micro, "product", term).collect()} == ids


def test_bulk_search_equals_single_searches(spark, micro):
    terms = ["alpha", "be", "C++ (new)", "same", "é", "a", "", " a", "zz", "ph", "Garden", "two\nlines", None]
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    for limit in (1, 2, 10):
        bulk = {}
        for r in search.search_bulk(micro, table, limit).collect():
            bulk.setdefault(r.term, set()).add(tuple(r)[1:])
        for term in terms:
            assert bulk.get(term, set()) == {tuple(r) for r in search.global_search(micro, term, limit).collect()}, term


def test_quality_reports(spark, micro):
    assert quality.duplicate_keys(micro).collect() == []
    assert quality.dangling_edges(micro).collect() == []
    broken = dataclasses.replace(
        micro,
        brand=micro.brand.unionByName(micro.brand.where("brandId = 1")),
        made_by=micro.made_by.unionByName(spark.createDataFrame([(1, 77), (2, 77)], micro.made_by.schema)),
    )
    assert [tuple(r) for r in quality.duplicate_keys(broken).collect()] == [("brand", "1", 2)]
    assert [tuple(r) for r in quality.dangling_edges(broken).collect()] == [("made_by", "brand", "77", 2)]


def test_graph_round_trip_and_clear(spark, micro, tmp_path):
    root = str(tmp_path / "graph")
    tables.write_graph(micro, root)
    stored = tables.read_graph(spark, root)
    for name, table in micro.tables().items():
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(getattr(stored, name).collect(), key=key) == sorted(table.collect(), key=key)
    assert "PushedFilters: [IsNotNull(productId), EqualTo(productId,1)]" in stored.product.where(
        F.col("productId") == 1
    )._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    tables.clear_graph(spark, root)
    assert all(t.isEmpty() for t in tables.read_graph(spark, root).tables().values())


@pytest.mark.parametrize("group_bytes", [1 << 22, 12])
def test_bulk_matches_equal_the_pattern_of_every_term(spark, monkeypatch, group_bytes):
    """Nested, overlapping and folded terms, line ends inside and outside of them, a term in a third of all names."""
    monkeypatch.setattr(search, "GROUP_BYTES", group_bytes)
    rng = random.Random(2)
    names = [(i, ("hot" if i % 3 == 0 else "") + "".join(rng.choice("aAbBé .\n\r\u2028*") for _ in range(rng.randint(0, 9)))) for i in range(200)] + [(500, None), (501, "")]
    terms = ["hot", "HOT", "ab", "a", "aba", "b a", "a\nb", "\n\n", "\r\n", ".*", "é ", "É ", "  ", "", None, "ba", "ba", "a\u2028"]
    table = spark.createDataFrame(names, "id long, name string")
    got = search.matching_names(spark.createDataFrame([(t,) for t in terms], "term string"), table).collect()
    want = set()
    for term in {t for t in terms if is_searchable_text(t)}:
        want |= {(term, r.id) for r in table.where(F.col("name").rlike(search_pattern_text(term))).collect()}
    assert len(got) == len(want) and {(r.term, r.id) for r in got} == want
    assert len([1 for t, _ in want if t == "hot"]) >= 20
