import pytest
from pyspark.sql import functions as F

from shelfgraph.functions import paging, text


@pytest.mark.parametrize(
    "given, expected",
    [
        ((0, 10), (1, 10)), ((-1, 10), (1, 10)), ((5, 10), (5, 10)), ((1, 200), (1, 100)),
        ((1, 0), (1, 20)), ((1, -5), (1, 20)), ((1, 0, 15), (1, 15)),
    ],
)
def test_normalize(spark, given, expected):
    assert paging.normalize(*given) == expected
    row = spark.createDataFrame([given[:2]], "page long, size long").select(
        paging.normalized_page(F.col("page")), paging.normalized_page_size(F.col("size"), *given[2:])
    ).first()
    assert tuple(row) == expected


@pytest.mark.parametrize(
    "total, page, size, pages, more",
    [(25, 1, 10, 3, True), (21, 3, 10, 3, False), (0, 1, 10, 0, False), (2, 1, 10, 1, False), (20, 1, 10, 2, True), (0, 1, 0, 0, False)],
)
def test_envelope(spark, total, page, size, pages, more):
    got = paging.Page(None, total, page, size)
    assert (got.total_pages, got.has_more) == (pages, more)
    row = spark.createDataFrame([(total, page, size)], "t long, p long, s long").select(
        paging.total_pages(F.col("t"), F.col("s")), paging.has_more(F.col("p"), F.col("t"), F.col("s"))
    ).first()
    assert tuple(row) == (pages, more)


def test_keys_and_prefixes(spark):
    rows = spark.createDataFrame([(123, 1, 10), (456, 2, 20), (1, 100, 50)], "p long, n long, s long")
    keys = [r[0] for r in rows.select(text.serving_key(F.col("p"), F.col("n"), F.col("s"))).collect()]
    assert keys == ["recs:123:1:10", "recs:456:2:20", "recs:1:100:50"]
    prefix = [r[0] for r in rows.select(text.serving_prefix(F.col("p"))).collect()]
    assert prefix == ["recs:123:", "recs:456:", "recs:1:"]


def test_error_text(spark):
    assert text.not_found_text("Product", 123) == "Product with id '123' was not found."
    row = spark.range(1).select(text.joined_errors(F.array(F.lit("a"), F.lit("b")))).first()
    assert row[0] == "a; b"


NAMES = ["a.b", "axb", "A.B extra", "C++ (new)", "line\nbreak a.b", "a.b\n", "É.b", "x-é-y", "tab\there", "[k]", "back\\slash", "50% {off}"]
TERMS = ["a.b", "++", "(new)", "é", "É", "[k", "\\s", "% {", "line\nbreak", ".*", "b", " (", "t\th"]


def test_pattern_is_literal_ascii_insensitive_and_stays_on_one_line(spark):
    def expected(name, term):
        fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
        breaks = "\n\r\u0085\u2028\u2029"
        at = -1
        while True:
            at = fold(name).find(fold(term), at + 1)
            if at < 0:
                return False
            if not set(name[:at] + name[at + len(term):]) & set(breaks):
                return True

    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    got = (
        names.crossJoin(terms.withColumn("pattern", text.search_pattern(F.col("term"))))
        .select("name", "term", F.expr("name RLIKE pattern").alias("hit")).collect()
    )
    for row in got:
        assert row.hit == expected(row.name, row.term), (row.name, row.term)
    for term in TERMS:
        hits = {r[0] for r in names.where(F.col("name").rlike(text.search_pattern_text(term))).collect()}
        assert hits == {n for n in NAMES if expected(n, term)}


@pytest.mark.parametrize("term, ok", [("", False), (" ", False), ("a", False), ("   ", False), (" a", True), (".*", True), (None, False)])
def test_term_guard(spark, term, ok):
    assert text.is_searchable_text(term) is ok
    row = spark.createDataFrame([(term,)], "t string").select(F.coalesce(text.is_searchable(F.col("t")), F.lit(False))).first()
    assert row[0] is ok


def test_search_limit_has_a_default_and_no_cap():
    assert [text.effective_limit(v) for v in (None, 0, -3, 7, 5000)] == [5, 5, 5, 7, 5000]
