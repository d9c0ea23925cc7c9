"""Name search over products, categories and brands: one term, or a table of terms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import effective_limit, fold_text, is_searchable, is_searchable_text, search_pattern_text
from ..operators.expand import brand_product_counts, by_name, product_brands
from ..operators.ranking import first_per_key
from ..session import stage
from ..sources.schema import CatalogGraph

RESULT_COLUMNS = ["kind", "position", "id", "name", "relatedName", "productCount"]


def _product_hits(graph: CatalogGraph, hits: DataFrame) -> DataFrame:
    """Distinct (product, brand name) rows of matching products."""
    names = product_brands(graph).select("productId", F.col("brandName").alias("relatedName"))
    return hits.join(names, hits.id == names.productId, "left").drop("productId").distinct()


def _category_hits(graph: CatalogGraph, hits: DataFrame) -> DataFrame:
    parent = graph.child_of.join(
        graph.category.select(F.col("categoryId").alias("parentId"), F.col("categoryName").alias("relatedName")),
        "parentId",
    ).select("childId", "relatedName")
    return hits.join(parent, hits.id == parent.childId, "left").drop("childId").distinct()


def _brand_hits(graph: CatalogGraph, hits: DataFrame) -> DataFrame:
    counts = brand_product_counts(graph).select("brandId", "productCount")
    return hits.join(counts, hits.id == counts.brandId).drop("brandId")



def _place_by_name() -> list[Column]:
    return [*by_name("name", "id"), F.asc_nulls_last("relatedName")]


def _place_by_count() -> list[Column]:
    return [F.desc("productCount"), F.asc("id")]


def _named(graph: CatalogGraph) -> dict[str, DataFrame]:
    return {
        "product": graph.product.select(F.col("productId").alias("id"), F.col("productName").alias("name")),
        "category": graph.category.select(F.col("categoryId").alias("id"), F.col("categoryName").alias("name")),
        "brand": graph.brand.select(F.col("brandId").alias("id"), "name"),
    }


def _shape(rows: DataFrame, kind: str) -> DataFrame:
    for missing, type_ in (("relatedName", "string"), ("productCount", "bigint")):
        if missing not in rows.columns:
            rows = rows.withColumn(missing, F.lit(None).cast(type_))
    return rows.withColumn("kind", F.lit(kind))


def search_kind(graph: CatalogGraph, kind: str, term: str) -> DataFrame:
    """All matches of one kind for one term, unlimited: (id, name, relatedName | productCount)."""
    names = _named(graph)[kind]
    hits = names.where(F.col("name").rlike(search_pattern_text(term)) if is_searchable_text(term) else F.lit(False))
    return {"product": _product_hits, "category": _category_hits, "brand": _brand_hits}[kind](graph, hits)


def global_search(graph: CatalogGraph, term: str, limit: int | None = None) -> DataFrame:
    """Three typed lists as tagged rows, each cut to `limit` (0 or less means the default).

    Each list is a bounded top-k; the lists are united, not paired row by row.
    """
    limit = effective_limit(limit)
    parts = []
    for kind in ("product", "category", "brand"):
        order = _place_by_count() if kind == "brand" else _place_by_name()
        top = _shape(search_kind(graph, kind, term), kind).orderBy(*order).limit(limit)
        parts.append(_positions(top, ["kind"], order).select(*RESULT_COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def _positions(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Positions inside groups that were already cut to the limit."""
    return rows.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))


# Characters at which the pattern of a term stops: a name with one matches only if the term spans it.
LINE_ENDS = "\n\r\u0085\u2028\u2029"
GROUP_BYTES = 4 << 20  # terms of one automaton


class TermGroup:
    """Terms of bounded bytes, and their automaton, which each Python worker builds once."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.automaton = None

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "automaton": None}

    def built(self):
        import ahocorasick

        if self.automaton is None:
            filed: dict[str, list[int]] = {}
            for i, term in enumerate(self.terms):
                filed.setdefault(fold_text(term), []).append(i)
            machine = ahocorasick.Automaton()
            for folded, which in filed.items():
                machine.add_word(folded, (len(folded), which))
            machine.make_automaton()
            self.automaton = machine
        return self.automaton

    def found(self, name: str) -> list[int]:
        """Terms that occur in a name, each once; all line ends of the name have to lie inside the occurrence."""
        breaks = [i for i, c in enumerate(name) if c in LINE_ENDS]
        low, high = (breaks[0], breaks[-1]) if breaks else (len(name), -1)
        hits = {i for end, (size, which) in self.built().iter(fold_text(name)) if end - size + 1 <= low and high <= end for i in which}
        return sorted(hits)


def term_groups(terms: DataFrame) -> Iterator[TermGroup]:
    """The searchable terms in groups of about GROUP_BYTES, one at a time on the driver."""
    asked = stage(terms.select("term").where(is_searchable(F.col("term"))).distinct(), "terms")
    total = asked.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    groups = 1 + total // GROUP_BYTES
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("term"), F.lit(groups)) == g).collect()
        if rows:
            yield TermGroup(sorted(r["term"] for r in rows))


def matching_names(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, id, name) for every term that occurs in a name.

    The terms of a group form one automaton (Aho and Corasick), so a name is read once per group, whatever the number of terms
    and however frequent their letters; nothing is joined. A term in a third of all names costs its hits only.
    """
    out = None
    for group in term_groups(terms):
        shared = names.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                rows, hits = [], []
                for row, name in enumerate(batch.column(1).to_pylist()):
                    if name:
                        found = known.found(name)
                        hits += found
                        rows += [row] * len(found)
                    if len(hits) >= 10_000 or row == batch.num_rows - 1:
                        at = pa.array(rows, pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([known.terms[i] for i in hits], pa.string()), batch.column(0).take(at), batch.column(1).take(at)], names=["term", "id", "name"]
                        )
                        rows, hits = [], []

        part = names.select("id", "name").mapInArrow(run, "term string, id bigint, name string")
        out = part if out is None else out.unionByName(part)
    return names.select(F.lit("").alias("term"), "id", "name").limit(0) if out is None else out


def search_bulk(graph: CatalogGraph, terms: DataFrame, limit: int | None = None) -> DataFrame:
    """global_search for every term of a table (column `term`)."""
    limit = effective_limit(limit)
    expand = {"product": _product_hits, "category": _category_hits, "brand": _brand_hits}
    parts = []
    for kind, names in _named(graph).items():
        order = _place_by_count() if kind == "brand" else _place_by_name()
        hits = matching_names(terms, names)
        if kind != "brand":
            # The order starts with (name, id), and a hit keeps at least one row when it is
            # expanded, so the cut can come before the expand as well as after it.
            hits = first_per_key(hits, ["term"], by_name("name", "id"), limit)
        rows = _shape(expand[kind](graph, hits), kind)
        top = first_per_key(rows, ["term"], order, limit)
        parts.append(_positions(top, ["term"], order).select("term", *RESULT_COLUMNS))
    return reduce(DataFrame.unionByName, parts)
