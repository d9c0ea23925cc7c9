"""Every query by name: name -> callable(spark, folder) -> DataFrame.

Each runs over the whole tables of the folder. Queries about one product, one category or one
term are point lookups by nature; every one of them also has a form for all keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paging, text
from ..operators.closure import closure
from ..operators.embedding import fastrp
from ..operators.expand import brand_product_counts, by_name, product_rows, with_brand
from ..operators.neighbours import knn
from ..operators.projection import project_graph, projection_stats
from ..operators.ranking import with_page
from ..plans import listing, recent, search, serving, similarity, suggest, taxonomy
from ..session import checkpoint_root, stage
from ..sources import quality
from ..sources.binding import EVENT_SCHEMA, bind_folder, read_events, view_events
from ..sources.page_store import PageStore
from ..sources.schema import EDGE_ENDS, CatalogGraph
from ..sources.tables import clear_graph, read_graph, read_similar_to, write_graph, write_similar_to
from ..streaming import recent as recent_stream

# Keys of the point lookups.
PRODUCT, CATEGORY, SEGMENT, TERM = 8, 101, 1, "bol"
VECTOR_CUTOFF = 0.2  # the ready-made vectors are nearly random, so few pairs reach the default

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


_edges_at: dict[tuple[str, str], str] = {}


def stored_similar_to(spark: SparkSession, folder: str) -> DataFrame:
    """The similarity edges as readers see them: built once per application, then read from storage."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _edges_at:
        path = f"{checkpoint_root(spark)}/similar-to-{uuid.uuid4().hex}"
        similarity.write_build(bind_folder(spark, folder), path)
        _edges_at[key] = path
    return read_similar_to(spark, _edges_at[key])


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _folded(parameters: str = "parameters") -> F.Column:
    """Nested parameter list as one text, in its own order."""
    return F.array_join(
        F.transform(parameters, lambda p: F.concat_ws("=", p["parameterName"], p["parameterId"].cast("string"), p["value"])),
        ";",
    )


# ---- scans, projection, checks ----------------------------------------------------------------


@query
def scan_products(spark, folder):
    return bind_folder(spark, folder).product.drop("created_at")


@query
def scan_edges(spark, folder):
    graph = bind_folder(spark, folder)
    parts = []
    for name, ends in EDGE_ENDS.items():
        (a, _, _), (b, _, _) = ends
        parts.append(
            getattr(graph, name).select(
                F.lit(name).alias("edge"),
                F.col(a[0]).alias("fromId"),
                F.concat_ws("|", *[F.col(c).cast("string") for c in b]).alias("toKey"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


@query
def graph_projection(spark, folder):
    nodes, edges = project_graph(bind_folder(spark, folder))
    return nodes.select(
        F.lit("node").alias("kind"), F.col("node_key").alias("src"), F.lit(None).cast("string").alias("dst")
    ).unionByName(edges.select(F.lit("edge").alias("kind"), "src", "dst"))


@query
def projection_statistics(spark, folder):
    return projection_stats(*project_graph(bind_folder(spark, folder)))


QUERIES["projection_stats"] = QUERIES.pop("projection_statistics")


@query
def dq_unique_keys(spark, folder):
    return quality.unique_key_report(bind_folder(spark, folder))


@query
def dq_dangling_edges(spark, folder):
    return quality.edge_end_report(bind_folder(spark, folder))


# ---- listings ---------------------------------------------------------------------------------


@query
def segments_page(spark, folder):
    page = listing.segments(bind_folder(spark, folder), 1, 20)
    return page.items.select(
        "segmentId", "segmentName",
        F.lit(page.total_count).cast("bigint").alias("totalCount"),
        F.lit(page.total_pages).cast("bigint").alias("totalPages"),
        F.lit(page.has_more).alias("hasMore"),
    )


@query
def product_by_id(spark, folder):
    return listing.product_detail(bind_folder(spark, folder), PRODUCT).withColumn("parameters", _folded())


@query
def product_detail(spark, folder):
    return listing.product_details(bind_folder(spark, folder)).withColumn("parameters", _folded())


@query
def product_with_brand(spark, folder):
    return product_rows(bind_folder(spark, folder))


@query
def products_by_category(spark, folder):
    return listing.category_product_rows(bind_folder(spark, folder))


@query
def products_by_category_page(spark, folder):
    page = listing.products_by_category(bind_folder(spark, folder), CATEGORY // 100, 2, 10)
    return page.items.withColumns(
        {"totalCount": F.lit(page.total_count).cast("bigint"), "hasMore": F.lit(page.has_more)}
    )


@query
def category_product_pages(spark, folder):
    return listing.category_product_pages(bind_folder(spark, folder))


@query
def related_products(spark, folder):
    page = listing.related_products(bind_folder(spark, folder), PRODUCT, 1, 20)
    return page.items.withColumn("totalCount", F.lit(page.total_count).cast("bigint"))


@query
def related_totals(spark, folder):
    return listing.related_totals(bind_folder(spark, folder))


@query
def related_pages(spark, folder):
    return listing.related_pages(bind_folder(spark, folder))


@query
def brand_product_count(spark, folder):
    return brand_product_counts(bind_folder(spark, folder))


QUERIES["brand_product_counts"] = QUERIES.pop("brand_product_count")


@query
def list_totals(spark, folder):
    """Total of every list the catalogue offers, keyed by list and id."""
    graph = bind_folder(spark, folder)

    def total(rows: DataFrame, name: str, key: str | None = None) -> DataFrame:
        grouped = rows.groupBy(F.col(key).alias("key")) if key else rows.groupBy()
        out = grouped.agg(F.count("*").alias("total"))
        if not key:
            out = out.withColumn("key", F.lit(None).cast("bigint"))
        return out.select(F.lit(name).alias("list"), "key", "total")

    return reduce(
        DataFrame.unionByName,
        [
            total(graph.segment, "segments"),
            total(taxonomy.roots(graph), "roots"),
            total(graph.belongs_to, "categoryProducts", "categoryId"),
            total(taxonomy.segment_roots(graph), "segmentRoots", "segmentId"),
            total(suggest.served_edges(stored_similar_to(spark, folder)), "recommendations", "sourceId"),
        ],
    )


# ---- category trees ---------------------------------------------------------------------------


@query
def category_roots(spark, folder):
    return taxonomy.roots(bind_folder(spark, folder))


@query
def category_roots_page(spark, folder):
    return taxonomy.roots_page(taxonomy.roots(bind_folder(spark, folder)), 2, 3)


@query
def category_closure(spark, folder):
    graph = bind_folder(spark, folder)
    return closure(graph.child_of, graph.category.select("categoryId")).withColumn("depth", F.col("depth").cast("bigint"))


@query
def category_flat(spark, folder):
    return taxonomy.flat_categories(bind_folder(spark, folder))


@query
def category_flat_tree(spark, folder):
    graph = bind_folder(spark, folder)
    return taxonomy.flat_tree(graph, taxonomy.roots(graph)).withColumn("depth", F.col("depth").cast("bigint"))


@query
def category_tree(spark, folder):
    return taxonomy.category_trees(bind_folder(spark, folder), 1, 20).items


@query
def category_subtree(spark, folder):
    return taxonomy.category_subtree(bind_folder(spark, folder), CATEGORY).items


@query
def segment_category_tree(spark, folder):
    return taxonomy.segment_trees(bind_folder(spark, folder), SEGMENT, 1, 20).items


@query
def segment_trees_all(spark, folder):
    return taxonomy.all_segment_trees(bind_folder(spark, folder))


@query
def segment_tree_intervals(spark, folder):
    return taxonomy.segment_intervals(bind_folder(spark, folder)).withColumn("depth", F.col("depth").cast("bigint"))


@query
def category_child_counts(spark, folder):
    return taxonomy.child_counts(bind_folder(spark, folder))


# ---- search -----------------------------------------------------------------------------------


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    """Search terms asked in bulk: every brand name, every type and every word of a product name."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    words = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"))
    return part.select(F.explode(words).alias("term")).distinct()


@query
def search_term_guard(spark, folder):
    """Which raw inputs are searched: names as they are, their first letter, padded, and blank."""
    part = spark.read.parquet(f"{folder}/part.parquet")
    letter = F.substring("p_name", 1, 1)
    raw = F.array(F.col("p_name"), letter, F.concat(F.lit(" "), letter), F.lit(""), F.lit("   "), F.lit(None).cast("string"))
    return part.select(F.explode(raw).alias("term")).distinct().select(
        "term", F.coalesce(text.is_searchable(F.col("term")), F.lit(False)).alias("searched")
    )


@query
def search_products(spark, folder):
    return search.search_kind(bind_folder(spark, folder), "product", TERM)


@query
def search_brands(spark, folder):
    graph = bind_folder(spark, folder)
    return search.search_kind(graph, "brand", "brand#2").orderBy(F.desc("productCount"), "id").limit(5)


@query
def global_search(spark, folder):
    return search.global_search(bind_folder(spark, folder), TERM, 15)


@query
def search_bulk(spark, folder):
    return search.search_bulk(bind_folder(spark, folder), _terms(spark, folder))


# ---- embeddings, neighbours, similarity build ---------------------------------------------------


def _long_vectors(vectors: DataFrame) -> DataFrame:
    return _rounded(vectors.select("node_key", F.posexplode("embedding").alias("dim", "value")), "value").withColumn(
        "dim", F.col("dim").cast("bigint")
    )


@query
def fastrp_step(spark, folder):
    nodes, edges = project_graph(bind_folder(spark, folder))
    return _long_vectors(fastrp(nodes, edges, iteration_weights=(1.0,)))


@query
def fastrp_embedding(spark, folder):
    nodes, edges = project_graph(bind_folder(spark, folder))
    return _long_vectors(fastrp(nodes, edges))


@query
def knn_topk(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return _rounded(knn(vectors, cutoff=VECTOR_CUTOFF), "score")


@query
def knn_filtered(spark, folder):
    return _rounded(similarity.neighbour_edges(bind_folder(spark, folder), exact=True), "score")


@query
def neighbour_recall(spark, folder):
    """How much of the exact neighbour lists the stored graph holds, for every product whose id is divisible by 50."""
    found = similarity.neighbour_recall(bind_folder(spark, folder), stored_similar_to(spark, folder))
    return found.select("sources", "exactEdges", (F.col("recall") >= 0.9).alias("reached"))


@query
def knn_lsh(spark, folder):
    """Approximate form of knn_filtered: small locality-sensitive cells, the nearest of them probed."""
    return _rounded(similarity.neighbour_edges(bind_folder(spark, folder), cell_rows=64, probes=12), "score")


@query
def same_brand_pairs(spark, folder):
    graph = bind_folder(spark, folder)
    return similarity.same_brand_pairs(stored_similar_to(spark, folder), graph.made_by)


@query
def brand_boost(spark, folder):
    """The bonus on the exact neighbours of the whole catalogue."""
    graph = bind_folder(spark, folder)
    return _rounded(similarity.brand_boost(similarity.neighbour_edges(graph, exact=True), graph.made_by), "score")


@query
def similar_to_build(spark, folder):
    return _rounded(similarity.build_similar_to(bind_folder(spark, folder)), "score")


@query
def write_similar_edges(spark, folder):
    path = f"{checkpoint_root(spark)}/written-{uuid.uuid4().hex}"
    write_similar_to(stored_similar_to(spark, folder), path)
    return _rounded(read_similar_to(spark, path), "score")


QUERIES["write_similar_to"] = QUERIES.pop("write_similar_edges")


@query
def similarity_distribution(spark, folder):
    return similarity.score_summary(stored_similar_to(spark, folder))


@query
def build_summary(spark, folder):
    """What the job reports about its run; its edges are written and then left behind, and its staged tables are gone."""
    path = f"{checkpoint_root(spark)}/built-{uuid.uuid4().hex}"
    run = similarity.write_build(bind_folder(spark, folder), path)
    return _rounded(run.select("nodePropertiesWritten", "nodesCompared", "relationshipsWritten", "minScore", "maxScore", "meanScore"), "minScore", "maxScore", "meanScore")


@query
def cleared_graph(spark, folder):
    """Rows of every table of a stored copy of the graph, before and after it is emptied."""
    path = f"{checkpoint_root(spark)}/graph-{uuid.uuid4().hex}"
    write_graph(bind_folder(spark, folder), path)
    count = lambda stored: reduce(DataFrame.unionByName, [t.agg(F.lit(n).alias("table"), F.count("*").alias("n")) for n, t in stored.tables().items()])
    before = stage(count(read_graph(spark, path)).withColumnRenamed("n", "rowsBefore"), "before")
    clear_graph(spark, path)
    return before.join(count(read_graph(spark, path)).withColumnRenamed("n", "rowsAfter"), "table")


@query
def similarity_count(spark, folder):
    return stored_similar_to(spark, folder).agg(F.count("*").alias("totalSimilarities"))


@query
def similarity_top10(spark, folder):
    rows = stored_similar_to(spark, folder).where(F.col("sourceId") == PRODUCT)
    named = bind_folder(spark, folder).product.select(F.col("productId").alias("targetId"), "productName")
    top = rows.orderBy(F.desc("score"), "targetId").limit(10).join(named, "targetId")
    return _rounded(top.select("targetId", "productName", "score", "sameBrand"), "score")


# ---- suggestions ------------------------------------------------------------------------------


@query
def recommendations(spark, folder):
    rows = suggest.all_recommendations(bind_folder(spark, folder), stored_similar_to(spark, folder))
    return _rounded(rows, "similarityScore")


@query
def recommendations_page(spark, folder):
    page = suggest.recommendations(bind_folder(spark, folder), stored_similar_to(spark, folder), PRODUCT, 1, 10)
    return _rounded(page.items, "similarityScore").withColumns(
        {"totalCount": F.lit(page.total_count).cast("bigint"), "hasMore": F.lit(page.has_more)}
    )


@query
def recommendations_other_brand(spark, folder):
    """First page of 50 of every product, then only other brands."""
    rows = suggest.all_recommendations(bind_folder(spark, folder), stored_similar_to(spark, folder))
    return _rounded(suggest.other_brand(rows.where("position <= 50")), "similarityScore")


@query
def recommendation_pages(spark, folder):
    pages = serving.recommendation_pages(bind_folder(spark, folder), stored_similar_to(spark, folder), page_size=10)
    ids = F.array_join(F.transform("items", lambda i: i["productId"].cast("string")), ",")
    return pages.withColumn("items", ids)


def _serving_table(spark: SparkSession, folder: str) -> DataFrame:
    """Serving table whose pages were computed at the product's last event time."""
    graph: CatalogGraph = bind_folder(spark, folder)
    pages = serving.recommendation_pages(graph, stored_similar_to(spark, folder), page_size=10)
    seen = (
        read_events(spark, folder)
        .groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("productId"))
        .agg(F.max("ts").cast("timestamp").alias("_at"))
    )
    timed = pages.join(seen, "productId", "left")
    at = F.coalesce("_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return serving.serving_table(timed, at)


@query
def page_payload_json(spark, folder):
    return _serving_table(spark, folder).select("cache_key", "payload")


@query
def page_payload_read(spark, folder):
    """Stored documents parsed back into columns, one row per suggestion."""
    parsed = _serving_table(spark, folder).select(
        "cache_key", serving.read_payload(F.col("payload")).alias("d")
    )
    rows = parsed.select("cache_key", F.col("d.similarProducts.totalCount").alias("totalCount"),
                         F.explode("d.similarProducts.items").alias("i"))
    return _rounded(
        rows.select("cache_key", "totalCount", "i.productId", "i.brandName", "i.similarityScore", "i.sameBrand"),
        "similarityScore",
    )


_pages_at: dict[tuple[str, str], str] = {}


def stored_pages(spark: SparkSession, folder: str) -> PageStore:
    """The page store as readers see it: filled once per application, then read from storage."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _pages_at:
        path = f"{checkpoint_root(spark)}/pages-{uuid.uuid4().hex}"
        PageStore.create(spark, path, _serving_table(spark, folder))
        _pages_at[key] = path
    return PageStore(spark, _pages_at[key])


def own_pages(spark: SparkSession, folder: str) -> PageStore:
    """A fork of the stored pages that a query may change."""
    return stored_pages(spark, folder).fork(f"{checkpoint_root(spark)}/pages-{uuid.uuid4().hex}")


def _asked_pages(spark: SparkSession, folder: str) -> tuple[DataFrame, F.Column]:
    """Every event asks for page 1 of its product, as of the last event overall. Staged, as the store reads its requests several times."""
    asked = stage(read_events(spark, folder).select(
        F.concat_ws(":", F.lit("recs"), F.get_json_object("props", "$.k"), F.lit("1"), F.lit("10")).alias("cache_key")
    ).distinct(), "asked-pages")
    return asked, F.lit(read_events(spark, folder).agg(F.max("ts").alias("at")).first()["at"]).cast("timestamp")


@query
def page_cache_lookup(spark, folder):
    asked, as_of = _asked_pages(spark, folder)
    return stored_pages(spark, folder).look_up(asked, as_of).select("cache_key", "hit")


@query
def page_read_through(spark, folder):
    """The same requests, misses refilled in the store; hitAfter asks once more."""
    asked, as_of = _asked_pages(spark, folder)
    store = own_pages(spark, folder)
    compute = serving.refill(bind_folder(spark, folder), stored_similar_to(spark, folder), as_of)
    answered = store.read_through(asked, as_of, compute)
    again = store.look_up(asked, as_of).select("cache_key", F.col("hit").alias("hitAfter"))
    total = serving.read_payload(F.col("payload"))["similarProducts"]["totalCount"]
    return answered.join(again, "cache_key").select("cache_key", "hit", "refilled", "hitAfter", total.alias("totalCount"))


@query
def page_cache_invalidate(spark, folder):
    """Products that were purchased changed; their pages go."""
    changed = read_events(spark, folder).where("event_type = 'purchase'").select(
        F.get_json_object("props", "$.k").cast("bigint").alias("productId")
    )
    store = own_pages(spark, folder)
    store.remove(changed)
    return store.read().select("cache_key", "product_id")


@query
def page_cache_clear_prefix(spark, folder):
    """Every page of products whose id starts with 1 goes, by the prefix of their keys."""
    store = own_pages(spark, folder)
    store.remove_prefix("recs:1")
    return store.read().select("cache_key", "product_id")


# ---- recently viewed ----------------------------------------------------------------------------


@query
def recent_items(spark, folder):
    views = view_events(read_events(spark, folder))
    return recent.with_display(recent.recent_items(views), bind_folder(spark, folder))


@query
def recent_items_stream(spark, folder):
    """The same lists from a stream over the events file, run until it is drained."""
    run = f"{checkpoint_root(spark)}/recent-{uuid.uuid4().hex}"
    events = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(folder)
    recent_stream.start(view_events(events), f"{run}/updates", f"{run}/checkpoint").awaitTermination()
    updates = spark.read.parquet(f"{run}/updates")
    return recent.with_display(recent_stream.current_lists(updates), bind_folder(spark, folder))


# ---- pages and scalar functions -----------------------------------------------------------------


@query
def page_normalize(spark, folder):
    """Each event as a raw page request: page from its value, size from its key."""
    raw = read_events(spark, folder).select(
        "event_id",
        (F.floor("value").cast("bigint") - 3).alias("rawPage"),
        (F.get_json_object("props", "$.k").cast("bigint") * 2 - 20).alias("rawSize"),
    )
    return raw.select(
        "event_id",
        paging.normalized_page(F.col("rawPage")).alias("page"),
        paging.normalized_page_size(F.col("rawSize")).alias("pageSize"),
        paging.normalized_page_size(F.col("rawSize"), 15).alias("pageSizeDefault15"),
    )


@query
def page_envelope(spark, folder):
    """Envelope of every user's event list, at the page of the user's number of event types."""
    users = read_events(spark, folder).groupBy("user_id").agg(
        F.count("*").alias("totalCount"), F.count_distinct("event_type").alias("page")
    )
    return users.select(
        "user_id", "totalCount", "page",
        paging.total_pages(F.col("totalCount"), 20).alias("totalPages"),
        paging.has_more(F.col("page"), F.col("totalCount"), 20).alias("hasMore"),
    )


@query
def scalar_suite(spark, folder):
    """One row per product, one column per scalar function."""
    p = bind_folder(spark, folder).product
    words = F.split("productName", " ")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    price = F.col("productId") / 7.0
    return p.select(
        "productId",
        F.coalesce("productDescription", F.lit("none")).alias("coalesced"),
        (price + 0.01).alias("added"),
        F.struct(F.col("productName").alias("n"))["n"].alias("field"),
        F.array_join(F.slice(words, 1, 1), ",").alias("sliced"),
        text.escaped(F.concat(F.col("productName"), F.lit(".*+(x)"))).alias("escaped"),
        text.serving_key(F.col("productId"), F.lit(1), F.lit(20)).alias("servingKey"),
        text.joined_errors(words).alias("joined"),
        (F.length(F.trim("productName")) > 0).alias("notBlank"),
        F.ceil(F.col("productId") / 3).cast("bigint").alias("ceiling"),
        F.least(F.col("brandId"), F.lit(10)).cast("bigint").alias("smaller"),
        F.col("productId").cast("string").alias("asText"),
        F.when(F.col("brandId") > 12, F.col("brandId")).otherwise(5).cast("bigint").alias("defaulted"),
        F.unix_seconds(serving.expiry(start + F.make_dt_interval(mins=F.col("productId").cast("int")))).alias("expires"),
        text.serving_key(F.col("productId"), F.lit(1), F.lit(20)).startswith("recs:12:").alias("keyed"),
        F.format_string("%.4f", F.round(price, 4)).alias("shown"),
    )


def _vector_suite(spark: SparkSession, folder: str) -> DataFrame:
    """Length and cosine against the label's least vector id, per ready-made vector."""
    v = spark.read.parquet(f"{folder}/embeddings.parquet").withColumn("e", F.col("embedding").cast("array<double>"))
    first = v.groupBy("label").agg(F.min(F.struct("vec_id", "e")).alias("_f"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pair = v.join(first, "label")
    cosine = dot(F.col("e"), F.col("_f.e")) / F.sqrt(dot(F.col("e"), F.col("e")) * dot(F.col("_f.e"), F.col("_f.e")))
    return _rounded(
        pair.select("vec_id", F.sqrt(dot(F.col("e"), F.col("e"))).alias("norm"), cosine.alias("cosine")), "norm", "cosine"
    )


QUERIES["vector_suite"] = _vector_suite
