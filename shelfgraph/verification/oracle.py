"""Expected answers in SQL for an engine that shares no code with the Spark plans.

Statements are composed from common table expressions: the graph tables, the similarity
edges (embedding and brute-force neighbours spelled out), and the query itself.
"""

from __future__ import annotations

from ..operators.embedding import DIMENSION, ITERATION_WEIGHTS, SEED
from ..operators.neighbours import SCORE_DECIMALS
from ..plans.serving import TTL_MINUTES
from ..sources.binding import NOUNS, SEGMENT_NOUNS, TYPES
from .registry import CATEGORY, PRODUCT, SEGMENT, TERM, VECTOR_CUTOFF


def _names(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SEGMENT_OF = " ".join(
    f"WHEN noun IN ({', '.join(repr(n) for n in nouns)}) THEN {key}" for key, nouns in SEGMENT_NOUNS.items()
)

GRAPH = f"""
parts AS (
    SELECT p_partkey AS productId, p_name, split_part(p_name, ' ', 1) AS adjective,
           split_part(p_name, ' ', 2) AS noun, p_type, p_size, p_retailprice, p_brand,
           CAST(substr(p_brand, 7) AS BIGINT) AS brandId,
           CAST(list_position({_names(NOUNS)}, split_part(p_name, ' ', 2)) AS BIGINT) AS l1,
           CAST(list_position({_names(NOUNS)}, split_part(p_name, ' ', 2)) AS BIGINT) * 100
             + CAST(list_position({_names(TYPES)}, p_type) AS BIGINT) AS l2
    FROM part),
leaves AS (SELECT *, l2 * 10 + CAST(p_size // 10 AS BIGINT) AS l3 FROM parts),
product AS (
    SELECT productId, p_name AS productName,
           CASE WHEN productId % 10 = 0 THEN NULL ELSE p_type || ' ' || p_name END AS productDescription,
           brandId, l3 AS categoryId FROM leaves),
brand AS (SELECT DISTINCT brandId, p_brand AS name FROM leaves),
category AS (
    SELECT DISTINCT l1 AS categoryId, noun AS categoryName, CAST(NULL AS BIGINT) AS parentCategoryId, noun FROM leaves
    UNION ALL SELECT DISTINCT l2, noun || '/' || p_type, l1, noun FROM leaves
    UNION ALL SELECT DISTINCT l3, noun || '/' || p_type || '/' || CAST(p_size // 10 AS VARCHAR), l2, noun FROM leaves),
child_of AS (SELECT categoryId AS childId, parentCategoryId AS parentId FROM category WHERE parentCategoryId IS NOT NULL),
belongs_to AS (
    SELECT productId, l3 AS categoryId FROM leaves
    UNION ALL SELECT productId, l1 FROM leaves WHERE productId % 7 = 0),
made_by AS (SELECT productId, brandId FROM leaves WHERE productId % 17 <> 0),
held AS (
    SELECT productId, CAST(1 AS BIGINT) AS parameterId, 'Adjective' AS parameterName, adjective AS value FROM leaves WHERE productId % 23 <> 0
    UNION ALL SELECT productId, 2, 'Type', p_type FROM leaves WHERE productId % 23 <> 0
    UNION ALL SELECT productId, 3, 'Size', CAST(p_size AS VARCHAR) FROM leaves WHERE productId % 23 <> 0
    UNION ALL SELECT productId, 4, 'PriceBand', CAST(CAST(floor(p_retailprice / 100) AS BIGINT) AS VARCHAR) FROM leaves WHERE productId % 23 <> 0),
parameter AS (SELECT DISTINCT parameterId, parameterName, value FROM held),
has_parameter AS (SELECT productId, parameterId, value FROM held),
segment AS (SELECT CAST(r_regionkey AS BIGINT) AS segmentId, r_name AS segmentName FROM region),
in_segment AS (SELECT categoryId, CAST(CASE {_SEGMENT_OF} END AS BIGINT) AS segmentId FROM category WHERE categoryId < 1000),
branded AS (SELECT m.productId, b.brandId, b.name AS brandName FROM made_by m JOIN brand b USING (brandId)),
product_rows AS (
    SELECT p.productId, p.productName, p.productDescription, b.brandId, b.brandName, p.categoryId
    FROM product p LEFT JOIN branded b ON b.productId = p.productId),
roots AS (SELECT categoryId, categoryName FROM category WHERE categoryId NOT IN (SELECT childId FROM child_of)),
flat AS (
    SELECT c.categoryId, c.categoryName, e.parentId AS parentCategoryId, s.segmentId, s.segmentName
    FROM category c LEFT JOIN child_of e ON e.childId = c.categoryId
    LEFT JOIN in_segment i ON i.categoryId = c.categoryId LEFT JOIN segment s ON s.segmentId = i.segmentId),
nodes AS (
    SELECT 'product:' || productId AS node_key FROM product
    UNION ALL SELECT 'category:' || categoryId FROM category
    UNION ALL SELECT 'segment:' || segmentId FROM segment
    UNION ALL SELECT 'parameter:' || parameterId || ':' || value FROM parameter),
directed AS (
    SELECT 'product:' || productId AS a, 'category:' || categoryId AS b FROM belongs_to
    UNION ALL SELECT 'category:' || childId, 'category:' || parentId FROM child_of
    UNION ALL SELECT 'category:' || categoryId, 'segment:' || segmentId FROM in_segment
    UNION ALL SELECT 'product:' || productId, 'parameter:' || parameterId || ':' || value FROM has_parameter),
edges AS (SELECT a AS src, b AS dst FROM directed UNION ALL SELECT b, a FROM directed)"""

CLOSURE = """
walk AS (
    SELECT categoryId AS rootId, categoryId, CAST(0 AS BIGINT) AS depth FROM category
    UNION ALL SELECT w.rootId, e.childId, w.depth + 1 FROM walk w JOIN child_of e ON e.parentId = w.categoryId)"""


def _propagations(dimension: int, steps: int) -> str:
    """Tables h1..hn(node_key, d, v): normalised propagations of the starting vectors."""
    ctes = [
        f"""
blocks AS (
    SELECT node_key, b, md5('{SEED}:' || node_key || ':' || b) AS hex
    FROM nodes, range({-(-dimension // 8)}) t(b)),
h0 AS MATERIALIZED (
    SELECT node_key, b * 8 + i AS d,
           CASE CAST('0x' || substr(hex, CAST(i * 4 + 1 AS INT), 4) AS INT) % 6
                WHEN 0 THEN sqrt(3.0) WHEN 1 THEN -sqrt(3.0) ELSE 0.0 END AS v
    FROM blocks, range(8) t(i) WHERE b * 8 + i < {dimension})"""
    ]
    for step in range(1, steps + 1):
        ctes.append(
            f"""
m{step} AS MATERIALIZED (
    SELECT e.src AS node_key, h.d, avg(h.v) AS v FROM edges e JOIN h{step - 1} h ON h.node_key = e.dst GROUP BY 1, 2),
n{step} AS (SELECT node_key, sqrt(sum(v * v)) AS n FROM m{step} GROUP BY 1),
h{step} AS MATERIALIZED (
    SELECT m.node_key, m.d, CASE WHEN n.n > 0 THEN m.v / n.n ELSE 0.0 END AS v FROM m{step} m JOIN n{step} n USING (node_key))"""
        )
    return ",".join(ctes)


def _embedding(dimension: int, weights: tuple[float, ...]) -> str:
    terms = " UNION ALL ".join(
        f"SELECT node_key, d, {w} * v AS v FROM h{i}" for i, w in enumerate(weights, 1) if w
    )
    return _propagations(dimension, len(weights)) + f""",
embedded AS MATERIALIZED (SELECT node_key, d, sum(v) AS v FROM ({terms}) GROUP BY 1, 2)"""


def _neighbours(vectors: str, cutoff: float) -> str:
    """near(sourceId, targetId, score): brute force over vectors(id, e double[])."""
    return f"""
unit AS MATERIALIZED ({vectors}),
scored AS (
    SELECT a.id AS sourceId, b.id AS targetId, round(list_cosine_similarity(a.e, b.e), {SCORE_DECIMALS}) AS score
    FROM unit a JOIN unit b ON a.id <> b.id),
near AS MATERIALIZED (
    SELECT sourceId, targetId, score FROM scored WHERE score >= {cutoff}
    QUALIFY row_number() OVER (PARTITION BY sourceId ORDER BY score DESC, targetId) <= 20)"""


BOOST = """
shared AS (
    SELECT DISTINCT n.sourceId, n.targetId FROM near n
    JOIN made_by a ON a.productId = n.sourceId JOIN made_by b ON b.productId = n.targetId AND b.brandId = a.brandId),
similar_to AS MATERIALIZED (
    SELECT n.sourceId, n.targetId,
           CASE WHEN s.sourceId IS NULL THEN n.score ELSE n.score + 0.01 END AS score,
           CASE WHEN s.sourceId IS NULL THEN NULL ELSE TRUE END AS sameBrand
    FROM near n LEFT JOIN shared s ON s.sourceId = n.sourceId AND s.targetId = n.targetId)"""

NEAR_PRODUCTS = (
    _embedding(DIMENSION, ITERATION_WEIGHTS)
    + ","
    + _neighbours(
        "SELECT p.productId AS id, list(v ORDER BY d) AS e FROM embedded m "
        "JOIN product p ON m.node_key = 'product:' || p.productId GROUP BY 1 HAVING sum(v * v) > 0",
        0.5,
    )
)
NEAR_VECTORS = _neighbours("SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings", VECTOR_CUTOFF)

RECOMMENDED = """
served AS (
    SELECT sourceId, targetId, score, coalesce(sameBrand, FALSE) AS sameBrand,
           count(*) OVER (PARTITION BY sourceId) AS total
    FROM similar_to WHERE score >= 0.8),
recommended AS MATERIALIZED (
    SELECT s.sourceId,
           CAST(row_number() OVER (PARTITION BY s.sourceId ORDER BY s.score DESC, p.productId, p.brandId NULLS LAST) AS BIGINT) AS position,
           s.total, p.productId, p.productName, p.productDescription, p.brandId, p.brandName,
           round(s.score, 6) + 0.0 AS similarityScore, s.score AS rawScore, s.sameBrand
    FROM served s JOIN product_rows p ON p.productId = s.targetId)"""

PAGES = """
pages AS MATERIALIZED (
    SELECT p.productId, coalesce((r.position - 1) // 10 + 1, 1) AS page,
           coalesce(max(r.total), 0) AS totalCount,
           list({'productId': r.productId, 'productName': r.productName, 'productDescription': r.productDescription,
                 'brandId': r.brandId, 'brandName': r.brandName, 'similarityScore': r.rawScore, 'sameBrand': r.sameBrand}
                ORDER BY r.position) FILTER (r.position IS NOT NULL) AS items
    FROM product p LEFT JOIN recommended r ON r.sourceId = p.productId GROUP BY 1, 2),
enveloped AS (
    SELECT productId, page, totalCount, CAST(10 AS BIGINT) AS pageSize,
           CAST(ceil(totalCount / 10.0) AS BIGINT) AS totalPages, page < ceil(totalCount / 10.0) AS hasMore,
           coalesce(items, []) AS items FROM pages)"""

SERVING = f"""
seen AS (
    SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS productId, max(ts) AS at FROM events GROUP BY 1),
serving AS (
    SELECT 'recs:' || e.productId || ':' || page || ':' || pageSize AS cache_key, e.productId AS product_id,
           coalesce(s.at, TIMESTAMP '2024-01-01 00:00:00') + INTERVAL {TTL_MINUTES} MINUTE AS expires_at
    FROM enveloped e LEFT JOIN seen s USING (productId))"""

# (name, id, brand) order of the nested lists and of the search results
_BY_NAME = "ORDER BY productName NULLS LAST, productId, brandId NULLS LAST"

TREE = """
opened AS (
    SELECT c.*, '{"categoryId":' || c.categoryId || ',"categoryName":"' || c.categoryName || '","parentCategoryId":' || coalesce(CAST(c.parentCategoryId AS VARCHAR), 'null')
        || ',"catalogSegmentId":' || coalesce(CAST(c.segmentId AS VARCHAR), 'null') || ',"catalogSegmentName":' || coalesce('"' || c.segmentName || '"', 'null')
        || ',"subCategories":' AS opening FROM flat c),
tree3 AS (SELECT *, opening || 'null}' AS tree FROM opened WHERE categoryId >= 1000),
tree2 AS (
    SELECT p.*, p.opening || coalesce('[' || k.kids || ']', 'null') || '}' AS tree
    FROM opened p LEFT JOIN (
        SELECT parentCategoryId AS id, string_agg(tree, ',' ORDER BY categoryName, categoryId) AS kids FROM tree3 GROUP BY 1) k
    ON k.id = p.categoryId WHERE p.categoryId BETWEEN 100 AND 999),
tree1 AS (
    SELECT p.*, p.opening || coalesce('[' || k.kids || ']', 'null') || '}' AS tree
    FROM opened p LEFT JOIN (
        SELECT parentCategoryId AS id, string_agg(tree, ',' ORDER BY categoryName, categoryId) AS kids FROM tree2 GROUP BY 1) k
    ON k.id = p.categoryId WHERE p.categoryId < 100)"""

TERMS = """
terms AS (
    SELECT DISTINCT unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_brand, p_type]) AS term FROM part)"""

PATTERN = r"'(?i).*' || regexp_replace(t.term, '([!-/:-@\[-`{-~ ])', '\\\1', 'g') || '.*'"


def _search(terms: str, limit: int) -> str:
    """found(term, kind, position, id, name, relatedName, productCount) for terms(term)."""
    def match(name: str) -> str:
        return f"regexp_full_match({name}, {PATTERN})"

    return f"""
asked AS ({terms}),
hit_products AS (
    SELECT DISTINCT t.term, p.productId AS id, p.productName AS name, b.brandName AS relatedName
    FROM asked t JOIN product p ON {match('p.productName')} LEFT JOIN branded b ON b.productId = p.productId),
hit_categories AS (
    SELECT DISTINCT t.term, c.categoryId AS id, c.categoryName AS name, q.categoryName AS relatedName
    FROM asked t JOIN category c ON {match('c.categoryName')}
    LEFT JOIN child_of e ON e.childId = c.categoryId LEFT JOIN category q ON q.categoryId = e.parentId),
hit_brands AS (
    SELECT t.term, b.brandId AS id, b.name, count(m.productId) AS productCount
    FROM asked t JOIN brand b ON {match('b.name')} LEFT JOIN made_by m ON m.brandId = b.brandId GROUP BY 1, 2, 3),
found AS (
    SELECT term, 'product' AS kind, row_number() OVER (PARTITION BY term ORDER BY name NULLS LAST, id, relatedName NULLS LAST) AS position,
           id, name, relatedName, CAST(NULL AS BIGINT) AS productCount FROM hit_products
    UNION ALL
    SELECT term, 'category', row_number() OVER (PARTITION BY term ORDER BY name NULLS LAST, id, relatedName NULLS LAST),
           id, name, relatedName, NULL FROM hit_categories
    UNION ALL
    SELECT term, 'brand', row_number() OVER (PARTITION BY term ORDER BY productCount DESC, id), id, name, NULL, productCount FROM hit_brands),
top AS (SELECT * FROM found WHERE position <= {limit})"""


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(c.strip("\n") for c in ctes) + "\n"


_PARAMETERS = (
    "coalesce(string_agg(concat_ws('=', h.parameterName, CAST(h.parameterId AS VARCHAR), h.value), ';' "
    "ORDER BY h.parameterName, h.parameterId, h.value), '')"
)


def statements() -> dict[str, str]:
    g = _with(GRAPH)
    closure = _with(GRAPH, CLOSURE, recursive=True)
    similar = _with(GRAPH, NEAR_PRODUCTS, BOOST)
    recommended = _with(GRAPH, NEAR_PRODUCTS, BOOST, RECOMMENDED)
    paged = _with(GRAPH, NEAR_PRODUCTS, BOOST, RECOMMENDED, PAGES)
    served = _with(GRAPH, NEAR_PRODUCTS, BOOST, RECOMMENDED, PAGES, SERVING)
    edge_columns = "sourceId, targetId, round(score, 6) + 0.0 AS score"
    ends = [
        ("made_by", "product", "productId", "productId"), ("made_by", "brand", "brandId", "brandId"),
        ("belongs_to", "product", "productId", "productId"), ("belongs_to", "category", "categoryId", "categoryId"),
        ("has_parameter", "product", "productId", "productId"),
        ("has_parameter", "parameter", "(parameterId, value)", "(parameterId, value)"),
        ("child_of", "category", "childId", "categoryId"), ("child_of", "category", "parentId", "categoryId"),
        ("in_segment", "category", "categoryId", "categoryId"), ("in_segment", "segment", "segmentId", "segmentId"),
    ]
    keys = [("product", "productId"), ("brand", "brandId"), ("category", "categoryId"),
            ("parameter", "(parameterId, value)"), ("segment", "segmentId")]
    product_detail = f"""
        SELECT p.productId, p.productName, p.productDescription, b.brandId, b.brandName, p.categoryId, {_PARAMETERS} AS parameters
        FROM product p LEFT JOIN branded b ON b.productId = p.productId LEFT JOIN held h ON h.productId = p.productId"""
    related = """
        SELECT DISTINCT a.productId AS sourceId, r.* FROM belongs_to a JOIN belongs_to o ON o.categoryId = a.categoryId AND o.productId <> a.productId
        JOIN product_rows r ON r.productId = o.productId"""
    recent_sql = g + """
        , last AS (
            SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS productId, max(ts) AS viewed_at
            FROM events WHERE event_type = 'view' GROUP BY 1, 2),
        kept AS (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY viewed_at DESC, productId) AS position FROM last
            QUALIFY position <= 6)
        SELECT k.user_id, k.position, p.productId, p.productName, p.brandName, p.categoryId, p.brandId, epoch_us(k.viewed_at) // 1000 AS viewedAt
        FROM kept k JOIN product_rows p ON p.productId = k.productId"""
    distribution = similar + """
        SELECT count(*) AS relationshipsWritten, count(DISTINCT sourceId) AS sources, round(min(score), 6) AS minScore,
               round(max(score), 6) AS maxScore, round(avg(score), 6) AS meanScore, round(stddev_pop(score), 6) AS stdDev,
               round(quantile_cont(round(score, 6), 0.5), 6) AS p50, round(quantile_cont(round(score, 6), 0.9), 6) AS p90, round(quantile_cont(round(score, 6), 0.99), 6) AS p99
        FROM similar_to"""
    return {
        # scans, projection, checks
        "scan_products": g + "SELECT * FROM product",
        "scan_edges": g + """
            SELECT 'made_by' AS edge, productId AS fromId, CAST(brandId AS VARCHAR) AS toKey FROM made_by
            UNION ALL SELECT 'belongs_to', productId, CAST(categoryId AS VARCHAR) FROM belongs_to
            UNION ALL SELECT 'has_parameter', productId, parameterId || '|' || value FROM has_parameter
            UNION ALL SELECT 'child_of', childId, CAST(parentId AS VARCHAR) FROM child_of
            UNION ALL SELECT 'in_segment', categoryId, CAST(segmentId AS VARCHAR) FROM in_segment""",
        "graph_projection": g + """
            SELECT 'node' AS kind, node_key AS src, CAST(NULL AS VARCHAR) AS dst FROM nodes
            UNION ALL SELECT 'edge', src, dst FROM edges""",
        "projection_stats": g + """
            SELECT 'nodeCount' AS measure, count(*) AS value FROM nodes
            UNION ALL SELECT 'relationshipCount', count(*) FROM edges""",
        "dq_unique_keys": g + " UNION ALL ".join(
            f"SELECT '{n}' AS node, count(*) AS distinct_keys, CAST(coalesce(sum(CAST(c > 1 AS INT)), 0) AS BIGINT) AS duplicated_keys "
            f"FROM (SELECT count(*) AS c FROM {n} GROUP BY {k})"
            for n, k in keys
        ),
        "dq_dangling_edges": g + " UNION ALL ".join(
            f"SELECT '{e}' AS edge, '{n}' AS node, count(*) AS ends, CAST(coalesce(sum(CAST(k NOT IN (SELECT {nk} FROM {n}) AS INT)), 0) AS BIGINT) AS dangling "
            f"FROM (SELECT DISTINCT {ek} AS k FROM {e})"
            for e, n, ek, nk in ends
        ),
        # listings
        "segments_page": g + """
            SELECT segmentId, segmentName, (SELECT count(*) FROM segment) AS totalCount, CAST(1 AS BIGINT) AS totalPages, FALSE AS hasMore
            FROM segment ORDER BY segmentName, segmentId LIMIT 20""",
        "product_by_id": g + product_detail + f" WHERE p.productId = {PRODUCT} GROUP BY 1, 2, 3, 4, 5, 6",
        "product_detail": g + product_detail + " GROUP BY 1, 2, 3, 4, 5, 6",
        "product_with_brand": g + "SELECT * FROM product_rows",
        "products_by_category": g + "SELECT b.categoryId AS listedCategoryId, r.* FROM belongs_to b JOIN product_rows r USING (productId)",
        "products_by_category_page": g + f"""
            SELECT r.productId, r.productName, r.productDescription, r.brandId, r.brandName, r.categoryId,
                   (SELECT count(*) FROM belongs_to WHERE categoryId = {CATEGORY // 100}) AS totalCount,
                   (SELECT count(*) > 20 FROM belongs_to WHERE categoryId = {CATEGORY // 100}) AS hasMore
            FROM belongs_to b JOIN product_rows r ON r.productId = b.productId WHERE b.categoryId = {CATEGORY // 100}
            ORDER BY r.productName NULLS LAST, r.productId, r.brandId NULLS LAST LIMIT 10 OFFSET 10""",
        "category_product_pages": g + """
            , placed AS (
                SELECT b.categoryId AS listedCategoryId, r.*,
                       row_number() OVER (PARTITION BY b.categoryId ORDER BY r.productName NULLS LAST, r.productId, r.brandId NULLS LAST) AS position
                FROM belongs_to b JOIN product_rows r USING (productId))
            SELECT p.*, t.total, (position - 1) // 20 + 1 AS page, CAST(ceil(t.total / 20.0) AS BIGINT) AS totalPages,
                   (position - 1) // 20 + 1 < ceil(t.total / 20.0) AS hasMore
            FROM placed p JOIN (SELECT categoryId, count(*) AS total FROM belongs_to GROUP BY 1) t ON t.categoryId = p.listedCategoryId""",
        "related_products": g + f"""
            , related AS ({related})
            SELECT * EXCLUDE (sourceId), (SELECT count(DISTINCT productId) FROM related WHERE sourceId = {PRODUCT}) AS totalCount
            FROM related WHERE sourceId = {PRODUCT} {_BY_NAME} LIMIT 20""",
        "related_totals": g + """
            SELECT p.productId, count(DISTINCT o.productId) AS total FROM product p
            LEFT JOIN belongs_to a ON a.productId = p.productId
            LEFT JOIN belongs_to o ON o.categoryId = a.categoryId AND o.productId <> p.productId GROUP BY 1""",
        "related_pages": g + f"""
            , related AS ({related})
            SELECT sourceId, row_number() OVER (PARTITION BY sourceId {_BY_NAME}) AS position, * EXCLUDE (sourceId)
            FROM related QUALIFY position <= 20""",
        "brand_product_counts": g + """
            SELECT b.brandId, b.name AS brandName, count(m.productId) AS productCount
            FROM brand b LEFT JOIN made_by m ON m.brandId = b.brandId GROUP BY 1, 2""",
        "list_totals": similar + """
            SELECT 'segments' AS list, CAST(NULL AS BIGINT) AS key, count(*) AS total FROM segment
            UNION ALL SELECT 'roots', NULL, count(*) FROM roots
            UNION ALL SELECT 'categoryProducts', categoryId, count(*) FROM belongs_to GROUP BY 2
            UNION ALL SELECT 'segmentRoots', i.segmentId, count(*) FROM in_segment i JOIN roots r USING (categoryId) GROUP BY 2
            UNION ALL SELECT 'recommendations', sourceId, count(*) FROM similar_to WHERE score >= 0.8 GROUP BY 2""",
        # category trees
        "category_roots": g + "SELECT * FROM roots",
        "category_roots_page": g + "SELECT * FROM roots ORDER BY categoryName, categoryId LIMIT 3 OFFSET 3",
        "category_closure": closure + "SELECT rootId, categoryId, min(depth) AS depth FROM walk GROUP BY 1, 2",
        "category_flat": g + "SELECT * FROM flat",
        "category_flat_tree": closure + """
            SELECT w.rootId, w.depth, f.* FROM walk w JOIN flat f USING (categoryId) WHERE w.rootId IN (SELECT categoryId FROM roots)""",
        "category_tree": _with(GRAPH, TREE) + "SELECT categoryId, categoryName, tree FROM tree1",
        "category_subtree": _with(GRAPH, TREE) + f"SELECT categoryId, categoryName, tree FROM tree2 WHERE categoryId = {CATEGORY}",
        "segment_category_tree": _with(GRAPH, TREE) + f"SELECT categoryId, categoryName, tree FROM tree1 WHERE segmentId = {SEGMENT}",
        "segment_trees_all": _with(GRAPH, TREE)
        + "SELECT i.segmentId, t.categoryId, t.categoryName, t.tree FROM tree1 t JOIN in_segment i USING (categoryId) JOIN segment s ON s.segmentId = i.segmentId",
        "segment_tree_intervals": _with(GRAPH, CLOSURE, recursive=True) + """
            , step AS (
                SELECT r.categoryId AS rootId, r.categoryId, CAST(0 AS BIGINT) AS depth, CAST([] AS VARCHAR[]) AS path FROM roots r
                UNION ALL SELECT s.rootId, f.categoryId, s.depth + 1, list_concat(s.path, [f.categoryName, lpad(CAST(f.categoryId AS VARCHAR), 20, '0')])
                FROM step s JOIN flat f ON f.parentCategoryId = s.categoryId),
            numbered AS (SELECT *, row_number() OVER (PARTITION BY rootId ORDER BY path) AS "left" FROM step),
            sized AS (SELECT rootId AS id, count(*) AS n FROM walk GROUP BY 1)
            SELECT i.segmentId AS treeSegmentId, n.rootId, n."left", n."left" + z.n - 1 AS "right", n.depth, f.*
            FROM numbered n JOIN flat f USING (categoryId) JOIN sized z ON z.id = n.categoryId
            JOIN in_segment i ON i.categoryId = n.rootId JOIN segment s ON s.segmentId = i.segmentId""",
        "category_child_counts": g + """
            SELECT c.categoryId, c.categoryName, count(e.childId) AS children
            FROM category c LEFT JOIN child_of e ON e.parentId = c.categoryId GROUP BY 1, 2""",
        # search
        "search_term_guard": """
            WITH raw AS (SELECT DISTINCT unnest([p_name, substr(p_name, 1, 1), ' ' || substr(p_name, 1, 1), '', '   ', NULL]) AS term FROM part)
            SELECT term, coalesce(trim(term) <> '' AND length(term) >= 2, FALSE) AS searched FROM raw""",
        "search_products": _with(GRAPH, _search(f"SELECT '{TERM}' AS term", 5)) + "SELECT id, name, relatedName FROM hit_products",
        "search_brands": _with(GRAPH, _search("SELECT 'brand#2' AS term", 5))
        + "SELECT id, name, productCount FROM top WHERE kind = 'brand'",
        "global_search": _with(GRAPH, _search(f"SELECT '{TERM}' AS term", 15)) + "SELECT * EXCLUDE (term) FROM top",
        "search_bulk": _with(GRAPH, TERMS, _search("SELECT term FROM terms WHERE length(term) >= 2", 5)) + "SELECT * FROM top",
        # embeddings, neighbours, similarity build
        "fastrp_step": _with(GRAPH, _propagations(DIMENSION, 1))
        + "SELECT z.node_key, CAST(z.d AS BIGINT) AS dim, round(coalesce(h.v, 0.0), 6) + 0.0 AS value FROM h0 z LEFT JOIN h1 h ON h.node_key = z.node_key AND h.d = z.d",
        "fastrp_embedding": _with(GRAPH, _embedding(DIMENSION, ITERATION_WEIGHTS))
        + "SELECT z.node_key, CAST(z.d AS BIGINT) AS dim, round(coalesce(h.v, 0.0), 6) + 0.0 AS value FROM h0 z LEFT JOIN embedded h ON h.node_key = z.node_key AND h.d = z.d",
        "knn_topk": _with(NEAR_VECTORS) + f"SELECT {edge_columns} FROM near",
        "knn_filtered": _with(GRAPH, NEAR_PRODUCTS) + f"SELECT {edge_columns} FROM near",
        "neighbour_recall": _with(GRAPH, NEAR_PRODUCTS)
        + "SELECT count(DISTINCT sourceId) AS sources, count(*) AS exactEdges, TRUE AS reached FROM near WHERE sourceId % 50 = 0",
        "same_brand_pairs": _with(GRAPH, NEAR_PRODUCTS, BOOST) + "SELECT * FROM shared",
        "brand_boost": similar + f"SELECT {edge_columns}, sameBrand FROM similar_to",
        "similar_to_build": similar + f"SELECT {edge_columns}, sameBrand FROM similar_to",
        "write_similar_to": similar + f"SELECT {edge_columns}, sameBrand FROM similar_to",
        "similarity_distribution": distribution,
        "build_summary": similar + """
            SELECT (SELECT count(*) FROM nodes) AS nodePropertiesWritten, (SELECT count(*) FROM product) AS nodesCompared, count(*) AS relationshipsWritten,
                   round(min(score), 6) + 0.0 AS minScore, round(max(score), 6) + 0.0 AS maxScore, round(avg(score), 6) + 0.0 AS meanScore FROM similar_to""",
        "cleared_graph": g + " UNION ALL ".join(
            f"SELECT '{n}' AS \"table\", count(*) AS rowsBefore, CAST(0 AS BIGINT) AS rowsAfter FROM {n}"
            for n in ("product", "brand", "category", "parameter", "segment", "made_by", "belongs_to", "has_parameter", "child_of", "in_segment")
        ),
        "similarity_count": similar + "SELECT count(*) AS totalSimilarities FROM similar_to",
        "similarity_top10": similar + f"""
            SELECT s.targetId, p.productName, round(s.score, 6) + 0.0 AS score, s.sameBrand
            FROM similar_to s JOIN product p ON p.productId = s.targetId WHERE s.sourceId = {PRODUCT}
            ORDER BY s.score DESC, s.targetId LIMIT 10""",
        # suggestions
        "recommendations": recommended + "SELECT * EXCLUDE (rawScore) FROM recommended",
        "recommendations_page": recommended + f"""
            SELECT * EXCLUDE (rawScore, sourceId, position, total), total AS totalCount, total > 10 AS hasMore
            FROM recommended WHERE sourceId = {PRODUCT} AND position <= 10""",
        "recommendations_other_brand": recommended + "SELECT * EXCLUDE (rawScore) FROM recommended WHERE position <= 50 AND NOT sameBrand",
        "recommendation_pages": paged
        + "SELECT * EXCLUDE (items), array_to_string(list_transform(items, lambda i: CAST(i.productId AS VARCHAR)), ',') AS items FROM enveloped",
        "page_payload_json": paged + """
            SELECT 'recs:' || productId || ':' || page || ':' || pageSize AS cache_key,
                   CAST(to_json({'similarProducts': {'items': items, 'totalCount': totalCount, 'page': page, 'pageSize': pageSize,
                                                'totalPages': totalPages, 'hasMore': hasMore}}) AS VARCHAR) AS payload FROM enveloped""",
        "page_payload_read": paged + """
            SELECT 'recs:' || productId || ':' || page || ':' || pageSize AS cache_key, totalCount, i.productId AS productId, i.brandName AS brandName,
                   round(i.similarityScore, 6) + 0.0 AS similarityScore, i.sameBrand AS sameBrand
            FROM (SELECT * EXCLUDE (items), unnest(items) AS i FROM enveloped)""",
        "page_cache_lookup": served + """
            SELECT a.cache_key, s.cache_key IS NOT NULL AS hit
            FROM (SELECT DISTINCT 'recs:' || json_extract_string(props, '$.k') || ':1:10' AS cache_key FROM events) a
            LEFT JOIN serving s ON s.cache_key = a.cache_key AND s.expires_at > (SELECT max(ts) FROM events)""",
        "page_read_through": served + """
            SELECT a.cache_key, s.cache_key IS NOT NULL AS hit, s.cache_key IS NULL AND e.productId IS NOT NULL AS refilled,
                   e.productId IS NOT NULL AS hitAfter, e.totalCount
            FROM (SELECT DISTINCT 'recs:' || json_extract_string(props, '$.k') || ':1:10' AS cache_key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) a
            LEFT JOIN serving s ON s.cache_key = a.cache_key AND s.expires_at > (SELECT max(ts) FROM events)
            LEFT JOIN enveloped e ON e.productId = a.k AND e.page = 1""",
        "page_cache_clear_prefix": served + "SELECT cache_key, product_id FROM serving WHERE NOT starts_with(cache_key, 'recs:1')",
        "page_cache_invalidate": served + """
            SELECT cache_key, product_id FROM serving WHERE product_id NOT IN (
                SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'purchase')""",
        # recently viewed
        "recent_items": recent_sql,
        "recent_items_stream": recent_sql,
        # pages and scalar functions
        "page_normalize": """
            WITH raw AS (
                SELECT event_id, CAST(floor(value) AS BIGINT) - 3 AS page, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 - 20 AS size FROM events)
            SELECT event_id, CASE WHEN page > 0 THEN page ELSE 1 END AS page,
                   CASE WHEN size > 0 THEN least(size, 100) ELSE 20 END AS pageSize,
                   CASE WHEN size > 0 THEN least(size, 100) ELSE 15 END AS pageSizeDefault15 FROM raw""",
        "page_envelope": """
            WITH u AS (SELECT user_id, count(*) AS totalCount, count(DISTINCT event_type) AS page FROM events GROUP BY 1)
            SELECT user_id, totalCount, page, CAST(ceil(totalCount / 20.0) AS BIGINT) AS totalPages, page < ceil(totalCount / 20.0) AS hasMore FROM u""",
        "scalar_suite": g + r"""
            SELECT productId, coalesce(productDescription, 'none') AS coalesced, productId / 7.0::DOUBLE + 0.01 AS added, productName AS field,
                   split_part(productName, ' ', 1) AS sliced,
                   regexp_replace(productName || '.*+(x)', '([!-/:-@\[-`{-~ ])', '\\\1', 'g') AS escaped,
                   'recs:' || productId || ':1:20' AS servingKey, replace(productName, ' ', '; ') AS joined,
                   length(trim(productName)) > 0 AS notBlank, CAST(ceil(productId / 3.0) AS BIGINT) AS ceiling, least(brandId, 10) AS smaller,
                   CAST(productId AS VARCHAR) AS asText, CASE WHEN brandId > 12 THEN brandId ELSE 5 END AS defaulted,
                   epoch_us(TIMESTAMP '2024-01-01 00:00:00') // 1000000 + (productId + 30) * 60 AS expires,
                   starts_with('recs:' || productId || ':1:20', 'recs:12:') AS keyed,
                   printf('%.4f', round(productId / 7.0::DOUBLE, 4)) AS shown
            FROM product""",
        "vector_suite": """
            WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
            f AS (SELECT label, arg_min(e, vec_id) AS e FROM v GROUP BY 1)
            SELECT v.vec_id, round(sqrt(list_dot_product(v.e, v.e)), 6) + 0.0 AS norm, round(list_cosine_similarity(v.e, f.e), 6) + 0.0 AS cosine
            FROM v JOIN f USING (label)""",
    }
