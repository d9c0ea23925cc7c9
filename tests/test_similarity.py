import dataclasses
import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfgraph.operators import embedding, neighbours, refine
from shelfgraph.operators.projection import project_graph, projection_stats
from shelfgraph.operators.ranking import sliced_positions
from shelfgraph.operators.skew import split_join
from shelfgraph.plans import similarity, suggest
from shelfgraph.session import checkpoint_root, released, stage
from shelfgraph.sources.tables import read_similar_to

# ---- balanced primitives ------------------------------------------------------------------------


def test_sliced_positions_equal_a_window_on_a_hot_key(spark):
    rows = [(1 if i % 3 else i % 7, f"n{i % 11}" if i % 10 else None, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, name string, id long")
    order = [F.asc_nulls_last("name"), F.asc("id")]
    got = {(r.k, r.id): (r.position, r.total) for r in sliced_positions(df, ["k"], order, 7).collect()}
    want, groups = {}, {}
    for k, name, i in rows:
        groups.setdefault(k, []).append((name is None, name or "", i))
    for k, members in groups.items():
        for place, (_, _, i) in enumerate(sorted(members), 1):
            want[(k, i)] = (place, len(members))
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_join(spark, how):
    left = spark.createDataFrame([(i % 5, i) for i in range(100)] + [(9, 1)], "k long, v long")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k long, t string")
    hot = spark.createDataFrame([(0,), (2,)], "k long")
    plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    assert sorted(map(tuple, split_join(left, right, "k", hot, how).collect()), key=str) == plain


# ---- embedding ----------------------------------------------------------------------------------


def start(key, dimension, seed=42):
    out = []
    for block in range(-(-dimension // 8)):
        digest = hashlib.md5(f"{seed}:{key}:{block}".encode()).digest()
        for i in range(0, 16, 2):
            digit = int.from_bytes(digest[i : i + 2], "big") % 6
            out.append({0: 3**0.5, 1: -(3**0.5)}.get(digit, 0.0))
    return np.array(out[:dimension])


def test_start_digests_are_md5_of_any_key():
    keys = ["", "a", "product:7", "parameter:4:9", "é:ü", "x" * 38, "x" * 45, "x" * 200, "nul\0", "\0"] + [f"category:{i}" for i in range(700)]
    for blocks, seed in ((1, 42), (12, 7), (130, 123456)):
        got = embedding.start_digests(keys, blocks, seed)
        assert got.shape == (len(keys), blocks, 16)
        assert all(got[i, b].tobytes() == hashlib.md5(f"{seed}:{k}:{b}".encode()).digest() for i, k in enumerate(keys) for b in range(blocks))


def test_starting_sums_call_no_hash_function_per_key(spark, monkeypatch):
    """The starting vectors of a batch are computed side by side; only long keys are hashed one by one."""
    calls = []
    monkeypatch.setattr(hashlib, "md5", lambda data, real=hashlib.md5: calls.append(data) or real(data))
    embedding.start_digests([f"product:{i}" for i in range(500)], 32, 42)
    assert not calls


def brute_fastrp(nodes, edges, dimension, weights, self_influence=0.0):
    vector = {n: start(n, dimension) for n in nodes}
    total = {n: np.zeros(dimension) for n in nodes}
    for n in nodes:
        norm = np.linalg.norm(vector[n])
        total[n] = total[n] + (self_influence * vector[n] / norm if norm else 0)
    for weight in weights:
        following = {}
        for n in nodes:
            around = [vector[d] for s, d in edges if s == n]
            mean = np.mean(around, axis=0) if around else np.zeros(dimension)
            norm = np.linalg.norm(mean)
            following[n] = mean / norm if norm else mean
            total[n] = total[n] + weight * following[n]
        vector = following
    return total


@pytest.fixture(scope="module")
def small_graph(spark):
    # p0..p5 are twins around two hubs; p6 differs; one edge is parallel; "alone" has no edge.
    pairs = [(f"p{i}", h) for i in range(6) for h in ("h1", "h2")]
    pairs += [("p6", "h1"), ("p6", "h1"), ("p6", "h3"), ("p7", "h3"), ("h3", "top"), ("h1", "top")]
    edges = pairs + [(b, a) for a, b in pairs]
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    return (
        nodes, edges,
        spark.createDataFrame([(n,) for n in nodes], "node_key string"),
        spark.createDataFrame(edges, "src string, dst string"),
    )


@pytest.mark.parametrize("weights, own", [((0.0, 1.0, 1.0, 1.0, 1.0), 0.0), ((1.0,), 0.0), ((0.5, 0.0, 2.0), 0.7)])
def test_fastrp_against_brute_force(small_graph, weights, own):
    nodes, edges, node_df, edge_df = small_graph
    got = {r.node_key: np.array(r.embedding) for r in embedding.fastrp(node_df, edge_df, 20, weights, own).collect()}
    want = brute_fastrp(nodes, edges, 20, weights, own)
    assert set(got) == set(want)
    for node in nodes:
        np.testing.assert_allclose(got[node], want[node], atol=1e-12)


def test_fastrp_does_not_depend_on_partitioning(small_graph):
    _, _, node_df, edge_df = small_graph
    one = {r.node_key: r.embedding for r in embedding.fastrp(node_df, edge_df.coalesce(1), 16).collect()}
    many = {r.node_key: r.embedding for r in embedding.fastrp(node_df, edge_df.repartition(13), 16).collect()}
    for key in one:
        np.testing.assert_allclose(one[key], many[key], atol=1e-12)


def test_nodes_with_equal_neighbours_share_a_class(small_graph):
    classes = {r.node_key: r.cls for r in embedding.neighbourhood_classes(small_graph[3]).collect()}
    assert len({classes[f"p{i}"] for i in range(6)}) == 1
    assert classes["p6"] != classes["p7"] and "alone" not in classes


def test_projection_leaves_brands_out_and_keeps_both_directions(micro):
    nodes, edges = project_graph(micro)
    assert {r.label for r in nodes.select("label").distinct().collect()} == {"product", "category", "segment", "parameter"}
    pairs = sorted(tuple(r) for r in edges.collect())
    assert pairs == sorted((b, a) for a, b in pairs)
    stats = {r.measure: r.value for r in projection_stats(nodes, edges).collect()}
    assert stats == {"nodeCount": 9 + 11 + 2 + 3, "relationshipCount": 2 * (8 + 9 + 5 + 4)}


# ---- neighbours ---------------------------------------------------------------------------------


def brute_knn(ids, x, k, cutoff, unit=False):
    norm = np.linalg.norm(x, axis=1)
    live = [i for i in range(len(ids)) if norm[i] > 0]
    out = set()
    for i in live:
        score = [(-np.round(((x[i] @ x[j]) / norm[i] / norm[j] + unit) / (1 + unit), neighbours.SCORE_DECIMALS), ids[j], j) for j in live if j != i]
        out |= {(ids[i], t, float(-s)) for s, t, _ in sorted(score)[:k] if -s >= cutoff}
    return out


def vectors_with_copies(seed, n=400, d=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, d))
    x = centre[rng.integers(0, 6, n)] + 0.35 * rng.normal(size=(n, d))
    x[: n // 3] = x[0]  # a third are copies of one vector
    x[n // 3 : n // 3 + 5] = 0.0
    x[-20:] = x[-1]
    return rng.permutation(n * 3)[:n], x


@pytest.mark.parametrize("seed, k, cutoff, cell, unit", [(1, 20, 0.5, 1024, False), (2, 5, 0.2, 16, False), (3, 7, -1.0, 10, False), (4, 3, 0.9, 30, True)])
def test_knn_is_exact_with_copies_and_cells(spark, monkeypatch, seed, k, cutoff, cell, unit):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 25)  # many blocks per cell
    ids, x = vectors_with_copies(seed)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, embedding array<double>")
    got = neighbours.knn(df, k, cutoff, "unit" if unit else "raw", cell_rows=cell).collect()
    assert len(got) == len({(r.sourceId, r.targetId) for r in got})
    assert {tuple(r) for r in got} == brute_knn([int(i) for i in ids], x, k, cutoff, unit)


def test_bound_and_block_forms_agree(spark, monkeypatch):
    """Well separated clusters use the bound, shapeless vectors the block grid; both equal brute force."""
    rng = np.random.default_rng(7)
    spread = rng.normal(size=(300, 40))
    packed = np.repeat(np.eye(6, 40), 50, axis=0) + 0.02 * rng.normal(size=(300, 40))
    used = []
    monkeypatch.setattr(neighbours, "_compare", lambda q, *a, real=neighbours._compare: used.append(q.count()) or real(q, *a))
    for x in (spread, packed):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
        got = {tuple(r) for r in neighbours.nearest_groups(df, 4, 0.0, cell_rows=25).collect()}
        assert got == brute_knn(list(range(300)), x, 4, 0.0)
    assert used[1] == 300  # grid over everything
    assert used[3] < 300 * 3  # few visits after the bound


@pytest.mark.parametrize("unit", [False, True])
def test_blocks_of_all_vectors_meet_without_copies_in_the_shuffle(spark, monkeypatch, unit):
    """Many small blocks in several partitions of either side, bars included: brute force, and no row is multiplied before an exchange."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "SIDE_BYTES", 50 * 12 * 8)
    monkeypatch.setattr(neighbours, "MAX_ASKING", 5)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(230, 12)).round(1)
    x[40:60] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    scale = "unit" if unit else "raw"
    asked = spark.createDataFrame([(i,) for i in range(0, 230, 3)] + [(9999,)], "id long")
    got = neighbours.nearest_of(df, asked, 6, 0.1, scale=scale)
    assert {tuple(r) for r in got.collect()} == {r for r in brute_knn(list(range(230)), x, 6, 0.1, unit) if r[0] % 3 == 0}
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert {tuple(r) for r in neighbours.nearest_groups(df, 6, 0.1, scale=scale, cell_rows=20).collect()} == brute_knn(list(range(230)), x, 6, 0.1, unit)
    assert neighbours.nearest_of(df, asked.where("id > 9000"), 6, 0.1).count() == 0


def test_probed_cells_recall(spark, micro):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 24))[rng.integers(0, 20, 1500)] + 0.5 * rng.normal(size=(1500, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    exact = brute_knn(list(range(1500)), x, 10, 0.5)
    found = {tuple(r) for r in neighbours.nearest_groups(df, 10, 0.5, cell_rows=50, probes=8).collect()}
    assert len(found & exact) >= 0.95 * len(exact)


def groups_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def test_refined_graph_is_exact_while_all_vectors_share_a_bucket(spark):
    ids, x = vectors_with_copies(5, 150)
    x = x[5 + 150 // 3 :]
    got = [tuple(r) for r in refine.refined_groups(groups_of(spark, x), 6, 0.1, cell_rows=100).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_knn(list(range(len(x))), x, 6, 0.1)


@pytest.mark.parametrize("spread", [0.5, 3.0])
def test_refinement_recalls_across_many_cells_and_buckets(spark, monkeypatch, spread):
    """Clustered and shapeless vectors in small cells: rounds lift the start lists to nearly all exact neighbours."""
    monkeypatch.setattr(refine, "PIVOT_ROWS", 16)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 1500)] + spread * rng.normal(size=(1500, 16))
    exact = brute_knn(list(range(1500)), x, 10, 0.3)
    share = {}
    for rounds in (0, 100):
        found = [tuple(r) for r in refine.refined_groups(groups_of(spark, x), 10, 0.3, cell_rows=40, max_rounds=rounds, bucket_rows=50).collect()]
        assert len({f[:2] for f in found}) == len(found) and max(np.bincount([f[0] for f in found])) <= 10
        share[rounds] = len(set(found) & exact) / len(exact)
    assert share[0] < 0.8 < 0.9 <= share[100]


def test_refined_scores_and_ties_follow_the_exact_form(spark):
    x = np.repeat(np.eye(4), 3, axis=0) + np.arange(12)[:, None] * 1e-13  # equal to nine decimals
    got = {tuple(r) for r in refine.refined_groups(groups_of(spark, x), 2, 0.5, scale="unit").collect()}
    assert got == brute_knn(list(range(12)), x, 2, 0.5, True)


def test_refining_nothing(spark):
    assert refine.refined_groups(groups_of(spark, np.zeros((2, 3)))).collect() == []


def test_recall_counts_what_is_missing(spark, micro):
    edges = similarity.neighbour_edges(micro, k=3, dimension=32)
    [whole] = similarity.neighbour_recall(micro, edges, every=2, k=3, dimension=32).collect()
    mine = [r for r in edges.collect() if r.sourceId % 2 == 0]
    assert (whole.exactEdges, whole.recall, whole.sources) == (len(mine), 1.0, len({r.sourceId for r in mine}))
    fewer = edges.where(~((F.col("sourceId") == mine[0].sourceId) & (F.col("targetId") == mine[0].targetId)))
    [part] = similarity.neighbour_recall(micro, fewer, every=2, k=3, dimension=32).collect()
    assert part.recall == pytest.approx(1 - 1 / len(mine))


def test_knn_of_nothing(spark):
    empty = spark.createDataFrame([(1, [0.0, 0.0])], "id long, embedding array<double>")
    assert neighbours.knn(empty).collect() == []


# ---- bonus and serving threshold ----------------------------------------------------------------

EDGE = "sourceId long, targetId long, score double"


def test_bonus_is_added_once_and_flag_stays_null_otherwise(spark, micro):
    raw = spark.createDataFrame([(1, 2, 0.999), (1, 4, 0.7), (4, 9, 0.6), (2, 1, 0.5)], EDGE)
    got = {(r.sourceId, r.targetId): (round(r.score, 9), r.sameBrand) for r in similarity.brand_boost(raw, micro.made_by).collect()}
    assert got == {(1, 2): (1.009, True), (1, 4): (0.71, True), (4, 9): (0.6, None), (2, 1): (0.51, True)}


def test_threshold_applies_after_the_bonus(spark, micro):
    raw = spark.createDataFrame([(1, 2, 0.79), (1, 9, 0.79), (2, 9, 0.80), (4, 5, 0.789)], EDGE)
    edges = similarity.brand_boost(raw, micro.made_by)
    served = {(r.sourceId, r.targetId) for r in suggest.served_edges(edges).collect()}
    assert served == {(1, 2), (2, 9)}


def test_suggestions_follow_out_edges_and_count_edges(spark, micro):
    raw = spark.createDataFrame([(4, 1, 0.95), (4, 2, 0.95), (4, 9, 0.85), (1, 9, 0.9)], EDGE)
    edges = similarity.brand_boost(raw, micro.made_by)
    page = suggest.recommendations(micro, edges, 4, 1, 3)
    rows = [(r.productId, r.brandId, r.sameBrand) for r in page.items.collect()]
    assert rows == [(1, 1, True), (1, 2, True), (2, 1, True)]
    assert page.total_count == 3 and not page.has_more
    assert suggest.recommendations(micro, edges, 9).items.collect() == []
    bulk = [r for r in suggest.all_recommendations(micro, edges).collect() if r.sourceId == 4]
    assert sorted((r.position, r.productId, r.total) for r in bulk) == [(1, 1, 3), (2, 1, 3), (3, 2, 3), (4, 2, 3), (5, 9, 3)]
    assert {r.productId for r in suggest.other_brand(suggest.all_recommendations(micro, edges)).collect()} == {9}


def test_build_equals_brute_force_over_the_whole_graph(spark, micro):
    nodes, edges = project_graph(micro)
    keys = [r.node_key for r in nodes.collect()]
    vector = brute_fastrp(keys, [tuple(r) for r in edges.collect()], 32, embedding.ITERATION_WEIGHTS)
    ids = [r.productId for r in micro.product.collect()]
    x = np.array([vector[f"product:{i}"] for i in ids])
    want = brute_knn(ids, x, 3, 0.5)
    got = {tuple(r) for r in similarity.neighbour_edges(micro, k=3, dimension=32).collect()}
    assert got == want and got
    built = similarity.build_similar_to(micro, k=3, dimension=32)
    assert built.columns == ["sourceId", "targetId", "score", "sameBrand"] and built.count() == len(want)


def test_the_written_build_reports_its_run_and_leaves_nothing_staged(spark, micro, tmp_path):
    staged = f"{checkpoint_root(spark)}/staged"
    before = set(os.listdir(staged)) if os.path.isdir(staged) else set()
    run = similarity.write_build(micro, str(tmp_path / "edges"), k=3, dimension=32).first()
    edges = read_similar_to(spark, str(tmp_path / "edges"))
    want = {(r.sourceId, r.targetId) for r in edges.collect()}
    assert (run.nodePropertiesWritten, run.nodesCompared, run.relationshipsWritten) == (25, 9, len(want)) and want
    exact = edges.agg(F.min("score"), F.max("score"), F.avg("score"), F.stddev_pop("score")).first()
    assert (run.minScore, run.maxScore, run.meanScore, run.stdDev) == pytest.approx(tuple(exact))
    ranked = sorted(r.score for r in edges.collect())
    assert run.p50 == ranked[-(-len(ranked) // 2) - 1] and run.p99 == ranked[-1]
    assert set(os.listdir(staged)) == before


def test_the_counters_of_a_build_hold_a_few_numbers_per_task(spark, micro, tmp_path, monkeypatch):
    """Every task sends its counters to the driver, so none may keep the scores it has seen."""
    seen, write = [], similarity.write_similar_to
    monkeypatch.setattr(similarity, "write_similar_to", lambda edges, path, into, measures: (seen.extend(measures), write(edges, path, into, measures)))
    similarity.write_build(micro, str(tmp_path / "edges"), k=3, dimension=32)
    sent = spark.range(1000, numPartitions=1).select((F.rand(3)).alias("score")).agg(*seen).first()
    assert all(isinstance(v, int | float) for v in sent) and {c._jc.toString().split("(")[0] for c in seen} <= {"count", "min", "max", "avg", "stddev_pop"}


@pytest.mark.parametrize("values", [[], [0.5], [0.1, 0.2], [1.0] * 50 + [1.01] * 50, [None, 0.7, None, 0.6], [(i * 37 % 101) / 7 for i in range(101)], [-0.5, 0.0, 0.25] * 33])
def test_score_levels_are_exact_ranks(spark, values):
    edges = spark.createDataFrame([(v,) for v in values], "score double").repartition(3)
    ranked = sorted(v for v in values if v is not None)
    shares = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
    want = [ranked[max(1, math.ceil(s * len(ranked))) - 1] if ranked else None for s in shares]
    assert similarity.score_levels(edges, shares) == want


def test_staged_tables_are_released_on_failure_and_by_their_own_block(spark):
    with pytest.raises(ZeroDivisionError), released(spark) as outer:
        kept = stage(spark.range(3), "outer")
        with released(spark) as inner:
            stage(spark.range(2), "inner")
        assert len(inner) == 1 and not os.path.exists(inner[0]) and kept.count() == 3
        1 / 0
    assert len(outer) == 1 and not os.path.exists(outer[0])
    stage(spark.range(1), "free")
    assert len(outer) == 1


def test_many_copies_of_one_product(spark, micro):
    """A third of the catalogue with one neighbourhood still gets k neighbours each, lowest ids first."""
    copies = [(100 + i, 11) for i in range(60)]
    graph = dataclasses.replace(
        micro,
        product=micro.product.unionByName(
            spark.createDataFrame([(p, f"copy {p}", None, None, None, None) for p, _ in copies], micro.product.schema)
        ),
        belongs_to=micro.belongs_to.unionByName(spark.createDataFrame(copies, micro.belongs_to.schema)),
    )
    got = {}
    for r in similarity.neighbour_edges(graph, k=20, dimension=16).collect():
        got.setdefault(r.sourceId, []).append((-r.score, r.targetId))
    assert [t for _, t in sorted(got[100])] == list(range(101, 121))
    assert [t for _, t in sorted(got[159])] == list(range(100, 120))
