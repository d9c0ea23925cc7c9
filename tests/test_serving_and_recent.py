import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from shelfgraph.plans import recent, serving, similarity
from shelfgraph.streaming import recent as stream

EDGE = "sourceId long, targetId long, score double"


@pytest.fixture(scope="module")
def table(spark, micro):
    raw = spark.createDataFrame([(4, 1, 0.95), (4, 2, 0.95), (4, 9, 0.85), (1, 9, 0.9)], EDGE)
    pages = serving.recommendation_pages(micro, similarity.brand_boost(raw, micro.made_by), page_size=2)
    at = F.lit("2024-05-01 12:00:00").cast("timestamp")
    return serving.serving_table(pages, at)


def test_every_product_has_a_page_and_pages_hold_the_envelope(table):
    rows = {r.cache_key: json.loads(r.payload)["similarProducts"] for r in table.collect()}
    assert "recs:3:1:2" in rows and rows["recs:3:1:2"]["items"] == [] and rows["recs:3:1:2"]["totalPages"] == 0
    first = rows["recs:4:1:2"]
    assert [i["productId"] for i in first["items"]] == [1, 1]
    assert (first["totalCount"], first["page"], first["pageSize"], first["totalPages"], first["hasMore"]) == (3, 1, 2, 2, True)
    assert list(first["items"][0]) == ["productId", "productName", "productDescription", "brandId", "brandName", "similarityScore", "sameBrand"]
    last = rows["recs:1:1:2"]["items"][0]
    assert last["brandName"] is None and last["sameBrand"] is False


def test_payload_reads_back(table):
    parsed = table.where("cache_key = 'recs:4:1:2'").select(serving.read_payload(F.col("payload")).alias("p")).first().p
    assert parsed.similarProducts.totalCount == 3 and parsed.similarProducts["items"][0].productId == 1


@pytest.mark.parametrize("at, hit", [("2024-05-01 12:29:59", True), ("2024-05-01 12:30:00", False)])
def test_lookup_respects_expiry(spark, table, at, hit):
    asked = spark.createDataFrame([("recs:4:1:2",), ("recs:4:9:2",)], "cache_key string")
    got = {r.cache_key: (r.hit, r.payload is not None) for r in serving.look_up(asked, table, F.lit(at).cast("timestamp")).collect()}
    assert got == {"recs:4:1:2": (hit, hit), "recs:4:9:2": (False, False)}


def test_invalidate_by_product_and_by_prefix(spark, table):
    changed = spark.createDataFrame([(4,), (4,)], "productId long")
    keys = {r.cache_key for r in table.collect()}
    assert {r.cache_key for r in serving.invalidate(table, changed).collect()} == {k for k in keys if not k.startswith("recs:4:")}
    assert serving.invalidate_prefix(table, "recs:").isEmpty()
    assert {r.cache_key for r in serving.invalidate_prefix(table, "recs:1:").collect()} == {k for k in keys if not k.startswith("recs:1:")}


VIEW = "user_id long, productId long, viewed_at timestamp"


def views(seed, n=400):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(n):
        user = 1 if rng.random() < 0.4 else rng.randint(2, 9)
        rows.append((user, rng.randint(0, 30), base + dt.timedelta(seconds=rng.randint(0, 5000))))
    return rows + rows[: n // 5]  # repeated events


def brute_recent(rows, keep=6):
    last = {}
    for user, item, at in rows:
        last[(user, item)] = max(at, last.get((user, item), at))
    out = set()
    for user in {u for u, _ in last}:
        mine = sorted(((at, i) for (u, i), at in last.items() if u == user), key=lambda p: (-p[0].timestamp(), p[1]))
        out |= {(user, item, place) for place, (_, item) in enumerate(mine[:keep], 1)}
    return out


def found(df):
    return {(r.user_id, r.productId, r.position) for r in df.collect()}


def test_recent_items_against_brute_force(spark):
    rows = views(1)
    assert found(recent.recent_items(spark.createDataFrame(rows, VIEW))) == brute_recent(rows)


def test_stream_equals_batch_in_any_arrival_order(spark, tmp_path):
    rows = views(2)
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)  # late events everywhere
    for part in range(4):
        spark.createDataFrame(shuffled[part::4], VIEW).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    source = (
        spark.readStream.schema(VIEW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        .parquet(str(tmp_path / "in"))
    )
    updates, checkpoint = str(tmp_path / "updates"), str(tmp_path / "checkpoint")
    stream.start(source, updates, checkpoint).awaitTermination()
    table = spark.read.parquet(updates)
    assert table.select("batch").distinct().count() > 1
    assert found(stream.current_lists(table)) == brute_recent(rows)
    # A restart with nothing new keeps the answer.
    stream.start(source, updates, checkpoint).awaitTermination()
    assert found(stream.current_lists(spark.read.parquet(updates))) == brute_recent(rows)


def test_compaction_between_runs_loses_no_view(spark, tmp_path):
    """The stream holds no state; batches are folded between its runs, lists stay right and the table small."""
    rows = views(5)
    updates, checkpoint = str(tmp_path / "updates"), str(tmp_path / "checkpoint")
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(VIEW).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream.compact(spark, updates)  # nothing there yet
    for part in range(3):
        seen = rows[: (part + 1) * len(rows) // 3]
        spark.createDataFrame(rows[part * len(rows) // 3 : (part + 1) * len(rows) // 3], VIEW).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
        stream.start(source, updates, checkpoint).awaitTermination()
        assert found(stream.stored_lists(spark, updates)) == brute_recent(seen)
        stream.compact(spark, updates)
        assert found(stream.stored_lists(spark, updates)) == brute_recent(seen)
    merged = spark.read.parquet(f"{updates}-merged/*")
    assert merged.count() == len(brute_recent(rows)) and not list((tmp_path / "updates").glob("batch=*/part-*"))


def test_display_columns(spark, micro):
    items = spark.createDataFrame([(7, 1, dt.datetime(2024, 1, 1), 1), (7, 3, dt.datetime(2024, 1, 1), 2)], "user_id long, productId long, viewed_at timestamp, position long")
    rows = {r.productId: r for r in recent.with_display(items, micro).collect()}
    assert (rows[1].brandId, rows[1].brandName, rows[1].viewedAt) == (1, "Alphabrand", 1704067200000)
    assert rows[3].brandId is None
