"""The stored page table: buckets, versions, refills, invalidation."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from shelfgraph.plans import serving, similarity
from shelfgraph.session import checkpoint_root
from shelfgraph.sources import page_store
from shelfgraph.sources.binding import EVENT_SCHEMA
from shelfgraph.sources.page_store import PAGE_SCHEMA, PageStore
from shelfgraph.verification import registry

NOON = dt.datetime(2024, 5, 1, 12)
EDGE = "sourceId long, targetId long, score double"


def page(product, number=1, payload="p", at=NOON, minutes=30):
    return (f"recs:{product}:{number}:2", product, payload, at, at + dt.timedelta(minutes=minutes))


@pytest.fixture
def store(spark, tmp_path):
    rows = [page(p, n) for p in range(20) for n in (1, 2)]
    return PageStore.create(spark, str(tmp_path / "store"), spark.createDataFrame(rows, PAGE_SCHEMA), buckets=8)


def keys(store):
    return sorted(r.cache_key for r in store.read().collect())


def files(store):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.root}/data/**/part-*", recursive=True)}


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "productId long")


def at(text="2024-05-01 12:10:00"):
    return F.lit(text).cast("timestamp")


def test_a_store_reads_back_and_another_process_finds_it(spark, store):
    assert keys(store) == sorted(f"recs:{p}:{n}:2" for p in range(20) for n in (1, 2))
    assert keys(PageStore(spark, store.root)) == keys(store)
    with pytest.raises(ValueError):
        PageStore(spark, store.root + "-none").manifest()


def test_lookup_reads_only_the_buckets_it_asks_for(spark, store):
    asked = spark.createDataFrame([("recs:3:1:2",), ("recs:3:9:2",), ("nonsense",), (None,)], "cache_key string")
    got = {r.cache_key: r.hit for r in store.look_up(asked, at()).collect()}
    assert got == {"recs:3:1:2": True, "recs:3:9:2": False, "nonsense": False, None: False}
    assert not any(r.hit for r in store.look_up(asked, at("2024-05-01 12:30:00")).collect())
    [bucket] = store._touched(ids(spark, 3).withColumnRenamed("productId", "product_id"), 8)
    read = {f.split("/bucket=")[1].split("/")[0] for f in store.look_up(asked, at()).inputFiles() if "/data/" in f}
    assert read == {str(bucket)}


def test_removal_leaves_all_data_files_and_put_only_those_of_other_buckets(spark, store):
    before = files(store)
    store.remove(ids(spark, 3, 4, 4, 99, None))
    assert files(store) == before
    assert keys(store) == sorted(f"recs:{p}:{n}:2" for p in range(20) if p not in (3, 4) for n in (1, 2))
    old = store.manifest()
    store.put(spark.createDataFrame([page(3, 1, "new"), page(3, 1, "newer", NOON + dt.timedelta(minutes=1)), (None, 5, "x", NOON, NOON), ("recs:6:1:2", None, "x", NOON, NOON)], PAGE_SCHEMA))
    now = store.manifest()
    [bucket] = store._touched(ids(spark, 3).withColumnRenamed("productId", "product_id"), 8)
    assert {b for b in now.data if now.data[b] != old.data.get(b)} == {bucket}
    assert bucket not in now.gone and before.items() <= files(store).items()
    assert [r.payload for r in store.read().where("product_id = 3").collect()] == ["newer"]
    assert not any(k.startswith("recs:4:") for k in keys(store))


def test_a_failed_writer_leaves_the_old_version_readable(spark, store, monkeypatch):
    before, version = keys(store), store.manifest().version

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(PageStore, "_commit", fail)
    for work in (lambda: store.put(spark.createDataFrame([page(50)], PAGE_SCHEMA)), lambda: store.remove(ids(spark, 1)), lambda: store.remove_prefix("recs:")):
        with pytest.raises(OSError):
            work()
    monkeypatch.undo()
    os.makedirs(f"{store.root}/manifest/000000000099-x/_temporary/0")  # a manifest that was begun
    assert keys(store) == before and store.manifest().version == version
    store.put(spark.createDataFrame([page(50)], PAGE_SCHEMA))
    assert set(keys(store)) - set(before) == {"recs:50:1:2"}


def test_many_removals_are_merged_into_the_data(spark, store, monkeypatch):
    monkeypatch.setattr(page_store, "MAX_GONE", 1)
    for p in range(6):
        store.remove(ids(spark, p))
    m = store.manifest()
    assert all(len(paths) <= 1 for paths in m.gone.values())
    assert {r.product_id for r in store.read().collect()} == set(range(6, 20))


def test_prefix_removal_rewrites_only_buckets_with_such_keys(spark, store):
    old = store.manifest()
    store.remove_prefix("recs:7:")
    now = store.manifest()
    assert len({b for b in old.data if old.data[b] != now.data.get(b)}) == 1
    assert keys(store) == sorted(f"recs:{p}:{n}:2" for p in range(20) if p != 7 for n in (1, 2))
    store.remove_prefix("none")
    assert store.manifest().version == now.version
    store.remove_prefix("recs:")
    assert keys(store) == []


def test_forks_do_not_see_each_other(spark, store, tmp_path):
    before = keys(store)
    fork = store.fork(str(tmp_path / "fork"))
    fork.remove(ids(spark, 1))
    store.remove(ids(spark, 2))
    assert not any(k.startswith("recs:1:") for k in keys(fork)) and any(k.startswith("recs:2:") for k in keys(fork))
    assert keys(store) == [k for k in before if not k.startswith("recs:2:")]


def test_read_through_computes_misses_only_and_stores_them(spark, micro, tmp_path):
    raw = spark.createDataFrame([(4, 1, 0.95), (4, 2, 0.95), (4, 9, 0.85), (1, 9, 0.9)], EDGE)
    edges = similarity.brand_boost(raw, micro.made_by)
    early, late = at("2024-05-01 12:00:00"), at("2024-05-01 13:00:00")
    pages = serving.serving_table(serving.recommendation_pages(micro, edges, page_size=2), early)
    store = PageStore.create(spark, str(tmp_path / "store"), pages, buckets=4)
    store.put(serving.serving_table(serving.recommendation_pages(micro, edges, page_size=2, products=ids(spark, 1)), late))
    seen = []

    def compute(missed):
        seen.append(sorted(r.cache_key for r in missed.collect()))
        return serving.refill(micro, edges, late)(missed)

    wanted = ["recs:1:1:2", "recs:4:1:2", "recs:4:2:2", "recs:4:7:2", "recs:4:1:50", "recs:4:1:5000", "recs:77:1:2", "other", None]
    asked = spark.createDataFrame([(k,) for k in wanted + wanted[:2]], "cache_key string")
    got = {r.cache_key: r for r in store.read_through(asked, late, compute).collect()}
    assert seen == [sorted(k for k in wanted if k and k.startswith("recs:") and k != "recs:1:1:2")]
    assert {k for k, r in got.items() if r.hit} == {"recs:1:1:2"}
    assert {k for k, r in got.items() if r.refilled} == {"recs:4:1:2", "recs:4:2:2", "recs:4:1:50"}
    assert {k for k, r in got.items() if r.payload is None} == {"recs:4:7:2", "recs:4:1:5000", "recs:77:1:2", "other", None}
    fresh = {r.cache_key: r.payload for r in pages.collect()}
    assert got["recs:4:1:2"].payload == fresh["recs:4:1:2"] and got["recs:4:2:2"].payload == fresh["recs:4:2:2"]
    again = {r.cache_key: r.hit for r in store.look_up(asked, late).collect()}
    assert {k for k, hit in again.items() if hit} == {"recs:1:1:2", "recs:4:1:2", "recs:4:2:2", "recs:4:1:50"}


def test_an_empty_store_takes_pages(spark, tmp_path):
    store = PageStore.create(spark, str(tmp_path / "store"), spark.createDataFrame([], PAGE_SCHEMA))
    assert keys(store) == []
    store.remove(ids(spark, 1))
    store.put(spark.createDataFrame([page(1)], PAGE_SCHEMA))
    assert keys(store) == ["recs:1:1:2"]


def test_a_write_stages_its_pages_once_and_computes_them_once(spark, store):
    staged, seen = f"{checkpoint_root(spark)}/staged", spark.sparkContext.accumulator(0)
    os.makedirs(staged, exist_ok=True)
    before = set(os.listdir(staged))

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    store.put(spark.createDataFrame([page(3, 1, "new"), page(77)], PAGE_SCHEMA).withColumn("payload", counted("payload")))
    assert len({x for x in os.listdir(staged)} - before) == 1 and seen.value == 2
    assert len(keys(store)) == 41 and {r.payload for r in store.read().where("cache_key = 'recs:3:1:2'").collect()} == {"new"}


def test_all_keys_may_go_by_prefix(spark, store):
    store.remove_prefix("recs:")
    assert keys(store) == [] and store.manifest().data == {}
    store.put(spark.createDataFrame([page(1)], PAGE_SCHEMA))
    assert keys(store) == ["recs:1:1:2"]


def test_the_asked_pages_are_read_from_the_events_once(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i), i % 3, "view", 1.0, f'{{"k": {i % 4}}}') for i in range(12)]
    spark.createDataFrame(rows, EVENT_SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    asked, _ = registry._asked_pages(spark, str(tmp_path))
    assert sorted(r.cache_key for r in asked.collect()) == [f"recs:{k}:1:10" for k in range(4)]
    assert not any("events.parquet" in f for f in asked.inputFiles())
