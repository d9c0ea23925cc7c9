"""Stored serving pages: a Parquet table in key buckets, with a manifest for every version.

A product's pages lie in one bucket, so a lookup, a refill or an invalidation touches the buckets of its keys and no others. Data files are never
changed. A write adds new files for the touched buckets and then one manifest that names the files of all buckets;
readers follow the latest manifest, so a writer that fails, or is still at work, is not seen. Invalidation adds a short list of products
to their buckets; the next write to a bucket leaves those rows out. One writer at a time.

Buckets bound what the driver holds: one row each, and at most MAX_GONE lists.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_product
from ..session import stage

PAGE_SCHEMA = "cache_key string, product_id bigint, payload string, computed_at timestamp, expires_at timestamp"
MANIFEST_SCHEMA = "version bigint, buckets int, bucket int, kind string, path string"
BUCKETS = 64
MAX_GONE = 8  # lists of one bucket; beyond that the bucket is written anew


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    data: dict[int, str]  # files of each bucket
    gone: dict[int, tuple[str, ...]]  # lists of removed products, by bucket


class PageStore:
    """Pages below root. `create` starts a store; without it a store must exist there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, pages: DataFrame, buckets: int = BUCKETS) -> PageStore:
        store = cls(spark, root)
        store._commit(Manifest(0, buckets, {}, {}))
        store.put(pages)
        return store

    def fork(self, root: str) -> PageStore:
        """A store of its own that starts from this one's files; neither sees what the other writes."""
        other, now = PageStore(self.spark, root), self.manifest()
        other._commit(Manifest(0, now.buckets, now.data, now.gone))
        return other

    # versions

    def manifest(self) -> Manifest:
        try:
            rows = self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.root}/manifest/*")
            latest = rows.agg(F.max("version")).first()[0]
        except AnalysisException as error:
            raise ValueError(f"no page store at {self.root}") from error
        data, gone, buckets = {}, {}, 0
        for r in rows.where(F.col("version") == latest).collect():
            buckets = r["buckets"]
            if r["kind"] == "data":
                data[r["bucket"]] = r["path"]
            elif r["kind"] == "gone":
                gone[r["bucket"]] = (*gone.get(r["bucket"], ()), r["path"])
        return Manifest(latest, buckets, data, gone)

    def _commit(self, m: Manifest) -> None:
        """The last step of a write: one small file, which appears whole or not at all."""
        rows = [(m.version, m.buckets, None, "version", None)]
        rows += [(m.version, m.buckets, b, "data", path) for b, path in sorted(m.data.items())]
        rows += [(m.version, m.buckets, b, "gone", path) for b, paths in sorted(m.gone.items()) for path in paths]
        self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.parquet(f"{self.root}/manifest/{m.version:012d}-{uuid.uuid4().hex}")

    # reading

    def bucket(self, product: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(product), F.lit(buckets)).cast("int")

    def _touched(self, keys: DataFrame, buckets: int) -> list[int]:
        """Buckets of the products of keys(product_id), at most all of them."""
        found = keys.where(F.col("product_id").isNotNull()).select(self.bucket(F.col("product_id"), buckets).alias("b")).distinct()
        return sorted(r["b"] for r in found.collect())

    def read(self, only: list[int] | None = None, at: Manifest | None = None) -> DataFrame:
        """Pages of the given buckets, or of all; only their files are read."""
        m = at or self.manifest()
        wanted = set(range(m.buckets) if only is None else only)
        data = [path for b, path in sorted(m.data.items()) if b in wanted]
        gone = [path for b, paths in sorted(m.gone.items()) if b in wanted for path in paths]
        if not data:
            return self.spark.createDataFrame([], PAGE_SCHEMA)
        pages = self.spark.read.schema(PAGE_SCHEMA).parquet(*data)
        if gone:
            removed = self.spark.read.schema("product_id bigint").parquet(*gone).distinct()
            pages = pages.join(removed, "product_id", "left_anti").select("cache_key", "product_id", "payload", "computed_at", "expires_at")
        return pages

    def look_up(self, requests: DataFrame, as_of: Column) -> DataFrame:
        """requests(cache_key) with payload and hit; a page that is absent or expired is a miss.

        The requests are read twice, for the buckets they ask for and for their pages.
        """
        m = self.manifest()
        touched = self._touched(requests.select(key_product(F.col("cache_key")).alias("product_id")), m.buckets)
        fresh = self.read(touched, m).where(F.col("expires_at") > as_of).select("cache_key", "payload")
        return requests.join(fresh, "cache_key", "left").withColumn("hit", F.col("payload").isNotNull())

    # writing

    def _write(self, rows: DataFrame, m: Manifest, touched: list[int]) -> Manifest:
        """New files for the touched buckets with exactly these rows; returns the next version, not yet committed.

        The rows are computed once: which buckets have any is read from the written files.
        """
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", self.bucket(F.col("product_id"), m.buckets))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(path)
        held = {r["bucket"] for r in self.spark.read.schema("bucket int").parquet(path).distinct().collect()}
        data = {b: p for b, p in m.data.items() if b not in touched} | {b: f"{path}/bucket={b}" for b in held}
        return Manifest(m.version + 1, m.buckets, data, {b: p for b, p in m.gone.items() if b not in touched})

    def put(self, pages: DataFrame) -> None:
        """Store pages; one with a stored key replaces it, and of equal keys the one computed last stays. Rows without a key or product are left out."""
        kind = ["cache_key", "product_id", "payload", "computed_at", "expires_at"]
        m = self.manifest()
        last = F.max(F.struct("computed_at", "expires_at", "payload", "product_id")).alias("p")
        rows = pages.where(F.col("cache_key").isNotNull() & F.col("product_id").isNotNull()).groupBy("cache_key").agg(last)
        rows = stage(rows.select("cache_key", "p.product_id", "p.payload", "p.computed_at", "p.expires_at"), "put")
        touched = self._touched(rows, m.buckets)
        if touched:
            kept = self.read(touched, m).join(rows.select("cache_key"), "cache_key", "left_anti").select(kind)
            self._commit(self._write(kept.unionByName(rows), m, touched))

    def remove(self, products: DataFrame) -> None:
        """Remove every page of products(productId): short lists beside the data, which stays as it is."""
        m = self.manifest()
        ids = stage(products.select(F.col("productId").alias("product_id")).where("product_id IS NOT NULL").distinct(), "remove")
        touched = [b for b in self._touched(ids, m.buckets) if b in m.data]
        if not touched:
            return
        path = f"{self.root}/gone/{uuid.uuid4().hex}"
        ids.withColumn("bucket", self.bucket(F.col("product_id"), m.buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)
        gone = m.gone | {b: (*m.gone.get(b, ()), f"{path}/bucket={b}") for b in touched}
        after = Manifest(m.version + 1, m.buckets, m.data, gone)
        full = [b for b, paths in gone.items() if len(paths) > MAX_GONE]
        self._commit(self._write(self.read(full, after), after, full) if full else after)

    def remove_prefix(self, prefix: str) -> None:
        """Remove all keys that start with prefix; only the buckets that hold such keys are written anew."""
        m = self.manifest()
        starts = F.col("cache_key").startswith(prefix)
        touched = self._touched(self.read(at=m).where(starts), m.buckets)
        if touched:
            self._commit(self._write(self.read(touched, m).where(~starts), m, touched))

    def read_through(self, requests: DataFrame, as_of: Column, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """requests(cache_key) with hit, refilled and payload; pages of missed products are computed, stored and returned.

        compute gets (cache_key, product_id) of the misses only and returns pages in the store's columns. A key that it
        gives no page for stays without payload.
        """
        asked = stage(self.look_up(requests.select("cache_key").distinct(), as_of), "asked")
        missed = asked.where("NOT hit").select("cache_key", key_product(F.col("cache_key")).alias("product_id")).where("product_id IS NOT NULL")
        pages = stage(compute(missed), "computed")
        self.put(pages)
        new = pages.groupBy("cache_key").agg(F.max(F.struct("computed_at", "payload")).alias("p")).select("cache_key", F.col("p.payload").alias("_new"))
        return asked.join(new, "cache_key", "left").select(
            "cache_key", "hit", (~F.col("hit") & F.col("_new").isNotNull()).alias("refilled"), F.coalesce("payload", "_new").alias("payload")
        )
