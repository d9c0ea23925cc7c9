"""Session set-up and durable staging of intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "shelfgraph", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every plan here expects.

    A cluster submits with its own master and sizes; only semantics-bearing
    settings (time zone, adaptive execution) are fixed.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, as named by the cluster.

    Only a local session without the setting gets a folder of its own: on a
    cluster a machine-local folder would lose data with its executor.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root
    context = spark.sparkContext
    root = context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="shelfgraph-")
        context.setCheckpointDir(root)
    return root


_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def released(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that are staged inside, on success and on failure.

    A result must have been written or collected before the end, because lazy DataFrames still read staged
    tables. Inner blocks own what they stage; the rest belongs to the outer one.
    """
    owned: list[str] = []
    token = _staged.set(owned)
    try:
        yield owned
    finally:
        _staged.reset(token)
        for path in owned:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table's folder in whatever file system it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and continue from the written table.

    This cuts lineage durably (a lost executor re-reads files instead of
    recomputing a loop), freezes values such as partition ids that a recompute
    could change, and gives the optimiser real table sizes. Inside `released` the table is deleted at the end.
    """
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/staged/{label}-{uuid.uuid4().hex}"
    owned = _staged.get()
    if owned is not None:
        owned.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
