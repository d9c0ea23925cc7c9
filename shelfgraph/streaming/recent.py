"""Recently viewed lists kept up to date by a stream of view events.

For the users of a batch the stream writes their newest views in it; every written row is a view, and the newest few of all rows
of a user are its list. So the stream holds no state: late, repeated and replayed events change no list, and a user who stays away costs nothing.
`compact` folds the written batches into one table of at most a list per user, whatever the number of batches.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.recent import MAX_RECENT, recent_items
from ..session import drop_path


def batch_rows(views: DataFrame, keep: int = MAX_RECENT) -> DataFrame:
    """(user_id, productId, viewed_us): the newest views of each user in one batch."""
    return recent_items(views, keep).select("user_id", "productId", F.unix_micros("viewed_at").alias("viewed_us"))


def current_lists(updates: DataFrame, keep: int = MAX_RECENT) -> DataFrame:
    """Current (user_id, productId, viewed_at, position) from a table of written batches."""
    return recent_items(updates.select("user_id", "productId", F.timestamp_micros("viewed_us").alias("viewed_at")), keep)


def _merged_root(table_path: str) -> str:
    return f"{table_path.rstrip('/')}-merged"


def _read(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(pattern)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


def stored_lists(spark: SparkSession, table_path: str, keep: int = MAX_RECENT) -> DataFrame:
    """Current lists from the compacted table and the batches since."""
    rows = "user_id bigint, productId bigint, viewed_us bigint"
    batches, merged = _read(spark, f"{table_path}/batch=*", rows), _read(spark, f"{_merged_root(table_path)}/*", rows)
    return current_lists(batches.unionByName(merged), keep)


def compact(spark: SparkSession, table_path: str, keep: int = MAX_RECENT) -> None:
    """Fold all batches into one compacted table, then delete what it holds.

    Run it between two runs of the stream. A failure in between leaves rows twice, which changes no list; a batch that a
    restart writes again is folded again. The compacted table has at most `keep` rows per user.
    """
    files = stored_lists(spark, table_path, keep)
    old = sorted({f.rsplit("/", 1)[0] for f in files.inputFiles()})
    if old:
        rows = files.select("user_id", "productId", F.unix_micros("viewed_at").alias("viewed_us"))
        rows.write.parquet(f"{_merged_root(table_path)}/{uuid.uuid4().hex}")
        for path in old:
            drop_path(spark, path)


def start(views: DataFrame, table_path: str, checkpoint_path: str, **trigger):
    """Run the stream into a parquet table of updates. A replayed batch overwrites its own folder,
    so a restart after a failure leaves no duplicate."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch_rows(batch).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return (
        views.select("user_id", "productId", "viewed_at")
        .writeStream.option("checkpointLocation", checkpoint_path)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
