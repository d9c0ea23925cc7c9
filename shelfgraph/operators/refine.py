"""k-nearest-neighbour graph by refinement (NN-descent, Dong et al. 2011) in Spark rounds.

Neighbours of neighbours are likely neighbours. Every vector keeps a list of its k best; a round compares, around each
vector, the members of its list and a sample of the vectors that list it, as far as a link is new, and keeps
what improves a list. Rounds end when few entries change. The result is approximate; `recall` of the plans measures it.

Each step is linear in the number of vectors:

* start lists: a vector is compared with the others of its two nearest cells, cut into buckets of bounded size. Sharing two cells links the cells;
* a round's links are narrow rows, at most k forward and REVERSE sampled reverse ones per vector, so a hub costs no more than others;
* the vectors around a cell overlap, so a bucket of a cell's vectors is one task, and each vector is sent there once, not once per link;
* a task returns at most k improvements for each vector it has seen.

With few vectors (up to about two cells) everything shares a bucket, and the start lists are the exact graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .neighbours import CELL_ROWS, CUTOFF, MAX_PIVOTS, SCORE_DECIMALS, TOP_K, _packed, _pivots
from .ranking import first_per_key

# Fixed values of the documented defaults of the procedure: share of entries whose change ends the rounds, and their limit.
DELTA = 0.001
MAX_ROUNDS = 100

REVERSE = TOP_K  # vectors that list a vector, sampled per round
BUCKET_ROWS = 4096  # vectors of one start bucket
PIVOT_ROWS = 256  # vectors whose surroundings one task compares

_LIST = "id bigint, nbr bigint, score double"


def _matrix(column: pa.ChunkedArray):
    import numpy as np

    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def _top(ids, nbrs, scores, k: int) -> pa.Table:
    """Best k distinct neighbours of each id, ties by the lower neighbour."""
    import numpy as np

    order = np.lexsort((nbrs, -scores, ids))
    ids, nbrs, scores = ids[order], nbrs[order], scores[order]
    # equal pairs have equal scores, so they stand side by side
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (nbrs[1:] != nbrs[:-1])
    ids, nbrs, scores = ids[fresh], nbrs[fresh], scores[fresh]
    keep = np.arange(len(ids)) - np.searchsorted(ids, ids) < k
    return pa.table({"id": ids[keep], "nbr": nbrs[keep], "score": scores[keep]})


def _score(a, b, decimals: int, unit: bool):
    import numpy as np

    score = a @ b.T
    return np.round((score + 1.0) / 2.0 if unit else score, decimals)


def _within(k: int, decimals: int, unit: bool):
    """Function of one start bucket: best k others of each vector."""

    def match(bucket: pa.Table) -> pa.Table:
        import numpy as np

        ids, x = bucket.column("id").to_numpy(), _matrix(bucket.column("vec"))
        out = []
        for low in range(0, len(ids), 512):
            score = _score(x[low : low + 512], x, decimals, unit)
            score[ids[low : low + 512, None] == ids[None, :]] = -np.inf
            keep = np.isfinite(score)
            if len(ids) > k:
                keep &= score >= np.partition(score, -k, axis=1)[:, -k][:, None]
            r, c = np.nonzero(keep)
            out.append(_top(ids[low : low + 512][r], ids[c], score[r, c], k))
        return pa.concat_tables(out)

    return match


def _around(k: int, decimals: int, unit: bool):
    """Function of one bucket of pivots: pairs of members of a pivot that improve a list."""

    def match(links: pa.Table, vectors: pa.Table) -> pa.Table:
        import numpy as np

        ids = vectors.column("id").to_numpy()
        order = np.argsort(ids)
        ids, x, bar = ids[order], _matrix(vectors.column("vec"))[order], vectors.column("bar").to_numpy()[order]
        pivot, member, fresh = (links.column(n).to_numpy(zero_copy_only=False) for n in ("pivot", "member", "fresh"))
        # one row per (pivot, member), new if any of its links is
        by = np.lexsort((~fresh, member, pivot))
        pivot, member, fresh = pivot[by], member[by], fresh[by]
        first = np.ones(len(pivot), bool)
        first[1:] = (pivot[1:] != pivot[:-1]) | (member[1:] != member[:-1])
        pivot, at, fresh = pivot[first], np.searchsorted(ids, member[first]), fresh[first]
        edges = np.append(np.flatnonzero(np.diff(pivot, prepend=pivot[:1] - 1)), len(pivot))
        found = []
        for low, high in zip(edges[:-1], edges[1:]):
            rows, new = at[low:high], np.flatnonzero(fresh[low:high])
            if not len(new):
                continue
            score = _score(x[rows[new]], x[rows], decimals, unit)
            score[np.arange(len(new)), new] = -np.inf
            for side in (0, 1):
                beat = bar[rows[new]][:, None] if side == 0 else bar[rows][None, :]
                r, c = np.nonzero(score > beat)
                mine, other = (rows[new][r], rows[c]) if side == 0 else (rows[c], rows[new][r])
                found.append((mine, other, score[r, c]))
        if not found:
            return pa.table({"id": pa.array([], pa.int64()), "nbr": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        mine, other, score = (np.concatenate(f) for f in zip(*found))
        return _top(ids[mine], ids[other], score, k)

    return match


def refined_groups(
    vectors: DataFrame,
    k: int = TOP_K,
    cutoff: float = CUTOFF,
    decimals: int = SCORE_DECIMALS,
    scale: str = "raw",
    cell_rows: int = CELL_ROWS,
    delta: float = DELTA,
    max_rounds: int = MAX_ROUNDS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(qid, tid, score): about the best k others per row of vectors(id bigint, vec array)."""
    unit = scale == "unit"
    vectors = stage(_packed(vectors), "packed")
    count = vectors.count()
    if count == 0:
        return vectors.select(F.col("id").alias("qid"), F.col("id").alias("tid"), F.lit(0.0).alias("score"))
    pivots = _pivots(vectors, min(MAX_PIVOTS, max(1, -(-count // cell_rows))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                cos = _matrix(batch.column(1)) @ pivots.T
                near = np.argsort(-cos, axis=1, kind="stable")[:, :2].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(near), pa.list_(pa.int32()))], names=["id", "vec", "cells"])

    celled = stage(vectors.mapInArrow(assign, "id bigint, vec binary, cells array<int>"), "cells")

    def bucketed(rows: DataFrame, size: int) -> DataFrame:
        """rows(id, cell) with their bucket: cells are cut by hash into parts of about size rows."""
        parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("_parts"))  # at most MAX_PIVOTS rows
        part = F.pmod(F.xxhash64("id", "cell"), F.col("_parts"))
        return rows.join(F.broadcast(parts), "cell").withColumn("bucket", F.col("cell").cast("long") * (1 << 40) + part)

    opening = bucketed(celled.select("id", "vec", F.explode("cells").alias("cell")), bucket_rows)
    found = opening.select("bucket", "id", "vec").groupBy("bucket").applyInArrow(_within(k, decimals, unit), _LIST)
    lists = stage(_kept(found.withColumn("fresh", F.lit(True)), k), "lists")
    home = stage(bucketed(celled.select("id", F.col("cells")[0].alias("cell")), PIVOT_ROWS).select("id", "bucket"), "home")
    known = celled.select("id", "vec")
    for turn in range(max_rounds if len(pivots) > 1 else 0):
        links = stage(_links(lists, turn).join(home.withColumnRenamed("id", "pivot"), "pivot"), "links")
        full = lists.groupBy("id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
        asked = links.select(F.col("bucket").alias("place"), F.col("member").alias("id")).distinct()
        sent = asked.join(known, "id").join(full, "id", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0)))
        better = links.groupBy("bucket").cogroup(sent.groupBy("place")).applyInArrow(_around(k, decimals, unit), _LIST)
        both = lists.withColumn("fresh", F.lit(False)).unionByName(better.withColumn("fresh", F.lit(True)))
        lists = stage(_kept(both, k), "lists")
        if lists.where("fresh").count() <= delta * k * count:
            break
    return lists.where(F.col("score") >= cutoff).select(F.col("id").alias("qid"), F.col("nbr").alias("tid"), "score")


def _kept(rows: DataFrame, k: int) -> DataFrame:
    """Best k distinct neighbours of each id; an entry that was there before is not fresh."""
    single = rows.groupBy("id", "nbr").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    return first_per_key(single, ["id"], [F.desc("score"), F.asc("nbr")], k)


def _links(lists: DataFrame, turn: int) -> DataFrame:
    """(pivot, member, fresh): each vector's list, a sample of those that list it, and itself."""
    forward = lists.select(F.col("id").alias("pivot"), F.col("nbr").alias("member"), "fresh")
    back = lists.select(F.col("nbr").alias("pivot"), F.col("id").alias("member"), "fresh")
    back = first_per_key(back, ["pivot"], [F.desc("fresh"), F.xxhash64("pivot", "member", F.lit(turn)), F.asc("member")], REVERSE)
    itself = lists.select(F.col("id").alias("pivot"), F.col("id").alias("member"), F.lit(False).alias("fresh")).distinct()
    return forward.unionByName(back).unionByName(itself)
