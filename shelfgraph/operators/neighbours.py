"""k-nearest-neighbour graph by cosine, as a partitioned join; exact by default.

The vectors are split into cells around pivots drawn from the data (Voronoi cells,
after Lu et al. 2012). Each vector is compared with its own cell first, which
gives it a k-th best score to beat; it is then sent only to cells that could hold
something at least as close, judged by the angle between the vector and the cell's pivot and
the cell's radius. Every comparison happens inside a bounded block: a matrix product
in one task that emits at most k rows per vector. Cells of any size are
cut into blocks, so none is too large for a task, and no pair list is ever formed.

How much the bound saves depends on the data: much for clustered vectors, nothing for
vectors of high intrinsic dimension. A trial on a few thousand vectors tells; where the
bound excludes too little, all blocks of vectors are compared with all others instead: each block is
written once to the shuffle and read again for each of its comparisons, so the disk holds every vector twice, not once per block it meets.
Both ways are exact, and in the worst case both compare everything. For catalogues beyond that, `probes`
gives the approximate graph: only the nearest cells are visited, in time
proportional to probes / cells of the exact one.

Equal vectors are merged beforehand, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .ranking import first_per_key
from .skew import hot_keys, split_join

# Fixed values of the reference configuration.
TOP_K = 20
CUTOFF = 0.5

# Scores are cut and ranked on this many decimals: finer than any threshold, and coarser than what
# the order of summation can change.
SCORE_DECIMALS = 9

MAX_PIVOTS = 4096  # bounds what the driver and each task hold: 8 MB at 256 dimensions
CELL_ROWS = 1024  # wanted rows per cell while MAX_PIVOTS allows it
BLOCK_ROWS = 4096  # rows on either side of one comparison block
BLOCK_BYTES = 4 << 20  # and of their vectors, where all blocks meet
SIDE_BYTES = 64 << 20  # vectors of the target blocks that one task holds
MAX_ASKING = 512  # partitions of the query blocks
TRIAL_ROWS = 4096  # vectors that decide whether the bound is worth using

_HIT = "qid bigint, tid bigint, score double"


def _block_match(k: int, floor: float, decimals: int, unit: bool):
    """Function of one comparison block: best k targets of each query."""

    def match(block: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        def side(name):
            rows = block[block["side"] == name]
            vectors = np.frombuffer(b"".join(rows["vec"]), dtype=np.float64)
            return rows["id"].to_numpy(), vectors.reshape(len(rows), -1) if len(rows) else None

        qid, q = side("q")
        tid, t = side("t")
        out = []
        if q is not None and t is not None:
            for low in range(0, len(qid), 512):
                ids = qid[low : low + 512]
                score = q[low : low + 512] @ t.T
                if unit:
                    score = (score + 1.0) / 2.0
                score = np.round(score, decimals)
                score[ids[:, None] == tid[None, :]] = -np.inf
                keep = score >= floor
                if len(tid) > k:
                    # k-th best per row; everything tied with it stays until ids decide.
                    keep &= score >= np.partition(score, -k, axis=1)[:, -k][:, None]
                r, c = np.nonzero(keep)
                order = np.lexsort((tid[c], -score[r, c], r))
                r, c = r[order], c[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                r, c = r[place < k], c[place < k]
                out.append(pd.DataFrame({"qid": ids[r], "tid": tid[c], "score": score[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "tid": [], "score": []})

    return match


def _compare(queries: DataFrame, targets: DataFrame, k: int, floor: float, decimals: int, unit: bool, whole: bool = False) -> DataFrame:
    """Best k targets per query within each shared cell: (qid, tid, score).

    queries(id, cell, vec) and targets(id, cell, vec). A cell with many rows on either
    side becomes a grid of blocks, each a group of at most about BLOCK_ROWS rows per side.
    whole: everything is one cell, and queries(id, vec, beat) ask for scores of at least beat.
    """
    if whole:
        return _compare_all(queries, targets, k, decimals, unit)
    # One row per cell, so at most MAX_PIVOTS: small enough to broadcast.
    sizes = (
        queries.groupBy("cell").agg(F.count("*").alias("_q"))
        .join(targets.groupBy("cell").agg(F.count("*").alias("_t")), "cell")
        .select(
            "cell",
            F.ceil(F.col("_q") / BLOCK_ROWS).cast("int").alias("_qn"),
            F.ceil(F.col("_t") / BLOCK_ROWS).cast("int").alias("_tn"),
        )
    )

    def spread(rows: DataFrame, side: str, mine: str, other: str) -> DataFrame:
        return (
            rows.join(F.broadcast(sizes), "cell")
            .withColumn("_mine", F.pmod(F.xxhash64("id"), F.col(mine)).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .select(
                "cell",
                F.col("_mine" if side == "q" else "_other").alias("qb"),
                F.col("_other" if side == "q" else "_mine").alias("tb"),
                F.lit(side).alias("side"),
                "id",
                "vec",
            )
        )

    both = spread(queries, "q", "_qn", "_tn").unionByName(spread(targets, "t", "_tn", "_qn"))
    return both.groupBy("cell", "qb", "tb").applyInPandas(_block_match(k, floor, decimals, unit), _HIT)


def _blocks(rows: DataFrame, size: int, names: list[str]) -> DataFrame:
    """rows(id, vec, ...) as one row per block of at most size rows: its number and each column as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, parts = TaskContext.get().partitionId() << 32, 0, []

        def block() -> pa.RecordBatch:
            columns = [pa.concat_arrays([p.column(i) for p in parts]) for i in range(len(names))]
            data = [b"".join(c.to_pylist()) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False).tobytes() for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([d], pa.binary()) for d in data]], names=["block", *names])

        for batch in batches:
            low = 0
            while low < batch.num_rows:
                part = batch.slice(low, size - held)
                parts.append(part)
                low, held = low + part.num_rows, held + part.num_rows
                if held == size:
                    yield block()
                    parts, held, number = [], 0, number + 1
        if held:
            yield block()

    return rows.mapInArrow(pack, ", ".join(["block bigint", *[f"{n} binary" for n in names]]))


def _compare_all(queries: DataFrame, targets: DataFrame, k: int, decimals: int, unit: bool) -> DataFrame:
    """Best k targets per query, part by part: (qid, tid, score), at most k of each query from one partition of targets.

    queries(id, vec, beat) asks for scores of at least beat; targets(id, vec). Blocks of both sides meet in a Cartesian
    product of their partitions, which reads what was shuffled again instead of copying it. Queries are dealt out row by row, so that
    the tasks are even.
    """
    n, width = targets.agg(F.count("*"), F.max(F.length("vec"))).first()
    asked = queries.count()
    if not n or not asked:
        return targets.select(F.col("id").alias("qid"), F.col("id").alias("tid"), F.lit(0.0).alias("score")).limit(0)
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // width))
    asking = min(MAX_ASKING, -(-asked // size))
    tasks = 4 * targets.sparkSession.sparkContext.defaultParallelism
    held = max(-(-n * width // SIDE_BYTES), min(-(-tasks // asking), -(-n // CELL_ROWS)))
    slack = 2 * 10.0**-decimals

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, ids, x, bar = None, None, None, None
        row, tid, score = none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def merged(row, tid, score):
            by = np.lexsort((tid, -score, row))
            row, tid, score = row[by], tid[by], score[by]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            return row[keep], tid[keep], score[keep]

        def hits():
            return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(tid), pa.array(score)], names=["qid", "tid", "score"])

        for batch in batches:
            for b in range(batch.num_rows):
                block, qid, qvec, beat, _, tids, tvec = (batch.column(i)[b] for i in range(7))
                if block.as_py() != now:
                    if len(row):
                        yield hits()
                    # copies, so that the batch they came in is not held
                    now, ids, bar = block.as_py(), np.frombuffer(qid.as_buffer(), np.int64).copy(), np.frombuffer(beat.as_buffer(), np.float64).copy()
                    x = np.frombuffer(qvec.as_buffer(), np.float64).reshape(len(ids), -1).copy()
                    row, tid, score = none
                tids = np.frombuffer(tids.as_buffer(), np.int64)
                t = np.frombuffer(tvec.as_buffer(), np.float64).reshape(len(tids), -1)
                found = [(row, tid, score)]
                for low in range(0, len(ids), 512):
                    mine, floor = ids[low : low + 512], bar[low : low + 512]
                    close = x[low : low + 512] @ t.T
                    if unit:
                        close = (close + 1.0) / 2.0
                    keep = close >= floor[:, None] - slack
                    if np.count_nonzero(keep) > 4 * k * len(mine) and len(tids) > k:
                        # many are above the bar so far: the k-th best of this block is a higher one
                        close[mine[:, None] == tids[None, :]] = -np.inf
                        keep &= close >= np.partition(close, -k, axis=1)[:, -k][:, None] - slack
                    r, c = np.nonzero(keep)
                    near = np.round(close[r, c], decimals)
                    keep = (near >= floor[r]) & (mine[r] != tids[c])
                    found.append((r[keep] + low, tids[c[keep]], near[keep]))
                row, tid, score = merged(*(np.concatenate(part) for part in zip(*found)))
                full = np.flatnonzero(np.bincount(row, minlength=len(ids)) >= k)
                bar[full] = score[np.searchsorted(row, full, side="right") - 1]
        if len(row):
            yield hits()

    left = queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), "beat").repartition(asking)
    right = _blocks(targets.select(F.col("id").alias("tid"), F.col("vec").alias("tvec")), min(size, -(-n // held)), ["tid", "tvec"])
    right = right.withColumnRenamed("block", "other").repartition(held)
    pairs = _blocks(left, size, ["qid", "qvec", "beat"]).hint("shuffle_replicate_nl").crossJoin(right)
    return pairs.mapInArrow(compare, _HIT)


def _pivots(vectors: DataFrame, wanted: int):
    """Wanted pivots as one matrix: the rows with the least id hash, at most MAX_PIVOTS."""
    import numpy as np

    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()
    return np.vstack([np.frombuffer(bytes(r["vec"]), dtype=np.float64) for r in rows])


def _packed(vectors: DataFrame) -> DataFrame:
    """(id, vec binary) of L2-normalised vectors; zero vectors have no direction and are left out."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            if len(batch):
                x = np.vstack(batch["vec"].to_numpy()).astype(np.float64)
                norm = np.sqrt((x * x).sum(axis=1))
                x = x[norm > 0] / norm[norm > 0][:, None]
                yield pd.DataFrame({"id": batch["id"].to_numpy()[norm > 0], "vec": [row.tobytes() for row in x]})

    return vectors.select("id", "vec").mapInPandas(pack, "id bigint, vec binary")


def nearest_groups(
    vectors: DataFrame,
    k: int = TOP_K,
    cutoff: float = CUTOFF,
    decimals: int = SCORE_DECIMALS,
    scale: str = "raw",
    cell_rows: int = CELL_ROWS,
    probes: int | None = None,
) -> DataFrame:
    """(qid, tid, score): best k others per row of vectors(id bigint, vec array).

    Ranked by score, then by lower tid. scale "raw" is the cosine, "unit" maps it to 0..1. Exact
    unless probes is given, which visits only that many cells besides a vector's own.
    """
    unit = scale == "unit"
    slack = 2 * 10.0**-decimals
    vectors = stage(_packed(vectors), "packed")
    count = vectors.count()
    if count == 0:
        return vectors.select(F.col("id").alias("qid"), F.col("id").alias("tid"), F.lit(0.0).alias("score"))
    pivots = _pivots(vectors, min(MAX_PIVOTS, max(1, -(-count // cell_rows))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            if len(batch):
                x = np.frombuffer(b"".join(batch["vec"]), dtype=np.float64).reshape(len(batch), -1)
                cos = np.clip(x @ pivots.T, -1.0, 1.0)
                cell = cos.argmax(axis=1)
                angle = np.arccos(cos[np.arange(len(cell)), cell])
                yield batch.assign(cell=cell.astype("int32"), angle=angle)

    celled = stage(vectors.mapInPandas(assign, "id bigint, vec binary, cell int, angle double"), "cells")
    home = _compare(celled.select("id", "cell", "vec"), celled.select("id", "cell", "vec"), k, cutoff, decimals, unit)
    if len(pivots) == 1:
        return _best(home, k)
    home = stage(home, "home")

    # At most MAX_PIVOTS rows: the radius of every cell that has members.
    cells = celled.groupBy("cell").agg(F.max("angle").alias("radius")).collect()
    held = {r["cell"]: r["radius"] for r in cells}

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        number = np.array(sorted(held))
        radius = np.array([held[c] for c in number])
        centre = pivots[number]
        for batch in batches:
            if not len(batch):
                continue
            x = np.frombuffer(b"".join(batch["vec"]), dtype=np.float64).reshape(len(batch), -1)
            angle = np.arccos(np.clip(x @ centre.T, -1.0, 1.0))
            reach = np.cos(np.clip(angle - radius[None, :], 0.0, np.pi))
            if unit:
                reach = (reach + 1.0) / 2.0
            beat = batch["beat"].to_numpy()
            go = (reach >= beat[:, None] - slack) & (number[None, :] != batch["cell"].to_numpy()[:, None])
            if probes is not None and probes < len(number):
                near = np.where(go, angle, np.inf)
                go &= near <= np.partition(near, probes - 1, axis=1)[:, probes - 1][:, None]
            yield pd.DataFrame(
                {"id": batch["id"].to_numpy(), "vec": batch["vec"], "cells": [number[row].tolist() for row in go]}
            )

    kth = home.groupBy("qid").agg(F.count("*").alias("_n"), F.min("score").alias("_s"))
    beat = kth.where(F.col("_n") >= k).select(F.col("qid").alias("id"), F.col("_s"))
    asking = celled.join(beat, "id", "left").select(
        "id", "vec", "cell", F.greatest(F.coalesce("_s", F.lit(cutoff)), F.lit(cutoff)).alias("beat")
    )
    shape = "id bigint, vec binary, cells array<int>"
    if probes is None:
        trial = asking.orderBy(F.xxhash64("id"), "id").limit(TRIAL_ROWS).mapInPandas(visit, shape)
        visited = trial.agg(F.avg(F.size("cells"))).first()[0]
        if visited * 2 > len(held) - 1:
            return _best(_compare(asking.select("id", "vec", "beat"), celled.select("id", "vec"), k, cutoff, decimals, unit, True), k)
    routed = stage(asking.mapInPandas(visit, shape), "routed")
    guests = routed.select("id", F.explode("cells").alias("cell"), "vec")
    away = _compare(guests, celled.select("id", "cell", "vec"), k, cutoff, decimals, unit)
    return _best(home.unionByName(away), k)


def nearest_of(
    vectors: DataFrame, asked: DataFrame, k: int = TOP_K, cutoff: float = CUTOFF, decimals: int = SCORE_DECIMALS, scale: str = "raw"
) -> DataFrame:
    """(qid, tid, score): the exact best k others of the asked(id) rows of vectors(id, vec), compared with all rows in blocks."""
    packed = stage(_packed(vectors), "packed")
    queries = packed.join(asked.select("id").distinct(), "id", "left_semi").select("id", "vec", F.lit(float(cutoff)).alias("beat"))
    return _best(_compare(queries, packed, k, cutoff, decimals, scale == "unit", True), k)


def _best(hits: DataFrame, k: int) -> DataFrame:
    return first_per_key(hits, ["qid"], [F.desc("score"), F.asc("tid")], k)


def expand_groups(
    membership: DataFrame, groups: DataFrame, near: DataFrame, k: int = TOP_K, cutoff: float = CUTOFF
) -> DataFrame:
    """(sourceId, targetId, score) between members, from a graph between groups.

    membership(id, key) places each row in a group of equal vectors; groups(key, grp, n) gives its
    least member id and size; near(qid, tid, score) holds the best k other groups of each, by
    those ids. The best k + 1 members around a group all lie in it or in those groups, and among the
    first k + 1 ids of each, so one short list per group serves all its members.
    """
    named = groups.select("key", "grp")
    first = first_per_key(membership, ["key"], [F.asc("id")], k + 1).join(named, "key")
    itself = groups.select(F.col("grp").alias("qid"), F.col("grp").alias("tid"), F.lit(1.0).alias("score"))
    reach = near.unionByName(itself.where(F.col("score") >= cutoff))
    listed = reach.join(first.select("grp", F.col("id").alias("targetId")), reach.tid == F.col("grp")).select(
        F.col("qid").alias("grp"), "targetId", "score"
    )
    lists = (
        first_per_key(listed, ["grp"], [F.desc("score"), F.asc("targetId")], k + 1)
        .groupBy("grp")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_s"), "targetId"))).alias("_list"))
        .join(named, "grp")
        .select("key", "_list")
    )
    hot = hot_keys(groups, "key", membership.count())
    held = split_join(membership, lists, "key", hot)
    others = F.slice(F.expr("filter(_list, e -> e.targetId != id)"), 1, k)
    return held.select(F.col("id").alias("sourceId"), F.explode(others).alias("_e")).select(
        "sourceId", F.col("_e.targetId").alias("targetId"), (-F.col("_e._s")).alias("score")
    )


def knn(
    vectors: DataFrame,
    k: int = TOP_K,
    cutoff: float = CUTOFF,
    scale: str = "raw",
    decimals: int = SCORE_DECIMALS,
    cell_rows: int = CELL_ROWS,
    probes: int | None = None,
) -> DataFrame:
    """(sourceId, targetId, score): best k per row of vectors(id bigint, embedding array)."""
    keyed = vectors.select(
        "id", F.col("embedding").cast("array<double>").alias("vec"), F.md5(F.col("embedding").cast("string")).alias("key")
    )
    keyed = stage(keyed.where(F.exists("vec", lambda x: x != 0)), "vectors")
    groups = stage(
        keyed.groupBy("key").agg(F.min("id").alias("grp"), F.count("*").alias("n"), F.first("vec").alias("vec")), "groups"
    )
    near = nearest_groups(groups.select(F.col("grp").alias("id"), "vec"), k, cutoff, decimals, scale, cell_rows, probes)
    return expand_groups(keyed.select("id", "key"), groups.drop("vec"), stage(near, "near"), k, cutoff)
