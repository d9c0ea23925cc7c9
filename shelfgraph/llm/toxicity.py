"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Labelled texts are TF-IDF vectors over all their words. A word that stands in one kind of example more often than chance
allows weighs more, so that a few such words decide between texts that share much else; every other word keeps its
inverse document frequency. The vectors are filed in a block-max inverted index:
postings in example order, and for the terms that many examples hold blocks of examples with the largest
weight of every (term, block). A query sums the short postings of the rarer terms, bounds each block by that
and the block maxima, and opens blocks from the highest bound down until no unopened block can reach the k-th
best, so the neighbours are exact. Texts are searched together, so that an opened block is a matrix product.
The neighbours' distance-weighted vote is calibrated on leave-one-out votes of the examples.

Defined cases: null and empty texts, and texts without a known term, have no neighbour and score as
the share of toxic examples among those without a term. Equal cosines rank by example id. Repeated
rows score alike. An empty document table gives an empty result; without labelled rows of both kinds
every score is the base rate (0 without labels) and nothing is predicted toxic.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm import textbytes as tb

MAX_EXAMPLES = 2000  # labelled rows of each label at most: the documented bound of the fitted sample
PRIOR = 0.05  # weight in every vote of the share of toxic examples
UNLIKE = 0.05  # weight of texts like no example in the calibration
BLOCK = 64
COMMON = 512  # terms at most that are filed in blocks
COMMON_SHARE = 16  # such a term stands in one of so many examples at least; for rarer ones postings cost less
FIRST = 8  # blocks that every search opens
TOGETHER = 64  # searches at once
THRESHOLD = 0.7
CHANCE = 3.0  # standard errors up to which a word's counts in the two kinds of examples may differ by chance


@dataclass
class Model:
    terms: np.ndarray  # sorted word hashes
    idf: np.ndarray  # times the marking weight
    base: float  # score of a text without any term
    share: float  # of toxic examples
    example: np.ndarray  # ids, in index order
    toxic: np.ndarray
    posting_bounds: np.ndarray  # (terms, 2) into the two arrays below
    posting_example: np.ndarray
    posting_weight: np.ndarray
    knots: np.ndarray  # calibration: vote -> probability, by interpolation
    levels: np.ndarray

    def seen(self) -> np.ndarray:
        bits = np.zeros(1 << 16, dtype=bool)
        bits[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True
        return bits


def term_counts(words: tb.Words, terms: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the known terms of each row, by row then term."""
    near = np.flatnonzero(seen[(words.hash & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.searchsorted(terms, words.hash[near])
    at[at == len(terms)] = 0
    hit = terms[at] == words.hash[near] if len(terms) else np.zeros(len(near), bool)
    row = np.searchsorted(words.bounds, near[hit], side="right") - 1
    pairs, counts = np.unique(row * max(len(terms), 1) + at[hit], return_counts=True)
    return pairs // max(len(terms), 1), pairs % max(len(terms), 1), counts


def unit_vectors(rows, terms, counts, idf, n):
    weight = (1.0 + np.log(counts)) * idf[terms]
    norm = np.sqrt(np.bincount(rows, weight * weight, minlength=n))
    return weight / np.where(norm[rows] > 0, norm[rows], 1.0)


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = tb.column(batch, "text")
        for lo, hi in tb.slices(text):
            words = tb.Words(*tb.flat(text[lo:hi]), tb.LETTERED, fold=True)
            key, counts = [], []
            for i in range(hi - lo):
                h, c = np.unique(words.hash[words.bounds[i] : words.bounds[i + 1]], return_counts=True)
                key.append(h)
                counts.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], batch.column(1)[lo:hi], tb.binary(key), tb.binary(counts)],
                names=["doc_id", "toxic", "terms", "counts"],
            )


def fit(docs: DataFrame, labels: DataFrame, may_learn=None) -> Model:
    """Fit on at most MAX_EXAMPLES rows of each label; word frequencies come from all documents.

    may_learn: condition on doc_id that a labelled row must meet to be learnt from.
    """
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if may_learn is not None:
        labels = labels.where(may_learn)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = labels.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    rows = texts.mapInArrow(_example_terms, "doc_id long, toxic int, terms binary, counts binary").collect()
    rows = list({r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], r["terms"], r["counts"]))}.values())
    y = np.array([r["toxic"] for r in rows], dtype=np.int64)
    weight = np.array([totals.get(0, 0) / max(1, (y == 0).sum()), totals.get(1, 0) / max(1, (y == 1).sum())])
    if len(set(y.tolist())) < 2:
        return _blank(float(y.mean()) if len(y) else 0.0)
    keys = [np.frombuffer(r["terms"], np.uint64) for r in rows]
    terms = np.unique(np.concatenate(keys))
    idf = document_frequency(docs, terms) * marking(keys, y, terms)
    return _index(rows, keys, y, weight, terms, idf)


def _blank(base: float) -> Model:
    none = np.zeros(0)
    return Model(none.astype(np.uint64), none, min(base, 0.5), base, none.astype(np.int64), none.astype(np.int64), np.zeros((0, 2), np.int64), none.astype(np.int32), none, np.array([0.0, 1.0]), np.array([0.0, 1.0]))


def document_frequency(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Inverse document frequency of the terms, counted over all documents."""
    seen = np.zeros(1 << 16, dtype=bool)
    seen[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            text = tb.column(batch, "text")
            n += len(text)
            for lo, hi in tb.slices(text):
                _, term, _ = term_counts(tb.Words(*tb.flat(text[lo:hi]), tb.LETTERED, fold=True), terms, seen)
                df += np.bincount(term, minlength=len(terms))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["term", "n"])

    # as two arrays: a row object for each term weighs on the driver
    found = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (found.column(name).to_numpy() for name in ("term", "n"))
    df = np.zeros(len(terms))
    df[term[term >= 0]] = n[term >= 0]
    return np.log1p(n[term < 0].sum() / (1.0 + df))


def marking(keys: list[np.ndarray], y: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """How much more each term weighs for standing in one kind of example: 1, if that may be chance.

    The root of the log-likelihood ratio counts as standard errors; copies of an example count once.
    """
    held, n, known = np.zeros((2, len(terms))), np.zeros((2, 1)), set()
    for key, label in zip(keys, y.tolist(), strict=True):
        copy = label, hashlib.blake2b(key.tobytes(), digest_size=16).digest()
        if copy not in known:
            known.add(copy)
            held[label, np.searchsorted(terms, key)] += 1
            n[label] += 1
    share = held.sum(axis=0) / n.sum()
    ratio = np.zeros(len(terms))
    for count, part in ((held, share), (n - held, 1.0 - share)):
        at = np.nonzero(count)
        np.add.at(ratio, at[1], count[at] * np.log(count[at] / (n * part)[at]))
    return (1.0 + np.maximum(np.sqrt(np.maximum(2.0 * ratio, 0.0)) - CHANCE, 0.0)) ** 2


def _index(rows, keys, y, weight, terms, idf) -> Model:
    row_of, term_of, count_of = [], [], []
    for i, (r, k) in enumerate(zip(rows, keys, strict=True)):
        at = np.searchsorted(terms, k)
        at[at == len(terms)] = 0
        hit = np.flatnonzero(terms[at] == k) if len(terms) else np.zeros(0, np.int64)
        row_of.append(np.full(len(hit), i, np.int32))
        term_of.append(at[hit].astype(np.int32))
        count_of.append(np.frombuffer(r["counts"], np.int32)[hit])
    row, term, count = (np.concatenate(x) for x in (row_of, term_of, count_of))
    del row_of, term_of, count_of
    ids = np.array([r["doc_id"] for r in rows], dtype=np.int64)
    value = unit_vectors(row, term, count, idf, len(rows))
    del count
    filed = np.unique(row)
    bare = np.setdiff1d(np.arange(len(rows)), filed)
    base = float((weight[y[bare]] * y[bare]).sum() / max(weight[y[bare]].sum(), 1e-9)) if len(bare) else 0.0
    # examples with the same strongest term stand together, so block maxima are tight
    lead = np.zeros(len(rows), np.int64)
    order = np.lexsort((value, row))
    lead[row[order]] = term[order]
    sequence = filed[np.lexsort((ids[filed], lead[filed]))]
    place = np.zeros(len(rows), np.int64)
    place[sequence] = np.arange(len(sequence))
    order = np.lexsort((place[row], term))
    edges = np.searchsorted(term[order], np.arange(len(terms) + 1))
    ranges = np.stack([edges[:-1], edges[1:]], axis=1)
    share = float((weight[y] * y).sum() / weight[y].sum())
    model = Model(terms, idf, base, share, ids[sequence], y[sequence], ranges, place[row][order].astype(np.int32), value[order], np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    del order
    votes = np.zeros(len(sequence))
    lo, hi = (np.searchsorted(row, sequence, side=side) for side in ("left", "right"))
    common = Common(model)
    for at in range(0, len(sequence), TOGETHER):
        own = slice(at, at + TOGETHER)
        places, _ = _ranges(lo[own], hi[own])
        bounds = np.append(0, np.cumsum(hi[own] - lo[own]))
        found = nearest_each(model, common, bounds, term[places], value[places], skip=np.arange(len(sequence))[own])
        votes[own] = [vote(model, near, cosine) for near, cosine in found]
    model.knots, model.levels = calibrate(votes, y[sequence], weight[y[sequence]], share)
    return model


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo:hi in turn, and the range of each."""
    count = hi - lo
    of = np.repeat(np.arange(len(lo)), count)
    return np.arange(len(of)) - (np.cumsum(count) - count - lo)[of], of


class Common:
    """The terms that the most examples hold, by block: their weights in every example, and their block maxima."""

    def __init__(self, model: Model):
        self.blocks = -(-len(model.example) // BLOCK)
        held = model.posting_bounds[:, 1] - model.posting_bounds[:, 0]
        often = np.argsort(-held, kind="stable")[:COMMON]
        often = often[held[often] * COMMON_SHARE >= max(1, len(model.example))]
        self.line = np.full(len(model.terms), -1)
        self.line[often] = np.arange(len(often))
        posting, of = _ranges(model.posting_bounds[often, 0], model.posting_bounds[often, 1])
        block, place = np.divmod(model.posting_example[posting], BLOCK)
        self.weight = np.zeros((self.blocks, len(often), BLOCK))
        self.weight[block, of, place] = model.posting_weight[posting]
        self.top = self.weight.max(axis=2, initial=0.0).T.copy()


def nearest(model: Model, terms: np.ndarray, weights: np.ndarray, k: int | None = None, skip: int = -1):
    """The k examples (the root of their number, if k is not given) of greatest cosine with the query, ties by example id; exact."""
    return next(nearest_each(model, Common(model), np.array([0, len(terms)]), terms, weights, k, np.array([skip])))


def nearest_each(model: Model, common: Common, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int | None = None, skip: np.ndarray | None = None):
    """nearest() of several queries, whose terms and weights lie between the bounds; skip: an example that each leaves out, or -1."""
    k = k or max(1, math.isqrt(len(model.example)))
    for lo in range(0, len(bounds) - 1, TOGETHER):
        part = bounds[lo : lo + TOGETHER + 1]
        own = slice(part[0], part[-1])
        yield from _nearest_together(model, common, part - part[0], terms[own], weights[own], k, None if skip is None else skip[lo : lo + TOGETHER])


def _nearest_together(model, common, bounds, terms, weights, k, skip):
    n, blocks, width = len(bounds) - 1, common.blocks, common.blocks * BLOCK
    query = np.repeat(np.arange(n), np.diff(bounds))
    line = common.line[terms]
    often, rare = np.flatnonzero(line >= 0), np.flatnonzero(line < 0)
    share = np.zeros((n, common.top.shape[0]))
    share[query[often], line[often]] = weights[often]
    posting, of = _ranges(model.posting_bounds[terms[rare], 0], model.posting_bounds[terms[rare], 1])
    at = (query[rare] * width)[of] + model.posting_example[posting]
    score = np.bincount(at, weights[rare][of] * model.posting_weight[posting], minlength=n * width).astype(float, copy=False).reshape(n, blocks, BLOCK)
    bound = score.max(axis=2) + share @ common.top
    # the blocks of the highest bounds first; then all that can still reach the k-th best
    able = bound > 0
    if blocks > FIRST:
        able &= bound >= np.partition(bound, blocks - FIRST, axis=1)[:, [blocks - FIRST]]
    _open(common, able, share, score, skip)
    rest = ~able & (bound > 0) & (bound >= _kth(score, k)[:, None] - 1e-9)
    _open(common, rest, share, score, skip)
    # scores are ranked on nine decimals; what lies clearly below the k-th best can't stay
    at, place = np.nonzero(score.reshape(n, width) > np.maximum(_kth(score, k) - 2e-9, 0.0)[:, None])
    value = np.round(score.reshape(n, width)[at, place], 9)
    order = np.lexsort((model.example[place], -value, at))
    for a, b in itertools.pairwise(np.searchsorted(at, np.arange(n + 1))):
        best = order[a : min(b, a + k)]
        yield place[best], value[best]


def _kth(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest score of each query, 0 if it has fewer; scores only rise as blocks are opened."""
    flat = score.reshape(len(score), -1)
    below = flat.shape[1] - k
    return np.partition(flat, below, axis=1)[:, below] if below >= 0 else np.zeros(len(score))


def _open(common: Common, fresh: np.ndarray, share: np.ndarray, score: np.ndarray, skip: np.ndarray | None) -> None:
    """Adds what the common terms bring to the scores of the opened blocks (queries, blocks)."""
    for block in np.flatnonzero(fresh.any(axis=0)):
        who = np.flatnonzero(fresh[:, block])
        score[who, block] += share[who] @ common.weight[block]
    if skip is not None:
        who = np.flatnonzero(skip >= 0)
        score[who, skip[who] // BLOCK, skip[who] % BLOCK] = 0.0


def vote(model: Model, near: np.ndarray, cosine: np.ndarray) -> float:
    """Share of toxic neighbours, weighted by the cosine, so that far ones count for little beside a near one.

    The share of toxic examples votes with a fixed weight: with far neighbours only, a vote stays near it.
    """
    if not len(near):
        return model.base
    w = np.minimum(cosine, 1.0)
    return float((PRIOR * model.share + (w * model.toxic[near]).sum()) / (PRIOR + w.sum()))


def calibrate(votes: np.ndarray, y: np.ndarray, weight: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the label on the vote, as interpolation knots; levels never fall as the vote rises.

    A text that is like no example has the share of toxic examples as its vote, and should score so: that point stands beside
    the examples with UNLIKE of their weight.
    """
    votes, y, weight = np.append(votes, share), np.append(y, share), np.append(weight, UNLIKE * weight.sum())
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, label, w in zip(votes[order], y[order], weight[order], strict=True):
        pools.append([v * w, label * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top, strict=True)]
    # one pseudo-count of either label keeps the levels off 0 and 1; it moves small pools most, so order is restored after it
    knots = np.array([p[0] / p[2] for p in pools])
    return knots, np.maximum.accumulate(np.array([(p[1] + 0.5) / (p[2] + 1.0) for p in pools]))


def scores_of(model: Model, common: Common, text: pa.Array, seen: np.ndarray, known: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Score and nearest example ids of each text; equal vectors are searched once per task."""
    out, evidence = np.full(len(text), model.base), [np.zeros(0, np.int64)] * len(text)
    for lo, hi in tb.slices(text):
        row, term, count = term_counts(tb.Words(*tb.flat(text[lo:hi]), tb.LETTERED, fold=True), model.terms, seen)
        value = unit_vectors(row, term, count, model.idf, hi - lo)
        edges = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
        keys = [hashlib.blake2b(term[a:b].tobytes() + count[a:b].tobytes(), digest_size=16).digest() for a, b in itertools.pairwise(edges)]
        if len(known) > 20_000:
            known.clear()
        fresh = {key: i for i, key in enumerate(keys) if key not in known}
        first = np.array(list(fresh.values()), np.int64)
        places, _ = _ranges(edges[first], edges[first + 1])
        bounds = np.append(0, np.cumsum(edges[first + 1] - edges[first]))
        for key, (near, cosine) in zip(fresh, nearest_each(model, common, bounds, term[places], value[places]), strict=True):
            level = float(np.interp(vote(model, near, cosine), model.knots, model.levels)) if len(near) else model.base
            known[key] = level, model.example[near[:3]]
        for key, a in zip(keys, edges):
            out[lo + row[a]], evidence[lo + row[a]] = known[key]
    return np.clip(out, 0.0, 1.0), evidence


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), evidence (ids of the nearest examples) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        common, seen, known = Common(m), m.seen(), {}
        for batch in batches:
            s, e = scores_of(m, common, tb.column(batch, "text"), seen, known)
            near = tb.list_array(np.concatenate([*e, np.zeros(0, np.int64)]), np.array([len(x) for x in e], np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), near], names=["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence array<long>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        common, seen, known = Common(m), m.seen(), {}
        for batch in batches:
            s, _ = scores_of(m, common, tb.column(batch, "text"), seen, known)
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
