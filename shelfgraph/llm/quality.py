"""Quality rules: base counts, and hashed n-gram logistic regression trained on labelled rows.

Features are shares of hashed words, word pairs and byte n-grams within a text, so a text of any
length is one dense sum over its bytes. The regression is fitted in numpy on a bounded, hashed sample
of labelled rows; a held-back fifth of the sample calibrates the margin to a probability. Documents
are scored in Arrow batches against fixed thresholds.

Defined cases: a null or empty text has zero counts and fails the base rules (fewer than 10 words).
Repeated rows get equal results, an empty table an empty result. Without labelled rows of both kinds
every text has probability 1, so only the base rules decide. A row labelled twice takes its lowest label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm import textbytes as tb

MAX_EXAMPLES = 1500  # labelled rows of each label at most: the documented bound of the fitted sample
BITS = 16
SIZE = 1 << BITS
GRAMS = (3, 4)
FAMILIES = 2 + len(GRAMS)
SCALE = 40.0
KEEP_PROBABILITY = 0.5
MIN_WORDS = 10
MAX_REPEAT_SHARE = 20  # percent of words inside repeated five-word windows
WINDOW = 5
SYMBOLS = tb.byte_table(b"#*$%&|<>")
CODE_POINT = np.ones(256, dtype=bool)
CODE_POINT[0x80:0xC0] = False


@dataclass
class Model:
    weights: np.ndarray  # (FAMILIES, SIZE), float32
    bias: float
    slope: float
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -60, 60)))


def base_counts(data: np.ndarray, offsets: np.ndarray, words: tb.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    inside = ~tb.BLANK[data]
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": tb.sums(inside & CODE_POINT[data], offsets),
        "n_symbols": tb.sums(SYMBOLS[data], offsets),
        "n_dup_lines": _duplicate_lines(data, offsets, inside),
        "n_repeat_words": _repeated_words(words),
    }


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    # a line ends at its break, or where the next text starts
    nearest = np.append(breaks, len(data))[np.searchsorted(breaks, starts)]
    row = np.searchsorted(offsets, starts, side="right") - 1
    stops = np.minimum(nearest, offsets[row + 1])
    filled = np.append(0, np.cumsum(inside))
    worded = filled[stops] > filled[starts]
    starts, stops, row = starts[worded], stops[worded], row[worded]
    key = tb.range_hash(tb.prefix_hash(data), starts, stops) ^ tb.mix(row.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    return np.bincount(row, minlength=len(offsets) - 1) - np.bincount(row[first], minlength=len(offsets) - 1)


def _repeated_words(words: tb.Words) -> np.ndarray:
    key, index = tb.windows(words.hash, words.bounds, WINDOW)
    row = words.owner()[index]
    key = key ^ tb.mix(row.astype(np.uint64))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(words.rows, np.int64)
    twice = np.unique(twice)
    at = np.searchsorted(twice, key)
    at[at == len(twice)] = 0
    hit = index[twice[at] == key]
    step = np.zeros(len(words.hash) + 1, dtype=np.int32)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + WINDOW, -1)
    return tb.sums(np.cumsum(step[:-1]) > 0, words.bounds)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_SHARE * counts["n_words"])


def features(data: np.ndarray, offsets: np.ndarray, words: tb.Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family: feature of every occurrence, and the range of occurrences of each text."""
    shift = np.uint64(64 - BITS)
    pair, index = tb.windows(words.hash, words.bounds, 2)
    out = [
        ((words.hash >> shift).astype(np.int32), words.bounds[:-1], words.bounds[1:]),
        ((pair >> shift).astype(np.int32), np.searchsorted(index, words.bounds[:-1]), np.searchsorted(index, words.bounds[1:])),
    ]
    wide = data.astype(np.uint32)
    for n in GRAMS:
        code = wide[: max(0, len(data) - n + 1)].copy()
        for k in range(1, n):
            code = (code << np.uint32(8)) | wide[k : k + len(code)]
        code *= np.uint32(0x9E3779B1)
        out.append(((code >> np.uint32(32 - BITS)).astype(np.int32), offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - n + 1)))
    return out


def margins(model: Model, data: np.ndarray, offsets: np.ndarray, words: tb.Words) -> np.ndarray:
    total = np.full(len(offsets) - 1, model.bias)
    for weights, (feature, start, stop) in zip(model.weights, features(data, offsets, words), strict=True):
        running = np.zeros(len(feature) + 1)
        np.cumsum(weights[feature], out=running[1:], dtype=np.float64)
        start, stop = np.minimum(start, len(feature)), np.minimum(stop, len(feature))
        total += SCALE * (running[stop] - running[start]) / np.maximum(stop - start, 1)
    return total


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = tb.column(batch, "text")
        for lo, hi in tb.slices(text):
            data, offsets = tb.flat(text[lo:hi])
            words = tb.Words(data, offsets, ~tb.BLANK)
            families = features(data, offsets, words)
            keys, shares = [], []
            for i in range(hi - lo):
                key, share = [], []
                for f, (feature, start, stop) in enumerate(families):
                    found, n = np.unique(feature[start[i] : stop[i]], return_counts=True)
                    key.append(found.astype(np.int32) + f * SIZE)
                    share.append((SCALE * n / max(1, n.sum())).astype(np.float32))
                keys.append(np.concatenate(key))
                shares.append(np.concatenate(share))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], batch.column(1)[lo:hi], tb.binary(keys), tb.binary(shares)],
                names=["doc_id", "quality", "features", "shares"],
            )


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most MAX_EXAMPLES labelled rows of each label."""
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    totals = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label in (0, 1):
        part = labels.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = texts.mapInArrow(_sample_features, "doc_id long, quality int, features binary, shares binary").collect()
    rows = list({r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], r["features"]))}.values())
    y = np.array([r["quality"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((FAMILIES, SIZE), np.float32), 0.0, 0.0, 60.0)
    keys = [np.frombuffer(r["features"], np.int32) for r in rows]
    values = [np.frombuffer(r["shares"], np.float32) for r in rows]
    weight = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    held = tb.mix(np.array([r["doc_id"] for r in rows], dtype=np.int64).astype(np.uint64)) % np.uint64(5) == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    w, bias = train(keys, values, y, weight * ~held)
    margin = np.array([w[k] @ v for k, v in zip(keys, values, strict=True)]) + bias
    fold = held if held.any() else ~held
    slope, offset = platt(margin[fold], y[fold], weight[fold])
    return Model(w.reshape(FAMILIES, SIZE).astype(np.float32), float(bias), slope, offset)


def train(keys, values, y, weight, steps: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by accelerated gradient descent on sparse rows."""
    used = np.flatnonzero(weight > 0)
    row = np.repeat(np.arange(len(used)), [len(keys[i]) for i in used])
    key, value, label = np.concatenate([keys[i] for i in used]), np.concatenate([values[i] for i in used]), y[used]
    share = weight[used] / weight[used].sum()
    n = FAMILIES * SIZE
    w, bias, look, look_bias = np.zeros(n), 0.0, np.zeros(n), 0.0
    norm = np.bincount(row, value * value, minlength=len(used)).max() + 1.0
    rate = 4.0 / norm
    for step in range(steps):
        margin = np.bincount(row, look[key] * value, minlength=len(used)) + look_bias
        residual = share * (1.0 / (1.0 + np.exp(-np.clip(margin, -60, 60))) - label)
        slope = np.bincount(key, residual[row] * value, minlength=n) + ridge * look
        fresh, fresh_bias = look - rate * slope, look_bias - rate * residual.sum()
        momentum = step / (step + 3.0)
        look, look_bias = fresh + momentum * (fresh - w), fresh_bias + momentum * (fresh_bias - bias)
        w, bias = fresh, fresh_bias
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by Newton steps with smoothed targets."""
    positive, negative = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ theta, -60, 60)))
        gradient = x.T @ (weight * (p - target))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def judge(docs: DataFrame, model: Model, threshold: float = KEEP_PROBABILITY) -> DataFrame:
    """Base counts, base_failed, probability and kept of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            text = tb.column(batch, "text")
            for lo, hi in tb.slices(text):
                data, offsets = tb.flat(text[lo:hi])
                words = tb.Words(data, offsets, ~tb.BLANK)
                counts = base_counts(data, offsets, words)
                failed = base_failed(counts)
                p = m.probability(margins(m, data, offsets, words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], *(pa.array(counts[n].astype(np.int64)) for n in names), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))],
                    names=["doc_id", *names, "base_failed", "probability", "kept"],
                )

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, probability double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
