"""Language identification as mixture inference.

Every language is a distribution over hashed byte n-grams, counted over all learnable documents. A
document is a mixture: each of its words is drawn from one of the languages. Expectation-maximisation
estimates the proportions from the word likelihoods; nested sets of the strongest languages are
compared by penalised likelihood, and the main language of the best set is the prediction.

Defined cases: a null text or one without a letter is `und` with score 0; so is every text when no
language was learnt. Null languages teach nothing. Ties go to the first language by name. Repeated rows
get equal results, an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm import textbytes as tb

BITS = 16
SIZE = 1 << BITS
GRAMS = (3, 4)
PARTS = 16  # a task's counts of one language travel in this many pieces
SMOOTHING = 0.5
TEMPER = 0.4  # overlapping n-grams repeat evidence
STEPS = 25
TOLERANCE = 2e-3
PENALTY = 1.0  # times half the logarithm of the word count, for each further language
UNKNOWN = "und"
#: Languages that one model holds at most, so that it can be shared with every task.
MAX_LANGUAGES = 256


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (len(GRAMS) * SIZE, languages), float32 log probabilities


def gram_codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts with all but letters blanked, and offsets; then n-gram codes.

    Row g of the codes holds the n-gram of GRAMS[g] bytes that starts at each byte.
    """
    data, offsets = tb.flat(pc.utf8_lower(text))
    letters = tb.LETTERED.copy()
    letters[48:58] = False
    plain = np.where(letters[data], data, np.uint8(32))
    padded = np.concatenate([plain, np.full(max(GRAMS), 32, np.uint8)]).astype(np.uint32)
    codes = np.empty((len(GRAMS), len(plain)), np.int32)
    for g, n in enumerate(GRAMS):
        code = padded[: len(plain)].copy()
        for k in range(1, n):
            code = (code << np.uint32(8)) | padded[k : k + len(plain)]
        codes[g] = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32) + g * SIZE
    return plain, offsets, codes


def fit(docs: DataFrame) -> Model:
    """Count n-grams of every language over all rows of docs (lang, text) and smooth them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            text, langs = tb.column(batch, "text"), batch.column(batch.schema.get_field_index("lang"))
            for lo, hi in tb.slices(text):
                plain, offsets, codes = gram_codes(text[lo:hi])
                found = langs[lo:hi].dictionary_encode()
                kind = np.repeat(found.indices.to_numpy(zero_copy_only=False), np.diff(offsets))
                filled = plain != 32
                for i, name in enumerate(found.dictionary.to_pylist()):
                    total = totals.setdefault(name, np.zeros(len(GRAMS) * SIZE, np.int64))
                    own = filled & (kind == i)
                    for row in codes:
                        total += np.bincount(row[own], minlength=len(total))
        for name, total in totals.items():
            pieces = np.split(total, PARTS)
            yield pa.RecordBatch.from_arrays([pa.array([name] * PARTS), pa.array(range(PARTS), pa.int32()), tb.binary(pieces)], names=["lang", "part", "counts"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(len(GRAMS) * SIZE // PARTS, np.int64)
        for blob in group.column("counts"):
            total += np.frombuffer(blob.as_buffer(), np.int64)
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), tb.binary([total])], names=["lang", "part", "counts"])

    schema = "lang string, part int, counts binary"
    partial = docs.where(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(count, schema)
    rows = partial.groupBy("lang", "part").applyInArrow(merge, schema).collect()
    names = sorted({r["lang"] for r in rows})
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; a model holds at most {MAX_LANGUAGES}")
    table = np.zeros((len(GRAMS) * SIZE, len(names)), np.float32)
    for j, name in enumerate(names):
        pieces = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in rows if r["lang"] == name}
        counts = np.concatenate([pieces[k] for k in range(PARTS)]).reshape(len(GRAMS), SIZE) + SMOOTHING
        table[:, j] = (np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))).reshape(-1)
    return Model(names, table)


def word_likelihoods(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages) likelihoods up to a factor per word, and the word range of each text."""
    plain, offsets, codes = gram_codes(text)
    running = np.zeros((len(plain) + 1, len(model.languages)), np.float64)
    per_byte = model.table[codes[0]]
    for row in codes[1:]:
        per_byte = per_byte + model.table[row]
    np.cumsum(per_byte, axis=0, out=running[1:])
    filled = np.zeros(len(plain), bool)
    filled[:] = plain != 32
    edge = np.zeros(len(plain) + 1, bool)
    edge[offsets] = True
    before, after = np.append(False, filled[:-1]) if len(plain) else filled, np.append(filled[1:], False) if len(plain) else filled
    start = np.flatnonzero(filled & (~before | edge[:-1]))
    stop = np.flatnonzero(filled & (~after | edge[1:])) + 1
    log = TEMPER * (running[stop] - running[start])
    log -= log.max(axis=1, keepdims=True) if len(log) else 0
    return np.exp(log), np.searchsorted(start, offsets)


def proportions(lik: np.ndarray, bounds: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM: shares of the allowed languages in each text and the log likelihood.

    allowed: (texts, languages) boolean. Texts leave the iteration as they converge.
    """
    n = np.diff(bounds)
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    total = np.zeros(len(n))
    active = np.flatnonzero(n > 0)
    words, edges = lik, bounds
    for step in range(STEPS):
        if not len(active):
            break
        count = n[active]
        if step and len(active) < len(edges) - 1:
            words = np.concatenate([lik[bounds[i] : bounds[i + 1]] for i in active])
        edges = np.append(0, np.cumsum(count))
        if step == 0:
            words = lik
        joint = words * np.repeat(share[active], count, axis=0)
        whole = np.maximum(joint.sum(axis=1), 1e-300)
        total[active] = tb.sums(np.log(whole), edges)
        fresh = tb.sums(joint / whole[:, None], edges) / count[:, None]
        moved = np.abs(fresh - share[active]).max(axis=1)
        share[active] = fresh
        active = active[moved > TOLERANCE]
    return share, total


def identify(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the chosen languages of each text, and whether it has a letter and any language is known."""
    known = pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False).astype(bool) if len(model.languages) else np.zeros(len(text), bool)
    if not len(model.languages):
        return np.zeros((len(text), 0)), known
    lik, bounds = word_likelihoods(model, text)
    n = np.diff(bounds)
    size = len(model.languages)
    full, loglik = proportions(lik, bounds, np.ones((len(text), size), bool))
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    cost = PENALTY * 0.5 * np.log(np.maximum(n, 2))
    alone = np.log(np.maximum(lik[np.arange(len(lik)), np.repeat(order[:, 0], n)], 1e-300)) if len(lik) else np.zeros(0)
    best, chosen = tb.sums(alone, bounds), (rank == 0).astype(float)
    for k in range(2, size + 1):
        # a language below a hundredth of the words cannot pay for itself
        worth = np.flatnonzero(full[np.arange(len(text)), order[:, k - 1]] > 0.01)
        if not len(worth):
            break
        if k == size:
            share, value = full[worth], loglik[worth]
        else:
            part = np.concatenate([lik[bounds[i] : bounds[i + 1]] for i in worth])
            share, value = proportions(part, np.append(0, np.cumsum(n[worth])), rank[worth] < k)
        value = value - cost[worth] * (k - 1)
        wins = value > best[worth] + 1e-9
        best[worth[wins]], chosen[worth[wins]] = value[wins], share[wins]
    return chosen, known & (n > 0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of that language), languages and shares of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            text = tb.column(batch, "text")
            for lo, hi in tb.slices(text):
                share, known = identify(m, text[lo:hi])
                top = share.argmax(axis=1) if share.shape[1] else np.zeros(hi - lo, np.int64)
                score = np.where(known, share[np.arange(hi - lo), top], 0.0) if share.shape[1] else np.zeros(hi - lo)
                top = np.where(known, top, len(m.languages))
                present = (share > 0.005) & known[:, None]
                order = np.argsort(-share, axis=1, kind="stable")
                kept = np.take_along_axis(present, order, axis=1)
                counts = kept.sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi],
                        pa.array(names[top], pa.string()),
                        pa.array(np.clip(score, 0, 1)),
                        tb.list_array(names[order[kept]], counts, pa.string()),
                        tb.list_array(np.take_along_axis(share, order, axis=1)[kept], counts, pa.float64()),
                    ],
                    names=["doc_id", "lang_pred", "score", "languages", "shares"],
                )

    schema = "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
