"""Secret scans: candidate strings, and a random forest that removes false positives.

A candidate is a run of at least MIN_LENGTH bytes of keys and hashes that holds a digit or changes case
inside. Its features are length, character classes and entropy, how likely its character transitions
and how well covered its letters are by the corpus (both counted over all documents), the document's
path, and the words beside it. The forest is trained on labelled findings; where none are given, a
bounded hashed sample of the candidates is labelled by `assigned_to_a_credential`, a precise but narrow
rule, and the forest extends it.

Defined cases: null and empty texts have no candidate. Repeated rows give their own findings. Without
findings of both labels the forest is empty and the rule alone decides. A missing or null path counts as
an empty one. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm import forest
from shelfgraph.llm import textbytes as tb

MIN_LENGTH = 16
MAX_FINDINGS = 6000  # labelled findings that the forest is fitted on at most
THRESHOLD = 0.5
MARK = b"[SECRET]"
BESIDE = 40  # bytes before and after a candidate that are read as its neighbours
BITS = 16
PARTS = 8

KEY_BYTES = tb.byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")
DIGIT = tb.byte_table(b"0123456789")
UPPER = tb.byte_table(bytes(range(65, 91)))
LETTER = tb.byte_table(bytes([*range(65, 91), *range(97, 123)]))

# fixed values: words of credentials, of examples, and of paths that hold examples
CREDENTIAL = re.compile(rb"(token|secret|passw(or)?d|passwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential)", re.I)
EXAMPLE = re.compile(rb"(example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|checksum|sha1|sha256|md5|commit|digest)", re.I)
EXAMPLE_PATH = re.compile(r"(test|example|sample|fixture|mock|docs?/)", re.I)
ASSIGNED = re.compile(rb"(token|secret|passw(or)?d|passwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential)\W{0,3}\s*[=:]\s*[\"']?$", re.I)


@dataclass
class Model:
    transitions: np.ndarray  # log probability of each byte pair
    covered: np.ndarray  # four-letter codes that the corpus uses
    trees: list = field(default_factory=list)


def _letter_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed codes of four letters in a row, case folded, and where they start."""
    low = tb.LOWER[data].astype(np.uint32)
    letter = LETTER[data]
    n = max(0, len(data) - 3)
    at = np.flatnonzero(letter[:n] & letter[1 : n + 1] & letter[2 : n + 2] & letter[3 : n + 3])
    code = (low[at] << np.uint32(24)) | (low[at + 1] << np.uint32(16)) | (low[at + 2] << np.uint32(8)) | low[at + 3]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), at


def corpus_statistics(docs: DataFrame) -> Model:
    """Byte transitions and letter codes over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, codes = np.zeros(1 << 16, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            text = tb.column(batch, "text")
            for lo, hi in tb.slices(text):
                data, _ = tb.flat(text[lo:hi])
                pairs += np.bincount(data[:-1].astype(np.int64) << 8 | data[1:], minlength=1 << 16)
                codes += np.bincount(_letter_codes(data)[0], minlength=1 << BITS)
        blobs = [*np.split(pairs, PARTS), *np.split(codes, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * PARTS), pa.int32()), tb.binary(blobs)], names=["part", "counts"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), np.int64) for b in group.column("counts"))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), tb.binary([total])], names=["part", "counts"])

    schema = "part int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("part").applyInArrow(merge, schema).collect()
    found = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    blank = np.zeros((1 << 16) // PARTS, np.int64)
    pairs = np.concatenate([found.get(i, blank) for i in range(PARTS)]).reshape(256, 256) + 0.5
    codes = np.concatenate([found.get(i, blank) for i in range(PARTS, 2 * PARTS)])
    transitions = np.log(pairs / pairs.sum(axis=1, keepdims=True)).astype(np.float32)
    # a code is dictionary-like if it is more than a millionth of all codes
    return Model(transitions, codes > max(2, codes.sum() * 1e-6))


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = runs_of(data, offsets, KEY_BYTES)
    start, stop = words
    long = np.flatnonzero(stop - start >= MIN_LENGTH)
    start, stop = start[long], stop[long]
    digits = np.append(0, np.cumsum(DIGIT[data]))
    turns = np.append(0, np.cumsum(np.append(UPPER[data][1:] & LETTER[data][:-1] & ~UPPER[data][:-1], False)))
    odd = (digits[stop] > digits[start]) | (turns[np.maximum(stop - 1, 0)] - turns[start] >= 2)
    return start[odd], stop[odd]


def runs_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal runs of member bytes inside one text."""
    member = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1] | edge[1:-1]
    last[:-1] &= ~member[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


FEATURES = ["length", "digits", "uppers", "letters", "entropy", "distinct", "transition", "coverage", "turns", "credential_before", "example_beside", "quoted", "assigned", "example_path", "hex", "word_before"]


def describe(model: Model, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, stop: np.ndarray, paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of each candidate, and what the labelling rule says."""
    raw = data.tobytes()
    row = np.searchsorted(offsets, start, side="right") - 1
    out = np.zeros((len(start), len(FEATURES)), np.float32)
    rule = np.zeros(len(start), bool)
    for k, (a, b) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
        own, lo, hi = data[a:b], int(offsets[row[k]]), int(offsets[row[k] + 1])
        before, after = raw[max(lo, a - BESIDE) : a], raw[b : min(hi, b + BESIDE)]
        share = np.bincount(own, minlength=256)
        share = share[share > 0] / len(own)
        kind = DIGIT[own].astype(np.int8) + 2 * LETTER[own].astype(np.int8)
        codes, _ = _letter_codes(own)
        said = bool(CREDENTIAL.search(before))
        assigned = bool(re.search(rb"[=:]\s*[\"']?$", before))
        quoted = before[-1:] in (b'"', b"'") and after[:1] == before[-1:]
        entropy = float(-(share * np.log2(share)).sum())
        words = re.findall(rb"[A-Za-z]+", before)
        out[k] = [
            len(own), DIGIT[own].mean(), UPPER[own].mean(), LETTER[own].mean(), entropy, len(share) / len(own),
            model.transitions[own[:-1], own[1:]].mean(), model.covered[codes].mean() if len(codes) else 0.0,
            (kind[1:] != kind[:-1]).mean(), said, bool(EXAMPLE.search(before) or EXAMPLE.search(after)), quoted, assigned,
            bool(EXAMPLE_PATH.search(paths[row[k]])), bool(re.fullmatch(rb"[0-9a-fA-F]+", own.tobytes())), len(words[-1]) if words else 0,
        ]
        rule[k] = assigned_to_a_credential(before, own.tobytes(), entropy)
    return out, rule


def assigned_to_a_credential(before: bytes, value: bytes, entropy: float) -> bool:
    """The labelling rule: a value of some entropy that is assigned to a name of a credential."""
    return bool(ASSIGNED.search(before)) and entropy >= 2.5 and not EXAMPLE.search(value)


def findings(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, stop (bytes), features and rule of every candidate of docs (doc_id, text, path)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, paths = tb.column(batch, "text"), tb.column(batch, "path")
            for lo, hi in tb.slices(text):
                data, offsets = tb.flat(text[lo:hi])
                start, stop = candidates(data, offsets)
                x, rule = describe(shared.value, data, offsets, start, stop, paths[lo:hi].to_pylist())
                row = np.searchsorted(offsets, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi].take(pa.array(row)), pa.array(start - offsets[row]), pa.array(stop - offsets[row]), tb.list_array(x.reshape(-1), np.full(len(x), x.shape[1]), pa.float32()), pa.array(rule)],
                    names=["doc_id", "start", "stop", "features", "rule"],
                )

    return docs.select("doc_id", "text", "path").mapInArrow(run, "doc_id long, start long, stop long, features array<float>, rule boolean")


def fit(model: Model, labelled: DataFrame) -> Model:
    """Train the forest on at most MAX_FINDINGS labelled findings (features, label), chosen by hash."""
    half = MAX_FINDINGS // 2
    rows = []
    for label in (True, False):
        part = labelled.where(F.col("label") == label).orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start", "features").limit(half)
        rows += part.select("features", "label").collect()
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(set(y.tolist())) == 2:
        model.trees = forest.fit(np.array([r["features"] for r in rows], dtype=np.float32), y)
    return model


def scores(model: Model, x: np.ndarray, rule: np.ndarray) -> np.ndarray:
    return forest.predict(model.trees, x) if model.trees else rule.astype(float)


def scan(found: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, stop, score, is_secret of every candidate."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            p = scores(shared.value, x, batch.column(4).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p), pa.array(p >= threshold)], names=["doc_id", "start", "stop", "score", "is_secret"])

    return found.mapInArrow(run, "doc_id long, start long, stop long, score double, is_secret boolean")


def with_path(docs: DataFrame) -> DataFrame:
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", path.alias("path"))


def redact(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret replaced by MARK and n_chars counted anew where a text changed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has_path, has_size = "source" in docs.columns, "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names = batch.schema.names
            text = tb.column(batch, "text")
            paths = tb.column(batch, "source") if has_path else pa.array([""] * batch.num_rows)
            changed: dict[int, str] = {}
            for lo, hi in tb.slices(text):
                data, offsets = tb.flat(text[lo:hi])
                start, stop = candidates(data, offsets)
                x, rule = describe(m, data, offsets, start, stop, paths[lo:hi].to_pylist())
                hit = np.flatnonzero(scores(m, x, rule) >= threshold)
                row = np.searchsorted(offsets, start[hit], side="right") - 1
                for i in np.unique(row).tolist():
                    at, out = int(offsets[i]), []
                    for k in hit[row == i].tolist():
                        out += [data[at : start[k]].tobytes(), MARK]
                        at = int(stop[k])
                    changed[lo + i] = b"".join([*out, data[at : offsets[i + 1]].tobytes()]).decode()
            if not changed:
                yield batch
                continue
            where = np.zeros(batch.num_rows, bool)
            where[list(changed)] = True
            columns = list(batch.columns)
            old = batch.column(names.index("text"))
            fresh = pc.replace_with_mask(old, pa.array(where), pa.array([changed[i] for i in sorted(changed)], old.type))
            columns[names.index("text")] = fresh
            if has_size:
                size = batch.column(names.index("n_chars"))
                columns[names.index("n_chars")] = pc.if_else(pa.array(where), pc.utf8_length(fresh).cast(size.type), size)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, with a forest trained on rule-labelled findings of docs, and the stored findings."""
    from shelfgraph.llm.durable import written

    model = corpus_statistics(docs)
    found = written(findings(with_path(docs), model), "findings")
    return fit(model, found.withColumn("label", F.col("rule"))), found
