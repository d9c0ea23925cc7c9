import hashlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfgraph.llm import repeats, suffixes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=25), min_size=1, max_size=10), st.integers(1, 30))
def test_suffix_ranks_and_common_prefixes(strings, blocks):
    kept, suffixes.BLOCKS = suffixes.BLOCKS, blocks
    try:
        data = np.frombuffer("".join(strings).encode(), np.uint8)
        text, _ = suffixes.join_strings(data, np.array([len(s) for s in strings]))
        rank = suffixes.ranks(text)
    finally:
        suffixes.BLOCKS = kept
    plain = text.tolist()
    order = sorted(range(len(plain)), key=lambda i: plain[i:])
    suffix = np.empty(len(plain), np.int64)
    suffix[rank] = np.arange(len(plain))
    assert suffix.tolist() == order
    shared = suffixes.common_prefixes(text, rank, suffix)
    for before, at in zip(order[:-1], order[1:], strict=True):
        n = 0
        while max(before, at) + n < len(plain) and plain[before + n] == plain[at + n]:
            n += 1
        assert shared[at] == n


def brute(rows, length):
    first: dict[bytes, int] = {}
    big = repeats.NO_ID
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            key = raw[i : i + length]
            first[key] = min(first.get(key, big), big if doc is None else doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (big if doc is None else doc):
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_removed_bytes_equal_brute_force(spark, documents, prose, awkward, seed):
    base = [prose(seed * 100 + i, 60) for i in range(6)]
    rows = list(awkward) + [(20 + i, t) for i, t in enumerate(base)]
    rows += [(40 + i, base[i % 6][: 200 + 7 * i] + " " + prose(900 + i, 20) + base[(i + 1) % 6][30 * i :]) for i in range(12)]
    rows += [(70 + i, "a common passage that is rather longer than fifty bytes, " + prose(800 + i, 15)) for i in range(20)]
    rows += [(95, "ab" * 400), (96, "ba" * 300), (97, "Ther " * 200), (98, "xTher " + "Ther " * 150)]
    got = repeats.remove(documents(rows).repartition(5)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, repeats.LENGTH)


def test_strings_alone_under_their_seed_are_answered_without_being_sorted(monkeypatch):
    """Two flushes; seed 5 has one string (with windows that repeat), seed 7 has two that share windows."""
    alone, left, right = b"ab" * 8, b"0123456789xy", b"z0123456789x"
    sent = [([5, 7], [30, 10], [alone, left]), ([5, 7], [20, 4], [alone, right])]
    rows = [
        {"part": part, "shard": 0, "seeds": np.array(seeds, np.uint64).tobytes(), "docs": np.array(docs, np.int64).tobytes(), "lengths": np.array([len(t) for t in texts], "<u2").tobytes(), "bytes": b"".join(texts)}
        for part, (seeds, docs, texts) in enumerate(sent)
    ]
    sorted_strings, plain = [], repeats.smallest_documents
    monkeypatch.setattr(repeats, "smallest_documents", lambda texts, docs, length: sorted_strings.extend(texts) or plain(texts, docs, length))
    got = {r["part"]: np.frombuffer(zstandard.ZstdDecompressor().decompress(r["least"]), np.int64).tolist() for r in repeats._shard(pa.Table.from_pylist(rows), 10).to_pylist()}
    assert sorted_strings == [left, right]
    assert got == {0: [20] * 7 + [4, 4, 10], 1: [20] * 7 + [4, 4, 4]}


def test_empty_table(spark, documents):
    assert repeats.remove(documents([])).count() == 0
