import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfgraph.llm import textbytes as tb
from shelfgraph.llm.subwords import Encoder

ALPHABET = ["a", "B", " ", "\n", "'", "s", "é", "É", "1", ".", "\t", " ", "中", "'ll", "<|endoftext|>", " the", "\x1c", "\r\n", "½", "́", "　"]
_encoder = []


def encoder():
    if not _encoder:
        _encoder.append(Encoder())
    return _encoder[0]


def test_words_follow_the_delimiters_and_never_cross_texts():
    texts = ["ab cd", "ef", "", None, " \tgh\x0bij ", "k"]
    array = tb.column(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), "text")
    data, offsets = tb.flat(array)
    words = tb.Words(data, offsets, ~tb.BLANK)
    raw = data.tobytes()
    found = [[raw[a:b].decode() for a, b in zip(words.start[lo:hi], words.stop[lo:hi], strict=True)] for lo, hi in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    assert found == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    data, offsets = tb.flat(pa.array(["same other same", "x same"]))
    h = tb.Words(data, offsets, ~tb.BLANK).hash
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3


def test_slices_cover_all_rows_and_keep_a_long_text_whole():
    array = pa.array(["a" * 10, "b" * 100, "", "c"])
    assert list(tb.slices(array, 20)) == [(0, 1), (1, 2), (2, 4)]


def test_windows_stay_inside_a_text():
    data, offsets = tb.flat(pa.array(["a b c", "d e f g"]))
    words = tb.Words(data, offsets, ~tb.BLANK)
    _, index = tb.windows(words.hash, words.bounds, 3)
    assert index.tolist() == [0, 3, 4]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join), min_size=1, max_size=6))
def test_parts_encode_like_whole_texts(texts):
    e = encoder()
    ids, bounds = e.encode(*tb.flat(pa.array(texts, pa.string())))
    got = [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))]
    assert got == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_parts_changes_nothing():
    from shelfgraph.llm import subwords

    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET[:12]) for _ in range(60)) for _ in range(50)]
    array = pa.array(texts)
    whole, _ = encoder().encode(*tb.flat(array))
    kept, subwords.MAX_PARTS = subwords.MAX_PARTS, 20
    try:
        small = Encoder()
        again = np.concatenate([small.encode(*tb.flat(array[i : i + 5]))[0] for i in range(0, 50, 5)])
    finally:
        subwords.MAX_PARTS = kept
    assert again.tolist() == whole.tolist()
