"""Subword ids of whole texts with a public tokenizer file.

A byte-level vocabulary splits a text before it merges bytes, and some of those splits can be told
from two or three neighbouring bytes: before a single space between visible characters, between an
ASCII letter and an ASCII sign, digit or line break, and after a single line break. Texts are cut there,
and each distinct part is encoded by the tokenizers library once while it is remembered. What is
remembered is bounded and only saves time. Parts are known by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from shelfgraph.llm import textbytes as tb

VOCABULARY = "byte_bpe_50k.json"
MAX_PARTS = 2_000_000
SPECIAL = b"<|endoftext|>"
LETTER = tb.byte_table(bytes(range(65, 91)) + bytes(range(97, 123)))
SPACING = tb.byte_table(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")
SEEN = ~SPACING & (np.arange(256) < 128)
#: First bytes of two-byte characters among which there is no white space.
LEAD = tb.byte_table(bytes(range(0xC3, 0xE0)))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes each byte: visible Latin-1 as is, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts start."""
    n = len(data)
    here = np.zeros(n, bool)
    here[offsets[:-1][offsets[:-1] < n]] = True
    if n < 2:
        return np.flatnonzero(here)
    seen, letter, lead = SEEN[data], LETTER[data], LEAD[data]
    ends = seen.copy()
    ends[1:] |= lead[:-1]
    # a text's first byte follows nothing, so the rules must not look across the edge
    edge = np.zeros(n + 2, bool)
    edge[offsets] = True
    space = data == 32
    here[1:-1] |= space[1:-1] & ends[:-2] & (seen[2:] | lead[2:]) & ~edge[2:n]
    here[1:] |= letter[:-1] & ~letter[1:] & ((seen[1:]) | (data[1:] == 10))
    here[2:] |= (data[1:-1] == 10) & ends[:-2] & (seen[2:] | lead[2:]) & ~edge[1 : n - 1]
    return np.flatnonzero(here)


class Encoder:
    """Encodes texts, as flat bytes, to ids; one per worker."""

    def __init__(self, name: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each text in them."""
        raw = data.tobytes()
        if SPECIAL in raw:
            return self._whole(raw, offsets)
        start = cuts(data, offsets)
        stop = np.append(start[1:], len(data))
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        key = tb.range_hash(tb.prefix_hash(data), start, stop)
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > MAX_PARTS:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        fresh = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(fresh):
            self._learn(distinct[fresh], [raw[a:b] for a, b in zip(start[first[fresh]].tolist(), stop[first[fresh]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        size = self.size[at][inverse]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.place[at][inverse] - ends + size, size) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(start, offsets)]

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        found: list[list[int]] = []
        hard: list[int] = []
        letters = byte_letters()
        for i, part in enumerate(parts):
            text = part.decode()
            if (text[1:] if text[0] == " " else text).isalpha():
                # one run of letters, with or without its space, is one word of the vocabulary's splits
                found.append([t.id for t in self.model.tokenize(part.decode("latin1").translate(letters))])
            else:
                hard.append(i)
                found.append([])
        for i, e in zip(hard, self.tokenizer.encode_batch_fast([parts[i].decode() for i in hard], add_special_tokens=False), strict=True):
            found[i] = e.ids
        size = np.array([len(x) for x in found], np.int64)
        while self.used + size.sum() > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        place = self.used + np.cumsum(size) - size
        self.pool[self.used : self.used + size.sum()] = [i for ids in found for i in ids]
        self.used += int(size.sum())
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place, self.size = np.insert(self.keys, at, keys), np.insert(self.place, at, place), np.insert(self.size, at, size)

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without cuts, where the text spells a special token."""
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if SPECIAL in raw[a:b]:
                out.append(np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32))
            else:
                out.append(self.encode(np.frombuffer(raw[a:b], np.uint8), np.array([0, b - a], np.int64))[0])
        return np.concatenate([*out, np.zeros(0, np.uint32)]), np.append(0, np.cumsum([len(x) for x in out])).astype(np.int64)
