"""Vectorised hashing of words and word windows over Arrow string arrays.

A word is a maximal run of bytes other than ASCII white space; UTF-8 never uses those bytes inside a
character, so bytes and code points give the same words. Hashes are polynomial prefix sums modulo 2**64
over random byte values, finished with a mixer; everything is numpy over a slice of texts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SLICE_BYTES = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            self.up, self.down = (np.concatenate([np.ones(1, dtype=U), np.cumprod(np.full(size - 1, b, dtype=U))]) for b in (self.base, self.inverse))
        return self.up, self.down


class Hasher:
    """Word and window hashes for one seed; ``lower`` folds A-Z to a-z."""

    def __init__(self, seed: int, lower: bool = False):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
        if lower:
            self.values[65:91] = self.values[97:123]
        self.by_byte = _Powers(int(rng.integers(1 << 40, 1 << 62)) | 1)
        self.by_word = _Powers(int(rng.integers(1 << 40, 1 << 62)) | 1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each ``data[start:end]``, taken in pieces of about a slice so that memory stays bounded."""
        out = np.empty(len(starts), dtype=U)
        at = 0
        while at < len(starts):
            base = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
            s, e = starts[at:to] - base, ends[at:to] - base
            up, down = self.by_byte.get(int(e[-1]) + 1)
            sums = np.zeros(int(e[-1]) + 1, dtype=U)
            np.cumsum(self.values[data[base : base + int(e[-1])]] * up[: int(e[-1])], out=sums[1:])
            out[at:to] = _mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0x9E3779B97F4A7C15))
            at = to
        return out

    def windows(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of every ``k`` consecutive words; those that span two texts are for the caller to leave out."""
        n = len(words)
        if n < k:
            return np.empty(0, dtype=U)
        up, down = self.by_word.get(n + 1)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(words * up[:n], out=sums[1:])
        return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])

    def whole(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Hash of the word sequence of each text."""
        up, down = self.by_word.get(len(words) + 1)
        sums = np.zeros(len(words) + 1, dtype=U)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return _mix((sums[bounds[1:]] - sums[bounds[:-1]]) * down[bounds[:-1]] + np.diff(bounds).astype(U))


class Slice:
    """Consecutive rows of a batch: ``words`` of text ``d`` are at ``bounds[d]:bounds[d + 1]``."""

    def __init__(self, texts: pa.Array, first: int):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        self.first, self.n = first, n
        self.data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.empty(0, dtype=np.uint8)
        self.offsets = offsets - offsets[0]
        solid = ~_SPACE[self.data]
        size = len(solid)
        opens, closes = np.ones(size, dtype=bool), np.ones(size, dtype=bool)
        opens[1:] = ~solid[:-1]
        closes[:-1] = ~solid[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < size)]
        opens[inner] = True
        closes[inner - 1] = True
        self.starts = np.flatnonzero(solid & opens)
        self.ends = np.flatnonzero(solid & closes) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def inside(self, k: int) -> np.ndarray:
        """Which windows of ``k`` words lie within one text."""
        owner = self.text_of_word()
        return owner[k - 1 :] == owner[: len(owner) - k + 1] if len(owner) >= k else np.empty(0, dtype=bool)


def slices(texts: pa.Array) -> Iterator[Slice]:
    """The rows of a batch in slices of about a quarter of a megabyte of text, a longer text alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield Slice(texts.slice(at, to - at), at)
        at = to
    pa.default_memory_pool().release_unused()  # a worker that is used again should not hold what one batch took


def unique_pairs(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, key), sorted by owner and key."""
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return owner[new], key[new]
