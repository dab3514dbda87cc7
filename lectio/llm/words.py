"""Vectorised words: one pass of NumPy over the UTF-8 buffer of an Arrow batch.

A token is a maximal run of bytes of one class, so no text is decoded and no per-word
Python runs. Words are named by a 64-bit hash (a polynomial over randomised bytes, then a
finaliser); two different words of one corpus share a hash with a chance near V^2 / 2^65."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * U64(2) + U64(1)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Byte classes: 0 separates; equal neighbours belong to one token.
WORD_CLASS = np.ones(256, np.uint8)
WORD_CLASS[[32, *range(9, 14)]] = 0
#: Letters, digits and non-ASCII bytes apart from other signs.
WORD_SIGN_CLASS = np.full(256, 2, np.uint8)
WORD_SIGN_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
WORD_SIGN_CLASS[[32, *range(9, 14)]] = 0


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), salted."""
    with np.errstate(over="ignore"):
        x = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            size = max(n + 1, 1 << 16)
            with np.errstate(over="ignore"):
                cls.up = _powers(_BASE, size)
                cls.down = _powers(_INVERSE, size)
        return cls.up, cls.down


class Tokens:
    """Tokens of some texts: ``hash`` per token; text i has tokens ``first[i]:first[i+1]``;
    ``start`` and ``end`` are byte places in ``data``, the (lower-cased) bytes of all texts."""

    def __init__(self, texts: pa.Array, classes: np.ndarray = WORD_CLASS, lower: bool = True):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.at = at - at[0]
        self.raw = raw
        self.data = LOWER[raw] if lower else raw
        kind = classes[self.data]
        size = len(raw)
        if not size:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(n + 1, np.int64)
            return
        change = np.empty(size + 1, bool)
        change[1:size] = kind[1:] != kind[:-1]
        change[0] = change[size] = True
        change[self.at] = True
        edges = np.flatnonzero(change)
        inside = kind[edges[:-1]] != 0
        self.start, self.end = edges[:-1][inside], edges[1:][inside]
        up, down = _Powers.of(size)
        with np.errstate(over="ignore"):
            total = np.empty(size + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE[self.data] * up[:size], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.at)

    def text(self, k: int) -> str:
        return self.data[self.start[k]: self.end[k]].tobytes().decode("utf-8", "replace")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``max_bytes`` of text each (a longer text alone),
    which bounds the arrays made from them."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def spread(first: np.ndarray) -> np.ndarray:
    """The text number of every token."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
