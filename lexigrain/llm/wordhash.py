"""Words of a batch of texts and their 64-bit hashes, with numpy over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers: of bytes within a word, and of words within a sequence.
BYTE_FACTOR, WORD_FACTOR, SECOND_FACTOR = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
LOWER = BYTES.copy()
LOWER[0x41:0x5B] = BYTES[0x61:0x7B]


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self, factor: np.uint64) -> None:
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)
        self.factor, self.inverse = factor, U64(pow(int(factor), -1, 1 << 64))

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, len(self.up) * 5 // 4)
            for name, by in (("up", self.factor), ("down", self.inverse)):
                steps = np.full(size, by, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = {f: _Powers(f) for f in (BYTE_FACTOR, WORD_FACTOR, SECOND_FACTOR)}


def _prefix(values: np.ndarray, factor: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers[factor].first(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; nulls are empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Of all rows of a column: data, offsets, and per word start, end, hash; first[d] is the first word of row d."""

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        self.data, self.offsets = buffers(column)
        n = len(self.data)
        word = ~IS_SPACE[self.data]
        begins = np.zeros(n + 1, bool)
        begins[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | begins[:n]))
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | begins[1:])) + 1
        sums, down = _prefix((LOWER if lower else BYTES)[self.data], BYTE_FACTOR)
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U64))
        self.first = np.searchsorted(self.start, self.offsets)


def sequence_hashes(words: np.ndarray, k: int, factor: np.uint64 = WORD_FACTOR) -> np.ndarray:
    """The hash of words i .. i+k-1 for every i; the last k-1 are left out."""
    if len(words) < k:
        return np.zeros(0, U64)
    sums, down = _prefix(words, factor)
    return mix((sums[k:] - sums[:-k]) * down[: len(words) - k + 1])
