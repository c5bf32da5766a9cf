"""Words of many texts at once, by numpy over Arrow's own byte buffers.

A word is a run of bytes outside [\\x20\\x09-\\x0D]. Texts are handled whole; a block ends at a
text's end, so a single long text makes a long block rather than a cut one. Hashes of its slices are
taken a segment of bytes at a time, so that a long text costs some bytes a byte, not some words of eight.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 17
SEGMENT_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C55 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_WORD_INVERSE = pow(_WORD_BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on every other (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class _Powers:
    """Growing tables of base**i and base**-i modulo 2**64."""

    def __init__(self, base: int, inverse: int):
        self.factors = base, inverse
        self.forget()

    def forget(self) -> None:
        self.tables = [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            n = max(n, 2 * BLOCK_BYTES)
            for k, f in enumerate(self.factors):
                steps = np.full(n, f & _MASK, np.uint64)
                steps[0] = 1
                self.tables[k] = np.multiply.accumulate(steps)
        return self.tables


_BYTES, _WORDS = _Powers(_BASE, _INVERSE), _Powers(_WORD_BASE, _WORD_INVERSE)


class Rolling:
    """Hashes of arbitrary slices of one sequence of integers, from prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray, powers: _Powers):
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * up[: len(values)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def rolling(data: np.ndarray) -> Rolling:
    return Rolling(data.astype(np.uint64) + np.uint64(1), _BYTES)


def long_hash(data: np.ndarray, lower: bool) -> np.uint64:
    """The hash of one slice, added up from its segments."""
    total = 0
    for lo in range(0, len(data), SEGMENT_BYTES):
        part = data[lo : lo + SEGMENT_BYTES]
        total += int(rolling(LOWER[part] if lower else part).sums[-1]) * pow(_BASE, lo, 1 << 64)
    return mixed(np.array([(total + len(data)) & _MASK], np.uint64))[0]


@dataclass
class Block:
    """Some whole texts: bytes, where each begins, and where each word begins and ends."""

    at: np.ndarray  # places of the texts in their batch
    data: np.ndarray  # bytes
    offsets: np.ndarray  # len(at) + 1 byte offsets
    starts: np.ndarray  # of words
    ends: np.ndarray
    first: np.ndarray  # len(at) + 1 places of each text's first word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at)), self.counts)

    def rolling(self, lower: bool) -> Rolling:
        return rolling(LOWER[self.data] if lower else self.data)

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """Of slices of the bytes that begin in ascending order and don't reach beyond their word, a segment at a time."""
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(start, start[i] + SEGMENT_BYTES)))
            lo, hi = int(start[i]), int(end[i:j].max())
            if j == i + 1 and hi - lo > SEGMENT_BYTES:
                out[i] = long_hash(self.data[lo:hi], lower)
            else:
                part = self.data[lo:hi]
                out[i:j] = rolling(LOWER[part] if lower else part).slices(start[i:j] - lo, end[i:j] - lo)
            i = j
        return out

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return self.hashes(self.starts, self.ends, lower)

    def gathered(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of some slices side by side, and where each begins and ends there."""
        size = end - start
        after = np.cumsum(size)
        before = after - size
        return self.data[np.repeat(start - before, size) + np.arange(int(size.sum()))], before, after

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()


def give_back() -> None:
    """Return this process's free memory to the system."""
    _BYTES.forget(), _WORDS.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run: Callable) -> Callable:
    """A function on Arrow batches that gives its worker's free memory back when it ends: workers live on, and an executor has several."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def gram_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all n-grams that stay inside their text, and how many each text has."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    base = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) if len(counts) else np.empty(0, np.int64)
    return base + np.arange(len(base)), counts


def gram_hashes(hashes: np.ndarray, start: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    return Rolling(hashes, _WORDS).slices(start, start + n)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, gap: np.ndarray = IS_SPACE) -> Iterator[Block]:
    """Whole texts of a string column, about limit bytes at a time. gap says of each byte whether it stands between words."""
    data, offsets = _strings(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        lo, hi = offsets[i], offsets[j]
        part, own = data[lo:hi], offsets[i : j + 1] - lo
        word = ~gap[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[own] = True
        before, after = np.zeros(len(part), bool), np.zeros(len(part), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        yield Block(np.arange(i, j), part, own, starts, ends, np.searchsorted(starts, own))
        i = j
