"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Helpers of the operators that work in Arrow batches. A text is never turned into
Python strings: word borders are found on bytes, and a word's 64-bit hash is the
difference of two prefix sums of a polynomial modulo 2**64, mixed afterwards.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# bytes of text handled in one go; a longer text is handled alone
SLICE_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_SPACE = [0x20, *range(0x09, 0x0E)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

# bytes of words: all but white space; or letters, digits and all beyond ASCII
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[_SPACE] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


_libc = ctypes.CDLL(ctypes.util.find_library("c") or None)


def give_back() -> None:
    """Return freed memory to the machine: a worker lives on and shares it with its executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of a text column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


class Words:
    """The words of a slice: hash, start and end byte each; ``first`` has each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower=True):
        self.data = LOWER[data] if lower else data
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = word_bytes[self.data]
        step = np.diff(inside)
        starts, ends = step == 1, step == -1
        # a word never crosses the border of two texts
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        crossing = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        starts[crossing] = True
        ends[crossing] = True
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=sums[1:])
        spread = powers(_P_INVERSE, n + 1)[self.start]
        return mix((sums[self.end] - sums[self.start]) * spread)


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and each text's first one.

    A text of fewer than ``k`` words, but not none, has one run: all its words.
    """
    h = words.hashes()
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    n = len(h)
    full = np.maximum(words.count - k + 1, 0)
    short = (words.count > 0) & (words.count < k)
    per_text = full + short
    first = np.concatenate(([0], np.cumsum(per_text)))
    if n == 0:
        return np.zeros(0, np.uint64), first
    padded = np.concatenate((h, np.zeros(k, np.uint64)))
    runs = np.zeros(n, np.uint64)
    for j in range(k):
        runs += padded[j : j + n] * factors[j]
    # word index of every run: consecutive ones from the text's first word
    at = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], per_text)
    out = runs[at]
    for t in np.flatnonzero(short):
        own = h[words.first[t] : words.first[t + 1]]
        out[first[t]] = sum((int(x) * int(f) for x, f in zip(own, factors)), 0) % (1 << 64)
    return mix(out), first


def distinct_per_text(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every text and each text's first one."""
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        values[a:b].sort()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[keep], text[keep]
    return values, np.searchsorted(text, np.arange(len(first)))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)
