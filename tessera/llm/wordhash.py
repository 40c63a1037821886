"""Words, word hashes and shingle hashes of whole Arrow string columns, vectorised over bytes.

A word is a maximal run of bytes that a 256-entry table admits. A word's hash is a polynomial
modulo 2**64 taken from one prefix sum over the bytes, then mixed, so no Python object is made
for a word. Words never cross the end of a text. Chunks are bounded by bytes, not by rows; one
text longer than the bound is a chunk of its own and is still read whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are in work at once.
CHUNK_BYTES = 1 << 19

#: `[^\x20\x09-\x0D]+`
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[9, 10, 11, 12, 13, 32]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + (1 << 16))
        for key, base in (("p", _BASE), ("i", _INVERSE)):
            a = np.full(size, U(base))
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


@dataclass
class Words:
    """The words of consecutive texts. Text k has the words cut[k]:cut[k + 1]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    cut: np.ndarray
    first: int

    @property
    def texts(self) -> int:
        return len(self.cut) - 1

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        if not len(self.start):
            return np.zeros(0, U)
        power, inverse = _power(n)
        sums = np.zeros(n + 1, U)
        np.cumsum((self.buf.astype(U) + U(1)) * power[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    def text_of(self) -> np.ndarray:
        """The number, within the chunk, of each word's text."""
        return np.repeat(np.arange(self.texts), np.diff(self.cut))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Gives freed memory back to the machine, for workers stay after their task and share it with others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def words(column: pa.Array, table: np.ndarray, *, lower: bool) -> Iterator[Words]:
    """Words of a column by chunks of about CHUNK_BYTES; `first` is the row of a chunk's first text."""
    offsets, data = string_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        buf = data[offsets[at] : offsets[to]]
        if lower:
            buf = LOWER[buf]
        bounds = offsets[at : to + 1] - offsets[at]
        inside = table[buf]
        fresh = np.zeros(len(buf) + 1, bool)
        fresh[bounds] = True
        before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        start = np.flatnonzero(inside & (~before | fresh[:-1]))
        end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
        yield Words(buf, start, end, np.searchsorted(start, bounds), at)
        at = to
    if n >= 256:
        release()


def grams(h: np.ndarray, k: int, *, salt: int = 0) -> np.ndarray:
    """Hashes of the k consecutive words from each place on; those crossing texts are the caller's to drop."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, U(salt * 2 + 1))
    for i in range(k):
        out = out * U(0x9FB21C651E98DF25) + h[i : i + n]
    return mix(out)


def whole(cut: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of the n places of grams(h, k): whether all k words are of one text."""
    text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    return text[:n] == text[k - 1 : k - 1 + n]


def strings(offsets_data: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """A string array from offsets and bytes."""
    offsets, data = offsets_data
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())
