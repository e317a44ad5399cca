"""Words, shingles and windows of whole Arrow batches as hash arrays (numpy, inside tasks).

A word's 64-bit hash is a polynomial in its bytes, mixed; a window's hash is a polynomial in
its words' hashes, mixed. All arithmetic wraps modulo 2**64. Nothing is kept between batches,
and a batch is worked through in slices of some MB, so memory follows the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is a slice by itself.
SLICE = 1 << 20
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
_BYTE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SLICE + (1 << 20):
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at:at + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def give_back() -> None:
    """Returns what this worker has freed to the system: workers outlive tasks, and the next stage may need the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


class Words:
    """Words of some texts: byte spans, first word of each text, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, separators=SPACES):
        data = data[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data, self.offsets = data, offsets
        solid = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._solid = solid

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        base = _BYTE[which]
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        value = (self.data.astype(np.uint64) + np.uint64(1)) * powers(base, n)
        value[~self._solid] = 0
        return mix(np.add.reduceat(value, self.starts) * powers(inverse(base), n)[self.starts])


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of the ``size`` words from each word on; meaningless where they cross a text's end."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _WORD[which]
    if size <= 8:
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * np.uint64(base) + words[k:k + n]
        return mix(total)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(base, len(words)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(inverse(base), n))


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Word positions from which ``size`` words lie in one text."""
    n = first[-1] - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for back in range(1, size):
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return np.flatnonzero(ok)


def slices(column: pa.Array, lower: bool, separators: np.ndarray = SPACES) -> Iterator[tuple[int, Words]]:
    """The texts of a column in slices: number of the first text, and words."""
    data, offsets = buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        upto = int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1
        upto = min(n, max(upto, at + 1))
        yield at, Words(data, offsets[at:upto + 1], lower, separators)
        at = upto


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column whose rows take ``counts`` values each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows hold ``counts`` values each, as little-endian bytes."""
    size = values.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * size, out=offsets[1:])
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
