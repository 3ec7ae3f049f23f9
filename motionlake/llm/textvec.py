"""Vectorised word hashing over Arrow string columns.

A polynomial prefix sum over the bytes of a batch gives the 64-bit hash of every word with a few
numpy passes, so no Python object is made per word.  Only hashes, offsets and document bounds are
kept, at most ``CHUNK`` bytes of text being expanded at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes expanded to 64-bit values at a time.
CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 & ~7 | 3
_MASK = (1 << 64) - 1


def _mix_int(x: int) -> int:
    x &= _MASK
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & _MASK
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & _MASK
    return x ^ (x >> 33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_table(separators: bytes, fold_case: bool = True) -> np.ndarray:
    """Value of each byte; 0 marks a separator, A-Z share the value of a-z."""
    t = np.array([_mix_int(0xC0FFEE + 977 * b) | 1 for b in range(256)], dtype=np.uint64)
    if fold_case:
        t[65:91] = t[97:123]
    t[np.frombuffer(separators, dtype=np.uint8)] = 0
    return t


#: Words of the near-duplicate contract: runs of anything but space and \t \n \v \f \r.
SPACE_WORDS = byte_table(b" \t\n\v\f\r")
#: Words without ASCII punctuation and controls.
PLAIN_WORDS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["p"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


@dataclass
class Words:
    """Hashes and byte bounds of the words of a batch; document d owns words ptr[d]:ptr[d+1]."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they lie in one document."""
        return ngrams(self.h, self.ptr, n)


def ngrams(h: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order-sensitive hash of h[i:i+n] for each i, and whether all n words are in one document."""
    m = max(0, len(h) - n + 1)
    out = h[:m].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    left = np.repeat(ptr[1:], np.diff(ptr)) - np.arange(len(h))
    return out, left[:m] >= n


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls count as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """All words of the documents data[offsets[d]:offsets[d+1]]."""
    solid = table != 0
    inside = solid[data]
    n = len(data)
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | fresh[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | fresh[1 : n + 1])) + 1
    h = np.empty(len(start), dtype=np.uint64)
    lo = 0
    while lo < len(start):
        # whole words only: as many as fit, one at least
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + CHUNK, "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        p, q = _powers(b - a)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(table[data[a:b]] * p[: b - a], out=sums[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        h[lo:hi] = mix((sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64))
        lo = hi
    return Words(h, start, end, np.searchsorted(start, offsets))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in parts of about ``most`` text bytes, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
