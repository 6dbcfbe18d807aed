"""Vectorised hashes of words and word windows (numpy, Arrow buffers in).

Words are the runs of bytes other than space, tab, LF, VT, FF and CR, which are
also the runs of such code points, as no UTF-8 sequence holds those bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@lru_cache(maxsize=2)
def _values(lower: bool) -> np.ndarray:
    """A 64-bit value for each byte; A-Z share those of a-z if ``lower``."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
    if lower:
        v[65:91] = v[97:123]
    return v


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_POWERS[0]) < n:
        for k, base in enumerate((_P, _INV)):
            old = _POWERS[k]
            step = _U(pow(base, len(old), 1 << 64))
            _POWERS[k] = np.concatenate([old, old * step])
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts into the words) for texts
    ``data[offsets[i]:offsets[i + 1]]``."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets.astype(np.int64) - base
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    powers, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_values(lower)[data] * powers[:n], out=total[1:])
    hashes = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, offsets)


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries (over text borders too)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _U(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1))
    for j in range(size):
        out = (out ^ words[j : j + n]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return mix(out)


def running_sums(words: np.ndarray) -> np.ndarray:
    """Sums from which ``run_hashes`` has the hash of any run."""
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(len(words) + 1)[0][: len(words)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of ``size`` entries at each of ``start``."""
    return mix((sums[start + size] - sums[start]) * _powers(len(sums))[1][start] + _U(size))


def inside_texts(word_offsets: np.ndarray, size: int, n_windows: int) -> np.ndarray:
    """Which window starts have all their words in one text."""
    ok = np.zeros(n_windows + size, np.int8)
    lo, hi = word_offsets[:-1], word_offsets[1:] - size + 1
    full = hi > lo
    np.add.at(ok, lo[full], 1)
    np.add.at(ok, hi[full], -1)
    return np.cumsum(ok[:n_windows]) > 0


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at.astype(np.int64)


def chunked(column: pa.Array, size: int = CHUNK):
    """(first row, bytes, offsets) of consecutive rows holding about ``size`` bytes."""
    data, offsets = text_buffers(column)
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, data, offsets[i : j + 1]
        i = j


def deal(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts by bucket, bounds of each bucket); the bucket is the hash's share of the hash space."""
    bucket = bucket_of(hashes, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
