"""Word positions and rolling hashes of whole Arrow columns, by numpy.

All functions work on the UTF-8 bytes of many documents at once and never on
single words, so that their cost is a few nanoseconds a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the rolling hashes (any odd numbers would do).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
WORD_BASE_2 = 0xD6E8FEB86659FD93
#: Bytes of text that are hashed together; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18
#: Powers that a worker keeps, as a power of two; longer documents compute their own and drop them.
KEPT_BITS = 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse modulo 2**64."""
    up = np.full(n, base, dtype=U)
    up[0] = 1
    down = np.full(n, pow(base, -1, 1 << 64), dtype=U)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=3)
def _kept_powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << KEPT_BITS)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 1 << KEPT_BITS:
        return _powers(base, n)
    up, down = _kept_powers(base)
    return up[:n], down[:n]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-white bytes, and where each document's words begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    full = ~space
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, space[1:]
    inner = offsets[1:-1]
    before[inner[inner < n]] = True
    after[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(full & before)
    ends = np.flatnonzero(full & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    up, down = powers(BYTE_BASE, len(data))
    sums = np.empty(len(data) + 1, dtype=U)
    sums[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(U) * U(0xA0761D6478BD642F)))


def ngram_hashes(words: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """Rolling hash of every ``n`` consecutive word hashes (document bounds are the caller's)."""
    if len(words) < n:
        return np.zeros(0, dtype=U)
    up, down = powers(base, len(words))
    sums = np.empty(len(words) + 1, dtype=U)
    sums[0] = 0
    np.cumsum(words * up, out=sums[1:])
    m = len(words) - n + 1
    return mix((sums[n:] - sums[:m]) * down[:m])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
