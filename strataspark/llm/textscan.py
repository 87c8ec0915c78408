"""Vectorised word scanning of Arrow string columns, in numpy.

Works on the UTF-8 bytes of a whole batch at once, so the cost per document is a
few array operations and memory is a small multiple of the chunk being scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes where words are runs of anything but space, tab and line ends.
BY_SPACE = np.ones(256, dtype=bool)
BY_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes where words are runs of ASCII digits, lower-case letters and all beyond ASCII.
BY_ALNUM = np.zeros(256, dtype=bool)
BY_ALNUM[48:58] = BY_ALNUM[97:123] = BY_ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2**64, as many as the longest word needed so far."""

    base = 0x9E3779B97F4A7C15 | 1
    table = np.ones(1, dtype=U)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if len(cls.table) < n:
            more = np.full(max(n, 64), cls.base, dtype=U)
            more[0] = 1
            cls.table = np.multiply.accumulate(more)
        return cls.table


def chunks(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows holding about ``most`` bytes; a null is empty.

    A row is never split: a longer text makes a chunk of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words, and per row the index of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    m = inside[low]
    begin = m.copy()
    begin[1:] &= ~m[:-1]
    first = offsets[:-1]
    first = first[first < len(data)]
    begin[first] = m[first]
    starts = np.flatnonzero(begin)
    bounds = np.searchsorted(starts, offsets).astype(np.int64)
    if not len(starts):
        return np.zeros(0, U), bounds
    kept = low[m].astype(U)
    kept += U(1)
    at = np.cumsum(m, dtype=np.int64)[starts] - 1
    lens = np.diff(np.append(at, len(kept)))
    rel = np.arange(len(kept), dtype=np.int64) - np.repeat(at, lens)
    kept *= _Powers.upto(int(lens.max()))[rel]
    h = np.add.reduceat(kept, at)
    return mix(h + lens.astype(U) * U(0xD6E8FEB86659FD93)), bounds


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words; a row of fewer words, but not none, has its whole sequence as one."""
    n = np.diff(bounds)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    edges = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    total = int(edges[-1])
    if not total:
        return np.zeros(0, U), edges
    at = np.arange(total, dtype=np.int64) + np.repeat(bounds[:-1] - edges[:-1], many)
    end = np.repeat(bounds[1:], many)
    out = np.zeros(total, U)
    for j in range(k):
        here = at + j
        ok = here < end
        step = mix(out * U(0x9FB21C651E98DF25) + h[np.minimum(here, len(h) - 1)] + U(j + 1))
        out = step if ok.all() else np.where(ok, step, out)
    return out, edges
