"""Vectorised work on the UTF-8 bytes of an Arrow batch: words, hashes, n-grams. Nothing here loops over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
#: A random 64-bit number for each byte value, and the same with A-Z folded to a-z.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = (_rng.integers(1, 2**63, 16, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_pow = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    global _pow
    if len(_pow[0]) < n:
        size, out = 1 << (n - 1).bit_length(), []
        for b in (_BASE, _BACK):
            p = np.full(size, b & (2**64 - 1), np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _pow = out[0], out[1]
    return _pow


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the n + 1 offsets; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offs[0] : offs[-1]] if buf is not None and len(offs) and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0] if len(offs) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, *texts: str, limit: int = 1 << 19):
    """Runs of rows with at most ``limit`` bytes of text in the columns ``texts`` together (one row at least): the memory of what follows is bounded by it or by the longest row."""
    offs = sum(text_bytes(batch.column(t))[1] for t in texts)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and row of every word [^\\x20\\x09-\\x0D]+, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = np.zeros(n + 2, bool)
    np.logical_not(IS_SPACE[data], out=ink[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(ink[1:-1] & (~ink[:-2] | edge[:-1]))
    ends = np.flatnonzero(ink[1:-1] & (~ink[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def prefix(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    p, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * p[: len(data)], out=out[1:])
    return out


def span_hashes(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from :func:`prefix`. Equal spans hash alike wherever they stand."""
    _, back = _powers(len(pre))
    return mix64((pre[ends] - pre[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offs: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, row, start and end of every word."""
    s, e, row = words(data, offs)
    return span_hashes(prefix(data, FOLDED if fold else BYTE), s, e), row, s, e


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive values."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    p, back = _powers(len(h) + 1)
    pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[: len(h)], dtype=np.uint64)])
    return mix64((pre[width:] - pre[:-width]) * back[: len(h) - width + 1])


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of the rows in a sorted row index."""
    return np.searchsorted(row, np.arange(n + 1))


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, row and first word of every k-word shingle; a row of fewer words (but some) is one shingle."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = bounds[row] + first
    out = np.zeros(len(at), np.uint64)
    short = n[row] < k
    for j in range(k):
        there = ~short | (j < n[row])
        out[there] += h[at[there] + j] * _STEP[j] if short.any() else h[at + j] * _STEP[j]
    return mix64(out + np.where(short, n[row], k).astype(np.uint64)), row, first
