"""Compact windows: which stretches of a sequence have their minimum at which place."""

from __future__ import annotations

import numpy as np

_PLACE = np.uint64((1 << 24) - 1)


def window_minima(order: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that are the minimum (leftmost of equals) of some ``width`` consecutive values of one row, and the first and last start of such windows.

    ``order``: 64-bit values, compared by their upper 40 bits; ``bounds``: the rows' n + 1 offsets.
    Sliding minima come from doubling, log2(width) passes; rows shorter than ``width`` have none.
    """
    n = len(order)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    v = (order & ~_PLACE) | (np.arange(n, dtype=np.uint64) & _PLACE)
    m, size = v, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: n - width + 1], m[width - size : width - size + n - width + 1])
    start = np.arange(n - width + 1)
    inside = np.zeros(n + 1, np.int64)
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    inside = start + width <= row_end[: len(start)]
    start, m = start[inside], m[inside]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    # the low bits name the place; it is the one within the window
    place = start + ((m & _PLACE).astype(np.int64) - start) % (1 << 24)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1])]))
    return place[new], start[new], start[np.append(new[1:], len(start)) - 1]


def cartesian_spans(order: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the widest span [l, r] of its row in which no value is less: its subtree in the row's Cartesian tree, with equal values in one node.

    Found by descent over tables of minima of 1, 2, 4, ... values, for all places at once.
    """
    n = len(order)
    v = (order & ~_PLACE) | (np.arange(n, dtype=np.uint64) & _PLACE)
    row = np.searchsorted(bounds, places, "right") - 1
    low, high = bounds[row], bounds[row + 1]
    tables, size = [v], 1
    longest = int(np.diff(bounds).max(initial=0))
    while size * 2 <= longest:
        tables.append(np.minimum(tables[-1][:-size], tables[-1][size:]))
        size *= 2
    left, right, own = places.copy(), places + 1, v[places] & ~_PLACE
    for k in range(len(tables) - 1, -1, -1):
        t, step = tables[k], 1 << k
        at = left - step
        go = (at >= low) & (t[np.clip(at, 0, len(t) - 1)] >= own)
        left = np.where(go, at, left)
        go = (right + step <= high) & (t[np.clip(right, 0, len(t) - 1)] >= own)
        right = np.where(go, right + step, right)
    return left, right - 1
