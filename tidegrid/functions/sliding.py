"""Order statistics of many sliding frames at once.

A wavelet matrix over the ranks of a segment's values: one bit of every rank per level, with counts of
zeros before each place.  How many values of a frame lie below a bound, or which is the k-th smallest of a
frame, takes one step per level, for any width of the frame.  All frames of a segment go through a level
together, so the cost of a row is the logarithm of the number of different values, not the width of its frame.
"""

from __future__ import annotations

import numpy as np


class SlidingOrder:
    """``x`` may hold NaN; those are in no frame."""

    def __init__(self, x: np.ndarray) -> None:
        present = ~np.isnan(x)
        # Rows before each place that have a value: frames of rows become frames of values.
        self.before = np.concatenate(([0], np.cumsum(present)))
        self.values, ranks = np.unique(x[present], return_inverse=True)
        self.rank = np.full(len(x), -1, np.int64)
        self.rank[present] = ranks
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for level in reversed(range(max(len(self.values) - 1, 0).bit_length())):
            ones = (ranks >> level) & 1 == 1
            zeros = np.concatenate(([0], np.cumsum(~ones)))
            self.levels.append((level, zeros, int(zeros[-1])))
            ranks = np.concatenate((ranks[~ones], ranks[ones]))

    def frames(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the frame of the last ``rows`` rows at each row, in values."""
        here = np.arange(1, len(self.before))
        return self.before[np.maximum(here - rows, 0)], self.before[here]

    def below(self, first: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each frame have a rank below ``bound``."""
        out = np.where(bound >= len(self.values), end - first, 0)
        inside = bound < len(self.values)
        for level, zeros, total in self.levels:
            one = (bound >> level) & 1 == 1
            a, b = zeros[first], zeros[end]
            out += np.where(inside & one, b - a, 0)
            first, end = np.where(one, total + first - a, a), np.where(one, total + end - b, b)
        return out

    def smallest(self, first: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of each frame that has ``k`` others before it in order; ``k`` lies in the frame."""
        rank = np.zeros(len(first), np.int64)
        for level, zeros, total in self.levels:
            a, b = zeros[first], zeros[end]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            rank |= one.astype(np.int64) << level
            first, end = np.where(one, total + first - a, a), np.where(one, total + end - b, b)
        return self.values[rank]


def rolling_rank(x: np.ndarray, idx: np.ndarray, rows: int, needed: int) -> np.ndarray:
    """Share of the earlier rows of each frame that are not above the current one."""
    order = SlidingOrder(x)
    first, end = order.frames(rows)
    here = order.rank >= 0
    good = here & (end - first >= needed)
    out = np.full(len(x), np.nan)
    others = np.maximum(np.minimum(idx + 1, rows) - 1, 1)
    out[good] = (order.below(first[good], end[good], order.rank[good] + 1) - 1) / others[good]
    return out


def rolling_quantile(x: np.ndarray, rows: int, needed: int, q: float) -> np.ndarray:
    """The quantile between neighbours of each frame that has ``needed`` values."""
    order = SlidingOrder(x)
    first, end = order.frames(rows)
    size = end - first
    good = size >= max(needed, 1)
    out = np.full(len(x), np.nan)
    place = (size[good] - 1) * q
    low = np.floor(place).astype(np.int64)
    high = np.minimum(low + 1, size[good] - 1)
    a = order.smallest(first[good], end[good], low)
    b = order.smallest(first[good], end[good], high)
    out[good] = a + (b - a) * (place - low)
    return out
