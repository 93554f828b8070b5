"""Byte-wise work on Arrow batches of texts: words, hashes, shingles.

All functions take many texts at once and stay in numpy; a batch is the unit of memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: White space that ends a word: space, and tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: A to Z become a to z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more entry than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words lie before each row's end (with a leading 0)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~WHITE[raw]
    left, right = inside[:-1].copy(), inside[1:].copy()
    cut = np.unique(at)  # a row's end ends a word too
    starts = right & ~left
    ends = left & ~right
    both = cut[left[cut] & right[cut]]
    starts[both] = True
    ends[both] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, at, "left")


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word: two blocks of polynomial sums, taken apart by prefix sums."""
    if not len(start):
        return np.zeros(0, U)
    step, back = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    block = 1 << 20
    most = min(block, len(raw))  # short texts need few powers
    powers = np.ones(most + 1, U)
    np.multiply.accumulate(np.full(most, step), out=powers[1:])
    undo = np.ones(most + 1, U)
    np.multiply.accumulate(np.full(most, back), out=undo[1:])
    table = mix(np.arange(1, 257, dtype=U))
    out = np.empty(len(start), U)
    first = 0
    while first < len(start):
        base = start[first]
        last = int(np.searchsorted(end, base + block, "right"))
        if last <= first:  # one word longer than a block
            value = U(0)
            for i in range(base, end[first], block):
                piece = table[raw[i : min(i + block, end[first])]]
                value = mix(np.array([value + (piece * powers[: len(piece)]).sum(dtype=U)]))[0]
            out[first] = value
            first += 1
            continue
        part = table[raw[base : end[last - 1]]]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * powers[: len(part)], out=sums[1:])
        s, e = start[first:last] - base, end[first:last] - base
        out[first:last] = (sums[e] - sums[s]) * undo[s]
        first = last
    return mix(out + (end - start).astype(U))


def shingles(raw: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every row, sorted and distinct within the row, and where each row's begin.

    A row with fewer words than ``width`` has one shingle, all its words; one without words has none.
    """
    start, end, count = words(raw, at)
    h = word_hashes(LOWER[raw], start, end)
    n = np.diff(count)
    per = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(per)))
    row = np.repeat(np.arange(len(n)), per)
    first = count[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]
    taken = np.minimum(n[row], width)
    padded = np.concatenate((h, np.zeros(width, U)))
    value = np.zeros(begin[-1], U)
    for k in range(width):
        value = mix(value * U(0x2545F4914F6CDD1D) + np.where(k < taken, padded[first + k], U(0)) + U(k + 1))
    for i in np.flatnonzero(per > 1):
        value[begin[i] : begin[i + 1]].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(n)))))
