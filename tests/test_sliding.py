"""Order statistics of sliding frames against looking at each frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tidegrid.functions.sliding import SlidingOrder, rolling_quantile, rolling_rank


@pytest.mark.parametrize("case", ["random", "ties", "gaps", "constant", "none", "one", "empty"])
@pytest.mark.parametrize("rows", [1, 2, 7, 50, 10_000])
def test_frames(case, rows):
    rng = np.random.default_rng(7)
    x = {
        "random": rng.normal(size=300),
        "ties": rng.integers(0, 4, 300).astype(float),
        "gaps": np.where(rng.random(300) < 0.3, np.nan, rng.integers(-5, 5, 300).astype(float)),
        "constant": np.ones(20),
        "none": np.full(20, np.nan),
        "one": np.array([3.0]),
        "empty": np.zeros(0),
    }[case]
    for needed in (1, 5):
        got = rolling_rank(x, np.arange(len(x)), rows, needed)
        for i, v in enumerate(got):
            frame = x[max(0, i - rows + 1) : i + 1]
            if np.isnan(x[i]) or (~np.isnan(frame)).sum() < needed:
                assert np.isnan(v)
            else:
                assert v == (frame[:-1] <= x[i]).sum() / max(len(frame) - 1, 1)
        for q in (0.0, 0.5, 0.99, 1.0):
            want = pd.Series(x, dtype="float64").rolling(rows, min_periods=min(needed, rows)).quantile(q).to_numpy()
            np.testing.assert_allclose(rolling_quantile(x, rows, min(needed, rows), q), want, rtol=1e-12, equal_nan=True)


def test_every_rank_of_every_frame():
    x = np.random.default_rng(1).integers(0, 9, 40).astype(float)
    order = SlidingOrder(x)
    first, end = order.frames(11)
    for k in range(11):
        inside = end - first > k
        got = order.smallest(first[inside], end[inside], np.full(inside.sum(), k))
        want = [sorted(x[max(0, i - 10) : i + 1])[k] for i in np.flatnonzero(inside)]
        assert got.tolist() == want
    for bound in range(len(order.values) + 2):
        got = order.below(first, end, np.full(len(x), bound))
        assert got.tolist() == [sum(order.rank[j] < bound for j in range(max(0, i - 10), i + 1)) for i in range(len(x))]


def test_long_segment_is_quick():
    """A frame of 8,640 rows over 60,000: one step per level, not one per row of the frame."""
    x = np.random.default_rng(2).normal(size=60_000)
    got = rolling_rank(x, np.arange(len(x)), 8640, 4320)
    for i in (4318, 4319, 20_000, 59_999):
        frame = x[max(0, i - 8639) : i + 1]
        assert np.isnan(got[i]) if i < 4319 else got[i] == (frame[:-1] <= x[i]).sum() / (len(frame) - 1)
