"""Frames too wide, or recursions, for row-by-row evaluation.

Spark re-evaluates a sliding frame for every row, which is fine for 24 rows and too slow for
8,640.  These statistics run per segment on Arrow batches instead; Spark still cuts, shuffles
and schedules the data, and a task holds one segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.scalars import bars_per
from tidegrid.functions.segments import Segments
from tidegrid.functions.sliding import rolling_quantile, rolling_rank
from tidegrid.params import DAY_MS, HOUR_MS, MINUTE_MS


@dataclass(frozen=True)
class Rolling:
    """A statistic of ``source`` called ``out``.

    kind      "zscore", "quantile", "rank" (share of earlier rows in the frame that are not
              above the current one) or "ewm" (recursive mean, first value as start)
    days      frame length in days of bars, or ``rows`` in rows
    """

    out: str
    kind: str
    source: str
    days: int = 0
    rows: int = 0
    min_days: float = 0
    min_rows: int = 0
    arg: float = 0.0

    def frame_rows(self, per_day: int) -> int:
        return self.days * per_day if self.days else self.rows

    def needed_rows(self, per_day: int) -> int:
        return max(int(self.min_days * per_day), self.min_rows, 1)


def warm_up_rows(alpha: float) -> int:
    """Rows after which the start of a recursive mean weighs less than 2**-80.

    A double holds 53 bits, so a segment that starts this many rows early ends up with the
    same numbers as a pass over the whole series.
    """
    return ceil(80 * log(2) / -log(1 - alpha))


def look_back(specs: Sequence[Rolling], timeframe: str = "timeframe") -> Column:
    """Rows that the statistics need before the current one."""
    per_day = bars_per(timeframe, DAY_MS)
    reach = [F.lit(0)]
    for s in specs:
        if s.kind == "ewm":
            reach.append(F.lit(warm_up_rows(s.arg)))
        elif s.days:
            reach.append(F.lit(s.days) * per_day)
        else:
            reach.append(F.lit(s.rows))
    return F.greatest(*reach, F.lit(0))


def _per_day(timeframe: str) -> int:
    unit = {"m": MINUTE_MS, "h": HOUR_MS, "d": DAY_MS}[timeframe[-1]]
    return DAY_MS // (int(timeframe[:-1]) * unit)


def _full_frames(kind: str, x: np.ndarray, idx: np.ndarray, rows: int, some: np.ndarray) -> np.ma.MaskedArray:
    """A statistic of narrow frames, all frames of a segment together, a row of the frames at a time.

    The steps are those of Spark's aggregates, so the numbers are too.  ``some`` tells which rows have a value.
    """
    out = np.ma.masked_all(len(x))
    n = len(x) - rows + 1
    if n <= 0:
        return out
    at = idx.astype("float64")
    total, mean, moment, place, spread, product = (np.zeros(n) for _ in range(6))
    with np.errstate(all="ignore"):
        for i in range(rows):
            value = x[i : i + n]
            total += value
            delta = value - mean
            step = delta / (i + 1.0)
            mean += step
            if kind == "full_slope":
                here = at[i : i + n]
                off = here - place
                move = off / (i + 1.0)
                place += move
                product += off * (value - mean)
                spread += off * (off - move)
            else:
                moment += delta * (delta - step)
        if kind == "full_slope":
            got, known = product / spread, spread != 0
        else:
            got = np.sqrt(moment / (rows - 1.0))
            known = np.full(n, True)
            if kind == "full_zscore":
                got, known = (x[rows - 1 :] - total / rows) / got, got != 0
    counts = np.concatenate(([0], np.cumsum(some)))
    known &= counts[rows:] - counts[:-rows] == rows
    out[rows - 1 :] = np.ma.array(got, mask=~known)
    return out


def _evaluate(spec: Rolling, x: np.ndarray, idx: np.ndarray, per_day: int) -> np.ndarray:
    series = pd.Series(x)
    frame, needed = spec.frame_rows(per_day), spec.needed_rows(per_day)
    if spec.kind == "ewm":
        mean = series.ewm(alpha=spec.arg, adjust=False).mean().to_numpy()
        return np.where(idx >= needed - 1, mean, np.nan)
    if spec.kind == "rank":
        return rolling_rank(x, idx, frame, needed)
    if spec.kind == "quantile":
        return rolling_quantile(x, frame, min(needed, frame), spec.arg)
    window = series.rolling(frame, min_periods=min(needed, frame))
    if spec.kind == "zscore":
        spread = window.std().to_numpy()
        spread = np.where(spread == 0.0, np.nan, spread)
        return (x - window.mean().to_numpy()) / spread
    raise ValueError(f"unknown statistic {spec.kind}")


def add_rolling(seg: Segments, specs: Sequence[Rolling], spare: Sequence[str] = ()) -> Segments:
    """Add the statistics to every row of every segment (copies included); drop ``spare`` columns that only they need."""
    specs, spare = tuple(specs), set(spare)
    order, idx = seg.order, seg.idx
    fields = [*seg.df.schema.fields, *[T.StructField(s.out, T.DoubleType()) for s in specs]]
    schema = T.StructType([f for f in fields if f.name not in spare])

    def kernel(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        position = table[idx].to_numpy()
        per_day = _per_day(table["timeframe"][0].as_py()) if "timeframe" in table.column_names else 0
        for s in specs:
            x = table[s.source].to_numpy().astype("float64")
            if s.kind.startswith("full_"):
                y = _full_frames(s.kind, x, position, s.rows, table[s.source].is_valid().to_numpy())
                table = table.append_column(s.out, pa.array(y.data, type=pa.float64(), mask=np.ma.getmaskarray(y)))
                continue
            y = _evaluate(s, x, position, per_day)
            table = table.append_column(s.out, pa.array(y, type=pa.float64(), mask=np.isnan(y)))
        return table.select(schema.names)

    return seg.having(seg.group().applyInArrow(kernel, schema))
