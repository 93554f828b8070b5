"""From signals to trades, one open position per strategy and series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.segments import cut, ensure_index
from tidegrid.params import SERIES_KEYS, SegmentParams
from tidegrid.session import cut_lineage

_KEY = ("strategy_id", *SERIES_KEYS)


# A task of the search holds one segment of bars and about this many segments' worth of signals.
_SIGNALS_PER_BAR = 4


def _blocks(values: np.ndarray, fill: float, pick: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """Extremes of all blocks of 1, 2, 4, ... values, level after level, and where each level starts."""
    width = 1 << max(len(values) - 1, 0).bit_length()
    level = np.full(width, fill)
    level[: len(values)] = values
    levels = [level]
    while len(level) > 1:
        level = pick(level[0::2], level[1::2])
        levels.append(level)
    return np.concatenate(levels), np.cumsum([0, *[len(x) for x in levels[:-1]]])


def first_against(
    close: np.ndarray, first: np.ndarray, last: np.ndarray, side: np.ndarray, entry: np.ndarray, stop_frac: float
) -> np.ndarray:
    """First place in ``first..last`` where ``side * (close / entry - 1) <= -stop_frac``, else -1.

    The expression is monotone in the close, so the extreme of a block tells whether any of its
    closes is a hit.  Each search leaps over blocks without one, doubling them as it goes, and
    halves the block that has one: about twice the logarithm of the distance steps, whatever
    the frame.  NaN closes are never a hit.
    """
    gaps = np.isnan(close)
    low, at = _blocks(np.where(gaps, np.inf, close), np.inf, np.minimum)
    high, _ = _blocks(np.where(gaps, -np.inf, close), -np.inf, np.maximum)
    top = len(at) - 1
    falling = (side > 0) != np.signbit(entry)
    found = np.full(len(first), -1, dtype=np.int64)
    level = np.zeros(len(first), dtype=np.int64)
    place = first.astype(np.int64)
    last = np.minimum(last, len(close) - 1)
    live = np.flatnonzero(place <= last)
    with np.errstate(all="ignore"):
        while len(live):
            p, k = place[live], level[live]
            block = at[k] + (p >> k)
            extreme = np.where(falling[live], low[block], high[block])
            hit = side[live] * (extreme / entry[live] - 1.0) <= -stop_frac
            done = hit & (k == 0)
            found[live[done]] = p[done]
            p = np.where(hit, p, p + (1 << k))
            grow = ~hit & (k < top) & (p % (2 << k) == 0)
            level[live] = np.where(hit, k - 1, np.where(grow, k + 1, k))
            place[live] = p
            live = live[~done & (p <= last[live])]
    return np.where(found <= last, found, -1)


def _visit(stop_frac: float | None):
    """Search one segment of bars for the exits of the signals whose window touches it."""

    def run(signals: pd.DataFrame, bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("bar_idx")
        close, ts = bars["close"].to_numpy(dtype=float), bars["ts_open_ms"].to_numpy()
        base = int(bars["bar_idx"].iloc[0])
        first = np.maximum(signals["_from"].to_numpy() - base, 0)
        last = np.minimum(signals["_upto"].to_numpy() - base, len(close) - 1)
        side, entry = signals["direction"].to_numpy(), signals["entry_price"].to_numpy(dtype=float)
        priced = np.where(np.isnan(close), -1, np.arange(len(close)))
        final = np.maximum.accumulate(priced)[np.maximum(last, 0)]
        final = np.where((final >= first) & (last >= first), final, -1)
        stop = np.full(len(signals), -1) if stop_frac is None else first_against(close, first, last, side, entry, stop_frac)
        out = signals[[*_KEY, "signal_ts", "signal_idx", "direction"]].copy()
        for name, hit in (("stop", stop), ("last", final)):
            none = hit < 0
            out[f"{name}_idx"] = pd.Series(hit + base, index=out.index, dtype="Int64").mask(none)
            out[f"{name}_ts"] = pd.Series(ts[np.maximum(hit, 0)], index=out.index, dtype="Int64").mask(none)
            out[f"{name}_px"] = np.where(none, np.nan, close[np.maximum(hit, 0)])
        return out

    return run


def candidate_trades(
    signals: DataFrame,
    bars: DataFrame,
    hold_bars: int,
    stop_frac: float | None = None,
    segments: SegmentParams = SegmentParams(),
) -> DataFrame:
    """The trade each signal would make if it were taken.

    ``signals(strategy_id, exchange, symbol, timeframe, ts_open_ms, direction)``.  Entry is the
    close of the bar after the signal, exit the close ``hold_bars`` later, earlier where a
    close is ``stop_frac`` or more against the entry, or at the last bar of the series.  Bars
    without a close are no entry, no stop and no exit.  Repeated signals count once.

    No row is made per bar held.  Lowest and highest closes of the segments, a row each, tell
    which segment of a signal's window can hold its first stop; the signal visits that one and
    the last one of its window, and ``first_against`` searches inside.
    """
    size = F.lit(segments.rows)
    indexed = ensure_index(bars, SERIES_KEYS, segments.rows).select(
        *SERIES_KEYS, "ts_open_ms", "bar_idx", F.nanvl(F.col("close").cast("double"), F.lit(None).cast("double")).alias("close")
    )
    seg = cut(indexed, SERIES_KEYS, "bar_idx", segments.rows, after=1)
    entries = seg.with_columns(
        {"entry_ts": F.lead("ts_open_ms").over(seg.window()), "entry_price": F.lead("close").over(seg.window())}
    ).owned()
    entries = entries.withColumn("entry_ts", F.when(F.col("entry_price").isNotNull(), F.col("entry_ts")))
    live = signals.filter(F.col("direction") != 0).select(*_KEY, "ts_open_ms", F.col("direction").cast("int").alias("direction"))
    placed = (
        live.distinct()
        .join(entries.drop("close"), [*SERIES_KEYS, "ts_open_ms"])
        .withColumnsRenamed({"bar_idx": "signal_idx", "ts_open_ms": "signal_ts"})
        .withColumns({"_from": F.col("signal_idx") + 2, "_upto": F.col("signal_idx") + 1 + F.lit(hold_bars).cast("long")})
    )

    own = indexed.withColumn("_seg", F.floor(F.col("bar_idx") / size))
    priced = F.when(F.col("close").isNotNull(), F.col("bar_idx"))
    summary = own.groupBy(*SERIES_KEYS, "_seg").agg(
        F.min("close").alias("_low"), F.max("close").alias("_high"), F.min(priced).alias("_first"), F.max("bar_idx").alias("_end")
    )
    touched = (
        placed.filter(F.col("entry_price").isNotNull() & (F.col("_from") <= F.col("_upto")))
        .withColumn("_seg", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor(F.col("_upto") / size))))
        .join(summary, [*SERIES_KEYS, "_seg"])
        .filter(F.col("_first") <= F.col("_upto"))
    )

    def reaches(px: Column) -> Column:
        return F.col("direction") * (F.try_divide(px, F.col("entry_price")) - 1.0) <= F.lit(-(stop_frac or 0.0))

    # Entries at or below zero have no such bound; their signals visit every segment of the window.
    may_stop = F.lit(False) if stop_frac is None else (
        (F.col("entry_price") <= 0) | reaches(F.when(F.col("direction") > 0, F.col("_low")).otherwise(F.col("_high")))
    )
    # In the segment of the entry a hit may lie before the window, so a hit there ends no search.
    whole = (F.col("entry_price") > 0) & (F.floor(F.col("_from") / size) < F.col("_seg"))
    each = [*_KEY, "signal_ts", "direction"]
    at = Window.partitionBy(*each).orderBy("_seg")
    ranked = touched.withColumns(
        {
            "_sure_before": F.max(may_stop & whole).over(at.rowsBetween(Window.unboundedPreceding, -1)),
            "_last_seg": F.max("_seg").over(Window.partitionBy(*each)),
        }
    )
    visits = ranked.filter((may_stop & ~F.coalesce("_sure_before", F.lit(False))) | (F.col("_seg") == F.col("_last_seg")))
    visits = cut_lineage(visits.select(*each, "signal_idx", "entry_price", "_from", "_upto", "_seg"))

    per_task = F.lit(_SIGNALS_PER_BAR) * size
    parts = visits.groupBy(*SERIES_KEYS, "_seg").agg(F.ceil(F.count(F.lit(1)) / per_task).alias("_parts"))
    shared = [*SERIES_KEYS, "_seg", "_part"]
    salted = visits.join(parts, [*SERIES_KEYS, "_seg"]).withColumn("_part", F.pmod(F.xxhash64("strategy_id", "signal_ts"), "_parts"))
    copies = own.join(parts, [*SERIES_KEYS, "_seg"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    # Both sides know the numbers of parts; new names for the columns of one keep them apart.
    copies = copies.select(*[F.col(c).alias(c) for c in (*shared, "bar_idx", "ts_open_ms", "close")])
    fields = ", ".join(f"{n}_idx long, {n}_ts long, {n}_px double" for n in ("stop", "last"))
    key_schema = ", ".join(f"{k} string" for k in _KEY)
    exits = (
        salted.groupBy(*shared)
        .cogroup(copies.groupBy(*shared))
        .applyInPandas(_visit(stop_frac), f"{key_schema}, signal_ts long, signal_idx long, direction int, {fields}")
    )
    leave = lambda n: F.struct(*[F.col(f"{n}_{c}").alias(c) for c in ("idx", "ts", "px")])
    found = exits.groupBy(*each).agg(
        F.min(F.when(F.col("stop_idx").isNotNull(), leave("stop"))).alias("_stop"),
        F.max(F.when(F.col("last_idx").isNotNull(), leave("last"))).alias("_last"),
    )
    out = placed.join(found, each, "left")
    gone = F.coalesce("_stop", "_last")
    return out.select(
        *_KEY,
        "signal_ts",
        "signal_idx",
        "direction",
        "entry_ts",
        "entry_price",
        gone["idx"].alias("exit_idx"),
        gone["ts"].alias("exit_ts"),
        gone["px"].alias("exit_price"),
        F.when(F.col("entry_price").isNull(), "no_entry_bar").when(gone.isNull(), "no_exit_bar").alias("skip_reason"),
        F.when(F.col("_stop").isNotNull(), "stop")
        .when(F.col("_last.idx") == F.col("_upto"), "time_exit")
        .when(gone.isNotNull(), "end_of_data")
        .alias("exit_reason"),
    )


def _chains(starts: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next signal after each trade, and the last exit of the chain of trades from it."""
    follow = np.searchsorted(starts, exits, side="left")
    end = exits.copy()
    for i in range(len(starts) - 1, -1, -1):
        if follow[i] < len(starts):
            end[i] = end[follow[i]]
    return follow, end


def _answer(rows: int, reach: int):
    """For every state a segment can be entered in, the state it is left in.

    The state is the position up to which a trade is open; it can reach at most ``reach``
    bars into the segment.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("signal_idx")
        starts, exits = pdf["signal_idx"].to_numpy(), pdf["exit_idx"].to_numpy()
        _, end = _chains(starts, exits)
        first = int(key[-1]) * rows
        states = first + np.arange(reach + 1)
        at = np.searchsorted(starts, states, side="left")
        left = np.where(at < len(starts), end[np.minimum(at, len(starts) - 1)], states)
        return pd.DataFrame([[*key, left.tolist()]], columns=[*_KEY, "_seg", "_left"])

    return run


def _thread(rows: int, reach: int):
    """Walk the segments of one series in order with their answer tables."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seg")
        busy, carried = 0, []
        for seg, left in zip(pdf["_seg"], pdf["_left"], strict=True):
            carried.append(busy)
            state = busy - seg * rows
            busy = int(left[max(state, 0)]) if state <= reach else busy
        return pd.DataFrame({**dict(zip(_KEY, key, strict=True)), "_seg": pdf["_seg"].to_numpy(), "_busy": carried})

    return run


def _take(key: tuple, signals: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
    signals = signals.sort_values("signal_idx")
    starts, exits = signals["signal_idx"].to_numpy(), signals["exit_idx"].to_numpy()
    follow, _ = _chains(starts, exits)
    taken = np.zeros(len(starts), dtype=bool)
    at = int(np.searchsorted(starts, int(carry["_busy"].iloc[0]), side="left")) if len(carry) else 0
    while at < len(starts):
        taken[at] = True
        at = int(follow[at])
    return signals.assign(taken=taken)


def trade_ledger(
    signals: DataFrame,
    bars: DataFrame,
    hold_bars: int,
    stop_frac: float | None = None,
    segments: SegmentParams = SegmentParams(),
) -> DataFrame:
    """All signals with their trade, ``taken`` or a ``skip_reason``.

    A signal is taken when no trade is open; one on the bar of an exit may be.  The choice
    is earliest first, hence sequential, but the state between two segments is only how far
    the open trade reaches into the next one.  Each segment tabulates its answer to every
    such state, the tables are threaded per series, and the segments then choose on their
    own: no task sees more than a segment of signals, or one table per segment.
    """
    rows, reach = segments.rows, hold_bars + 1
    found = cut_lineage(candidate_trades(signals, bars, hold_bars, stop_frac, segments))
    open_ = found.filter(F.col("skip_reason").isNull()).withColumn("_seg", F.floor(F.col("signal_idx") / F.lit(rows)))
    slim = open_.select(*_KEY, "_seg", "signal_idx", "exit_idx")
    key_schema = ", ".join(f"{k} string" for k in _KEY)
    tables = slim.groupBy(*_KEY, "_seg").applyInPandas(_answer(rows, reach), f"{key_schema}, _seg long, _left array<long>")
    carry = tables.groupBy(*_KEY).applyInPandas(_thread(rows, reach), f"{key_schema}, _seg long, _busy long")
    chosen = (
        slim.groupBy(*_KEY, "_seg")
        .cogroup(carry.groupBy(*_KEY, "_seg"))
        .applyInPandas(_take, f"{key_schema}, _seg long, signal_idx long, exit_idx long, taken boolean")
        .select(*_KEY, "signal_idx", "taken")
    )
    out = found.join(chosen, [*_KEY, "signal_idx"], "left")
    taken = F.coalesce("taken", F.lit(False))
    return out.withColumns(
        {
            "taken": taken,
            "skip_reason": F.when(taken, F.lit(None)).otherwise(F.coalesce("skip_reason", F.lit("already_in_position"))),
        }
    )


def taken_trades(ledger: DataFrame) -> DataFrame:
    return ledger.filter("taken").drop("taken", "skip_reason")
