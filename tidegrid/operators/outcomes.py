"""What followed an event: forward return and excursions from the next bar's close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import unknown_timeframe
from tidegrid.functions.segments import Segments, cut, ensure_index
from tidegrid.params import HORIZONS, SERIES_KEYS, SegmentParams

OUTCOME_COLUMNS = (
    "event_id",
    "ts_open_ms",
    "event_type",
    "horizon",
    "forward_return_pct",
    "mfe_pct",
    "mae_pct",
    "time_to_mfe_bars",
    "time_to_mae_bars",
    "max_holding_bars_used",
    "exchange",
    "symbol",
    "timeframe",
)


def look_ahead(horizons: dict[str, tuple[int, ...]] = HORIZONS) -> int:
    """The entry bar and the longest horizon after it."""
    return 1 + max(max(h) for h in horizons.values())


#: How many shorter frames make up the next wider one at most.
_COVER = 8


def _ahead(seg: Segments, horizons: list[int]) -> Segments:
    """Add what lies ahead of a bar: ``_behind``, the number of bars after it, ``_entry`` and ``_exit{h}``, the closes of a
    trade, and ``_top{h}`` and ``_bottom{h}``, the extremes of the h bars after the entry bar, with their position.

    The extreme of a frame is that of shorter frames that cover it, so a row looks at a few of the widest frames made
    before instead of at h rows.  The first of equal extremes wins, hence the position as second sort key.  A missing
    price must not take part: a struct holding a null would sort below all others.
    """
    idx, w = seg.idx, seg.window()
    sides = {"_top": (F.greatest, F.col("high"), -F.col(idx)), "_bottom": (F.least, F.col("low"), F.col(idx))}
    seg = seg.with_columns(
        {f"{n}_row": F.when(price.isNotNull(), F.struct(price.alias("v"), at.alias("at"))) for n, (_, price, at) in sides.items()}
    )
    # Frames of one row start two rows on; wider ones start where the frames they are made of do.
    width, left, spare, made = 1, list(horizons), [f"{n}_row" for n in sides], "{}_row"
    whole = f"{seg.over()[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    first_pass = {
        "_behind": F.expr(f"count(1) {whole} - row_number() {seg.over()}"),
        "_entry": F.lead("close", 1).over(w),
        **{f"_exit{h}": F.lead("close", 1 + h).over(w) for h in horizons},
    }
    while left:
        level = [h for h in left if h <= _COVER * width] or [_COVER * width]
        first = 2 if made == "{}_row" else 0
        columns = {}
        for h in level:
            steps = sorted({*range(0, h - width + 1, width), h - width})
            for name, (best, _, _) in sides.items():
                parts = [F.lead(made.format(name), first + s).over(w) if first + s else F.col(made.format(name)) for s in steps]
                columns[f"{name}{h}"] = best(*parts) if len(parts) > 1 else parts[0]
        seg = seg.with_columns({**columns, **first_pass})
        first_pass = {}
        spare += [] if level[-1] in horizons else columns
        width, left, made = level[-1], [h for h in left if h not in level], f"{{}}{level[-1]}"
    return seg.having(seg.df.drop(*spare))


def _one_horizon(seg: Segments, h: int) -> Column:
    """Struct of the outcomes of one horizon, from what ``_ahead`` found."""
    entry = "_entry"
    usable = f"({entry} IS NOT NULL AND {entry} <> 0 AND NOT isnan({entry}) AND abs({entry}) <> double('inf'))"
    idx = seg.idx

    def pct(price: str) -> str:
        return f"CASE WHEN {usable} THEN (({price}) - {entry}) / {entry} * 100D END"

    return F.expr(
        f"""named_struct(
        'horizon', 'h+{h}',
        'forward_return_pct', {pct(f'_exit{h}')},
        'mfe_pct', {pct(f'_top{h}.v')},
        'mae_pct', {pct(f'_bottom{h}.v')},
        'time_to_mfe_bars', CASE WHEN {usable} THEN -_top{h}.at - {idx} - 1 END,
        'time_to_mae_bars', CASE WHEN {usable} THEN _bottom{h}.at - {idx} - 1 END,
        'max_holding_bars_used', CASE WHEN {usable} THEN greatest(least(_behind - 1, {h}L), 0L) ELSE 0L END)"""
    )


def outcome_columns(seg: Segments, horizons: dict[str, tuple[int, ...]] = HORIZONS) -> Segments:
    """Add ``_outcomes``: per bar the array of outcomes of its timeframe's horizons."""
    longest = sorted({h for hs in horizons.values() for h in hs})
    seg = _ahead(seg, longest)
    seg = seg.with_columns({f"_h{h}": _one_horizon(seg, h) for h in longest})
    picked = None
    for tf, hs in horizons.items():
        outcomes = F.array(*[F.col(f"_h{h}") for h in hs])
        cond = F.col("timeframe") == tf
        picked = F.when(cond, outcomes) if picked is None else picked.when(cond, outcomes)
    seg = seg.with_columns({"_outcomes": picked.otherwise(unknown_timeframe("horizons"))})
    return seg.having(seg.df.drop("_behind", "_entry", *[f"{n}{h}" for n in ("_h", "_exit", "_top", "_bottom") for h in longest]))


def outcome_rows(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of (event columns, ``_outcomes``) to one row per event and horizon."""
    return rows.select(
        *SERIES_KEYS, "event_id", "ts_open_ms", "event_type", *extra, F.inline("_outcomes")
    ).select(*OUTCOME_COLUMNS, *extra)


def build_outcomes(
    bars: DataFrame,
    events: DataFrame,
    horizons: dict[str, tuple[int, ...]] = HORIZONS,
    segments: SegmentParams = SegmentParams(),
) -> DataFrame:
    """Outcomes of every event that has a bar; events without one are dropped."""
    indexed = ensure_index(bars, SERIES_KEYS, segments.rows)
    narrow = indexed.select(*SERIES_KEYS, "ts_open_ms", "bar_idx", "high", "low", "close")
    seg = cut(narrow, SERIES_KEYS, "ts_open_ms", segments.rows, after=look_ahead(horizons))
    ahead = outcome_columns(seg, horizons).owned().select(*SERIES_KEYS, "ts_open_ms", "_outcomes")
    wanted = events.select(*SERIES_KEYS, "ts_open_ms", "event_id", "event_type")
    return outcome_rows(wanted.join(ahead, [*SERIES_KEYS, "ts_open_ms"]))


def forward_universe(
    bars: DataFrame,
    horizons: dict[str, tuple[int, ...]] = HORIZONS,
    segments: SegmentParams = SegmentParams(),
) -> DataFrame:
    """Close-to-close forward return in percent of every bar and horizon, without the tail."""
    indexed = ensure_index(bars, SERIES_KEYS, segments.rows).select(*SERIES_KEYS, "ts_open_ms", "bar_idx", "close")
    steps = sorted({h for hs in horizons.values() for h in hs})
    seg = cut(indexed, SERIES_KEYS, "ts_open_ms", segments.rows, after=max(steps))
    close = F.nullif(F.col("close"), F.lit(0.0))
    seg = seg.with_columns({f"_f{h}": (F.lead("close", h).over(seg.window()) / close - 1.0) * 100.0 for h in steps})
    picked = None
    for tf, hs in horizons.items():
        pairs = F.array(*[F.struct(F.lit(f"h+{h}").alias("horizon"), F.col(f"_f{h}").alias("forward_return_pct")) for h in hs])
        cond = F.col("timeframe") == tf
        picked = F.when(cond, pairs) if picked is None else picked.when(cond, pairs)
    long = seg.with_columns({"_pairs": picked.otherwise(unknown_timeframe("horizons"))}).owned().select(*SERIES_KEYS, "bar_idx", "ts_open_ms", F.inline("_pairs"))
    return long.filter(F.col("forward_return_pct").isNotNull())
