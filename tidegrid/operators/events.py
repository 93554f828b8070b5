"""Edge-triggered events: a condition that holds now and did not hold one bar before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.rolling import Rolling, add_rolling, look_back
from tidegrid.functions.scalars import event_id
from tidegrid.functions.segments import Segments, cut, ensure_index
from tidegrid.params import SERIES_KEYS, EventParams, SegmentParams

EVENT_COLUMNS = (
    "event_id",
    "ts_open_ms",
    "event_type",
    "event_strength",
    "context_regime",
    "exchange",
    "symbol",
    "timeframe",
)


def breakout_spec(p: EventParams = EventParams()) -> Rolling:
    return Rolling(
        "_range_level",
        "quantile",
        "range_pct",
        days=p.breakout_days,
        min_days=p.breakout_min_days,
        min_rows=p.breakout_min_rows,
        arg=p.breakout_quantile,
    )


def holds(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def first_cross(cond: str, seg: Segments) -> Column:
    """True where the boolean column starts to hold; the first row of a series may fire."""
    return F.col(cond) & ~F.coalesce(F.lag(cond).over(seg.window()), F.lit(False))


def sign_flip(name: str, seg: Segments, min_bp: float) -> tuple[Column, Column]:
    """Condition and size (in bp) of a sign change between neighbours, zero being no sign."""
    now, prev = F.col(name), F.lag(name).over(seg.window())
    size = F.abs(now - prev) * F.lit(1e4)
    return holds((F.signum(now) * F.signum(prev) < 0) & (size >= min_bp)), size


def level_conditions(p: EventParams) -> dict[str, tuple[Column, Column]]:
    """(condition, strength) of the seven detectors that watch a level."""
    fund_z, rate = F.col("funding_rate_zscore_30d"), F.col("funding_rate_ffill")
    oi_pct, oi_z = F.col("oi_pct_change_1h"), F.col("oi_zscore_30d")
    taker_z, basis_z = F.col("taker_quote_zscore_24"), F.col("basis_zscore_24")
    left = F.least(F.greatest(F.col("funding_minutes_to_next"), F.lit(0.0)), F.lit(p.pre_funding_min))
    return {
        "EV_FUND_EXTREME": (
            (F.abs(fund_z) >= p.extreme_z) | (fund_z.isNull() & (F.abs(rate) >= p.extreme_rate)),
            F.coalesce(F.abs(fund_z), F.abs(rate) / p.extreme_rate * p.extreme_z),
        ),
        "EV_OI_SPIKE_UP": (
            (oi_pct > p.oi_change) & (oi_z.isNull() | (oi_z > p.oi_z_min)),
            F.coalesce(oi_z, oi_pct / p.oi_change),
        ),
        "EV_OI_FLUSH": (oi_pct < -p.oi_change, F.abs(oi_pct) / p.oi_change),
        "EV_VOL_BREAKOUT": ((F.col("range_pct") >= F.col("_range_level")) & (taker_z > p.breakout_z), taker_z),
        "EV_FUNDING_WINDOW_PRE": (F.col("pre_funding_30m") == 1, (p.pre_funding_min - left) / p.pre_funding_min),
        "EV_PREMIUM_SPIKE": (basis_z >= p.premium_z, basis_z),
        "EV_PREMIUM_COMPRESSION": (basis_z <= -p.premium_z, F.abs(basis_z)),
    }


def event_columns(seg: Segments, p: EventParams = EventParams()) -> Segments:
    """Add ``_events``: the events of each bar, as an array."""
    levels = level_conditions(p)
    flip, flip_size = sign_flip("funding_rate_ffill", seg, p.flip_min_bp)
    seg = seg.with_columns({f"_on_{n}": holds(c) for n, (c, _) in levels.items()})

    def event(name: str, fires: Column, strength: Column) -> Column:
        return F.when(fires, F.struct(F.lit(name).alias("event_type"), strength.cast("double").alias("event_strength")))

    # All looks at the bar before in one pass.
    found = [event("EV_FUND_FLIP", flip, flip_size)]
    found += [event(n, first_cross(f"_on_{n}", seg), s) for n, (_, s) in levels.items()]
    seg = seg.with_columns({"_events": F.array_compact(F.array(*found))})
    return seg.having(seg.df.drop(*[f"_on_{n}" for n in levels]))


def event_rows(bars_with_events: DataFrame, context: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per event; the bars are read once for all detectors."""
    long = bars_with_events.filter(F.size("_events") > 0).select(
        *SERIES_KEYS, "ts_open_ms", context.alias("context_regime"), *extra, F.inline("_events")
    )
    return long.withColumn("event_id", event_id("symbol", "timeframe", F.col("event_type"), "ts_open_ms")).select(
        *EVENT_COLUMNS, *extra
    )


def attach_context(events: DataFrame, regimes: DataFrame) -> DataFrame:
    """Composite label at the bar of the event, ``unknown`` where the bar has none."""
    labels = regimes.select(*SERIES_KEYS, "ts_open_ms", F.col("composite_label").alias("_label"))
    joined = events.drop("context_regime").join(labels, [*SERIES_KEYS, "ts_open_ms"], "left")
    return joined.withColumn("context_regime", F.coalesce("_label", F.lit("unknown"))).select(*EVENT_COLUMNS)


def detect_events(
    features: DataFrame,
    regimes: DataFrame | None = None,
    p: EventParams = EventParams(),
    segments: SegmentParams = SegmentParams(),
) -> DataFrame:
    feats = ensure_index(features, SERIES_KEYS, segments.rows)
    spec = breakout_spec(p)
    seg = cut(feats, SERIES_KEYS, "ts_open_ms", segments.rows, before=look_back([spec]) + 1)
    seg = event_columns(add_rolling(seg, [spec]), p)
    events = event_rows(seg.owned(), F.lit("unknown"))
    return events if regimes is None else attach_context(events, regimes)


def event_counts(events: DataFrame, event_types: tuple[str, ...]) -> DataFrame:
    """Per series one column for each event type, zero where there is none."""
    return events.groupBy(*SERIES_KEYS).agg(
        *[F.count_if(F.col("event_type") == n).alias(n) for n in event_types]
    )
