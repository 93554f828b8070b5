"""Leak-free features: each uses its own bar and earlier ones only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.asof import AsofSide, asof_join
from tidegrid.functions.rolling import Rolling, add_rolling, look_back
from tidegrid.functions.scalars import bars_per, change, timeframe_ms, unknown_timeframe
from tidegrid.functions.segments import Segments, cut, ensure_index
from tidegrid.params import HOUR_MS, MINUTE_MS, SERIES_KEYS, FeatureParams, SegmentParams

FEATURE_COLUMNS = (
    "ts_open_ms",
    "ts_close_ms",
    "exchange",
    "symbol",
    "timeframe",
    "close",
    "ret_1",
    "ret_3",
    "ret_12",
    "ret_72",
    "vol_close_to_close_24",
    "atr_14",
    "range_pct",
    "ema_fast_minus_slow_pct",
    "slope_ret_24",
    "vol_zscore_24",
    "taker_imbalance",
    "taker_quote_zscore_24",
    "funding_rate_ffill",
    "funding_rate_zscore_30d",
    "funding_minutes_to_next",
    "pre_funding_30m",
    "post_funding_30m",
    "funding_settle_bar",
    "basis_bp",
    "basis_zscore_24",
    "oi_base",
    "oi_pct_change_1h",
    "oi_pct_change_24h",
    "oi_zscore_30d",
    "long_short_account_ratio",
    "top_trader_position_ratio",
    "taker_long_short_vol_ratio",
)

RETURN_STEPS = (1, 3, 12, 72)
OI_SPANS_H = {"oi_pct_change_1h": 1, "oi_pct_change_24h": 24}


# ---- per-row expressions ----------------------------------------------------------------


def range_pct() -> Column:
    return (F.col("high") - F.col("low")) / F.nullif(F.col("close"), F.lit(0.0))


def taker_imbalance() -> Column:
    volume = F.col("volume_base")
    return (F.lit(2.0) * F.col("taker_buy_base") - volume) / F.nullif(volume, F.lit(0.0))


def basis_bp() -> Column:
    index = F.nullif(F.col("index_close"), F.lit(0.0))
    return (F.col("mark_close") - index) / index * F.lit(1e4)


def funding_window_flags(p: FeatureParams = FeatureParams()) -> dict[str, Column]:
    """Flags are 0, not null, where the time to the next settlement is unknown."""
    left = F.col("funding_minutes_to_next")
    since = F.lit(p.funding_interval_min) - left
    valid = left.between(-1, p.funding_interval_min + 1)
    half_bar = timeframe_ms("timeframe") / F.lit(2.0 * MINUTE_MS)

    def flag(cond: Column) -> Column:
        return F.coalesce((cond & valid).cast("byte"), F.lit(0).cast("byte"))

    return {
        "pre_funding_30m": flag((left > 0) & (left <= p.funding_window_min)),
        "post_funding_30m": flag(since.between(0, p.funding_window_min) & (left > 0)),
        "funding_settle_bar": flag(F.abs(left) <= half_bar),
    }


# ---- frames of a few rows ------------------------------------------------------------------


def zscore(name: str, seg: Segments, rows: int) -> Column:
    frame = seg.over(-(rows - 1), 0)
    z = f"({name} - avg({name}) {frame}) / nullif(stddev_samp({name}) {frame}, 0D)"
    return F.expr(f"CASE WHEN count({name}) {frame} >= {rows} THEN {z} END")


def lag_by_span(name: str, seg: Segments, span_ms: int, timeframes: tuple[str, ...]) -> Column:
    """Value ``span_ms`` of bars earlier; the number of rows depends on the timeframe."""
    from tidegrid.functions.rolling import _per_day

    hours = span_ms // HOUR_MS
    picked = None
    for tf in timeframes:
        step = max(_per_day(tf) // 24 * hours, 1)
        here = F.lag(name, step).over(seg.window())
        picked = F.when(F.col("timeframe") == tf, here) if picked is None else picked.when(F.col("timeframe") == tf, here)
    return picked.otherwise(unknown_timeframe("lags"))


def narrow_features(seg: Segments, p: FeatureParams, timeframes: tuple[str, ...]) -> Segments:
    w = seg.window()
    close = F.col("close")
    oi = "_oi_padded" if p.pad_open_interest else "oi_base"
    prev = F.lag("close", 1).over(w)
    high, low = F.col("high"), F.col("low")
    # All looks back in one pass.
    seg = seg.with_columns(
        {
            **{f"ret_{n}": change(close, F.lag("close", n).over(w)) for n in RETURN_STEPS},
            # greatest() skips nulls, so the first bar has high - low.
            "_tr": F.greatest(F.abs(high - low), F.abs(high - prev), F.abs(low - prev)),
            "range_pct": range_pct(),
            "taker_imbalance": taker_imbalance(),
            "basis_bp": basis_bp(),
            "_log_close": F.ln(close),
            **funding_window_flags(p),
            **{
                out: change(F.col(oi), lag_by_span(oi, seg, hours * HOUR_MS, timeframes))
                for out, hours in OI_SPANS_H.items()
            },
        }
    )
    return seg.having(seg.df.drop(*UNUSED))


def narrow_specs(p: FeatureParams) -> tuple[Rolling, ...]:
    """Frames of a few rows: cheaper over all rows of a segment at once than row by row."""
    return (
        Rolling("vol_close_to_close_24", "full_spread", "ret_1", rows=p.vol),
        Rolling("slope_ret_24", "full_slope", "_log_close", rows=p.slope),
        Rolling("vol_zscore_24", "full_zscore", "ret_1", rows=p.zscore),
        Rolling("taker_quote_zscore_24", "full_zscore", "taker_buy_quote", rows=p.zscore),
        Rolling("basis_zscore_24", "full_zscore", "basis_bp", rows=p.zscore),
    )


#: Columns of the joined bars that no statistic reads, and those that nothing reads after the statistics.
UNUSED = ("open", "volume_base", "volume_quote", "trades", "taker_buy_base", "mean_px", "mark_close", "index_close", "oi_value_quote", "funding_interval_ms")
SPARE = ("_tr", "_log_close", "taker_buy_quote")


def pad_forward(bars: DataFrame, name: str, out: str, segments: SegmentParams) -> DataFrame:
    """Last known value of a column, however long ago: an as-of join with itself."""
    known = bars.filter(F.col(name).isNotNull()).select(*SERIES_KEYS, "ts_open_ms", name)
    side = AsofSide("_known", known, "ts_open_ms", (name,))
    joined = asof_join(bars, [side], SERIES_KEYS, "ts_open_ms", segments.asof_bucket_ms)
    return joined.withColumn(out, F.col("_known")[name]).drop("_known")


def wide_feature_specs(p: FeatureParams) -> tuple[Rolling, ...]:
    wide = {"days": p.wide_days, "min_days": p.wide_min_days}
    return (
        Rolling("atr_14", "ewm", "_tr", min_rows=p.atr, arg=1.0 / p.atr),
        Rolling("_ema_fast", "ewm", "close", min_rows=p.ema_fast, arg=2.0 / (p.ema_fast + 1)),
        Rolling("_ema_slow", "ewm", "close", min_rows=p.ema_slow, arg=2.0 / (p.ema_slow + 1)),
        Rolling("funding_rate_zscore_30d", "zscore", "funding_rate_ffill", **wide),
        Rolling("oi_zscore_30d", "zscore", "oi_base", **wide),
    )


def ema_spread() -> Column:
    return (F.col("_ema_fast") - F.col("_ema_slow")) / F.nullif(F.col("close"), F.lit(0.0))


def narrow_look_back(p: FeatureParams) -> Column:
    """Rows behind the narrow features: the longest return or open-interest step, or a
    frame over one-bar returns."""
    a_day = bars_per("timeframe", 24 * HOUR_MS)
    fixed = max(*RETURN_STEPS, p.vol + 1, p.slope, p.zscore + 1)
    return F.greatest(F.lit(fixed), a_day)


def build_features(
    bars_joined: DataFrame,
    p: FeatureParams = FeatureParams(),
    segments: SegmentParams = SegmentParams(),
    timeframes: tuple[str, ...] = ("5m", "1h"),
) -> DataFrame:
    """33 columns per bar.  ``bars_joined`` comes from ``operators.joins.join_state``."""
    bars = ensure_index(bars_joined, SERIES_KEYS, segments.rows)
    if p.pad_open_interest:
        bars = pad_forward(bars, "oi_base", "_oi_padded", segments)
    specs = wide_feature_specs(p)
    seg = cut(bars, SERIES_KEYS, "ts_open_ms", segments.rows, before=look_back(specs) + narrow_look_back(p))
    seg = add_rolling(narrow_features(seg, p, timeframes), [*narrow_specs(p), *specs], SPARE)
    return seg.with_columns({"ema_fast_minus_slow_pct": ema_spread()}).owned().select(*FEATURE_COLUMNS, "bar_idx")


def non_null_counts(features: DataFrame) -> DataFrame:
    """Per series: how many rows have each feature."""
    names = [c for c in FEATURE_COLUMNS if c not in ("ts_open_ms", "ts_close_ms", *SERIES_KEYS)]
    return features.groupBy(*SERIES_KEYS).agg(*[F.count(c).alias(c) for c in names])
