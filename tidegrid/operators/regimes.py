"""Categorical labels per bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.rolling import Rolling, add_rolling, look_back
from tidegrid.functions.segments import Segments, cut, ensure_index
from tidegrid.params import SERIES_KEYS, RegimeParams, SegmentParams

MISSING = "insufficient_data"

# Fixed order and tags of the composite label.
TAGS = (
    ("trend_regime", "T"),
    ("vol_regime", "V"),
    ("funding_regime", "F"),
    ("basis_regime", "B"),
    ("crowding_regime", "C"),
    ("liquidity_regime", "L"),
)


def _three_way(value: Column, low: float, high: float, names: tuple[str, str, str]) -> Column:
    below, between, above = names
    return (
        F.when(value.isNull(), MISSING).when(value < low, below).when(value > high, above).otherwise(between)
    )


def trend_regime(p: RegimeParams = RegimeParams()) -> Column:
    spread, slope = F.col("ema_fast_minus_slow_pct"), F.col("slope_ret_24")
    return (
        F.when(spread.isNull() | slope.isNull(), MISSING)
        .when((spread > p.trend_ema_min) & (slope > p.trend_slope_min), "up_trend")
        .when((spread < -p.trend_ema_min) & (slope < -p.trend_slope_min), "down_trend")
        .otherwise("chop")
    )


def vol_regime(rank: Column, p: RegimeParams = RegimeParams()) -> Column:
    return _three_way(rank, p.vol_low, p.vol_high, ("low", "mid", "high"))


def funding_regime(p: RegimeParams = RegimeParams()) -> Column:
    """Extreme is decided before flat: a tiny rate with a large z-score is extreme."""
    rate, z = F.col("funding_rate_ffill"), F.col("funding_rate_zscore_30d")
    size = F.abs(rate)
    extreme = (size >= p.funding_extreme) | F.coalesce(F.abs(z) >= p.funding_z_extreme, F.lit(False))
    side = F.when(rate > 0, "pos").otherwise("neg")
    return (
        F.when(rate.isNull(), MISSING)
        .when(rate == 0, "flat")
        .when(extreme, F.concat(side, F.lit("_extreme")))
        .when(size < p.funding_flat, "flat")
        .otherwise(F.concat(side, F.lit("_normal")))
    )


def basis_regime(p: RegimeParams = RegimeParams()) -> Column:
    return _three_way(F.col("basis_bp"), -p.basis_bp, p.basis_bp, ("discount_rich", "neutral", "premium_rich"))


def crowding_regime() -> Column:
    return F.when(F.col("top_trader_position_ratio").isNull(), MISSING).otherwise("balanced")


def liquidity_regime(p: RegimeParams = RegimeParams()) -> Column:
    z = F.col("taker_quote_zscore_24")
    return _three_way(z, p.liquidity_thin, p.liquidity_thick, ("thin", "normal", "thick"))


def composite_label() -> Column:
    def part(name: str, tag: str) -> Column:
        label = F.when(F.col(name) == MISSING, "ID").otherwise(F.col(name))
        return F.concat(F.lit(f"{tag}="), label)

    return F.concat_ws("|", *[part(n, t) for n, t in TAGS])


def confidence() -> Column:
    known = sum(((F.col(n) != MISSING).cast("int") for n, _ in TAGS), F.lit(0))
    return F.round(known / F.lit(float(len(TAGS))), 3)


def vol_rank_spec(p: RegimeParams = RegimeParams()) -> Rolling:
    """Needs half of the frame."""
    return Rolling(
        "_vol_rank", "rank", "vol_close_to_close_24", days=p.vol_days, min_days=p.vol_days / 2, min_rows=p.vol_min_rows
    )


def regime_columns(seg: Segments, p: RegimeParams = RegimeParams()) -> Segments:
    """Labels on rows that have the features and ``_vol_rank``."""
    labels = {
        "trend_regime": trend_regime(p),
        "vol_regime": vol_regime(F.col("_vol_rank"), p),
        "funding_regime": funding_regime(p),
        "basis_regime": basis_regime(p),
        "crowding_regime": crowding_regime(),
        "liquidity_regime": liquidity_regime(p),
    }
    return seg.with_columns(labels).with_columns({"composite_label": composite_label(), "confidence": confidence()})


REGIME_COLUMNS = (
    "ts_open_ms",
    "ts_close_ms",
    "exchange",
    "symbol",
    "timeframe",
    *[n for n, _ in TAGS],
    "composite_label",
    "confidence",
)


def build_regimes(
    features: DataFrame, p: RegimeParams = RegimeParams(), segments: SegmentParams = SegmentParams()
) -> DataFrame:
    feats = ensure_index(features, SERIES_KEYS, segments.rows)
    spec = vol_rank_spec(p)
    seg = cut(feats, SERIES_KEYS, "ts_open_ms", segments.rows, before=look_back([spec]))
    return regime_columns(add_rolling(seg, [spec]), p).owned().select(*REGIME_COLUMNS)


def latest_regime(regimes: DataFrame) -> DataFrame:
    """Last label of every series."""
    last = F.max_by(F.struct("ts_open_ms", "composite_label", "confidence"), "ts_open_ms").alias("_last")
    return regimes.groupBy(*SERIES_KEYS).agg(last).select(*SERIES_KEYS, "_last.*")
