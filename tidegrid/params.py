"""Typed parameters.  All thresholds of the library live here."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values -----------------------------------------------------------------------
# Names, thresholds and horizons that results depend on.

SERIES_KEYS = ("exchange", "symbol", "timeframe")

HORIZONS = {
    "5m": (1, 3, 12, 72),
    "1h": (1, 3, 12, 24, 72),
}

EVENT_TYPES = (
    "EV_FUND_FLIP",
    "EV_FUND_EXTREME",
    "EV_OI_SPIKE_UP",
    "EV_OI_FLUSH",
    "EV_VOL_BREAKOUT",
    "EV_FUNDING_WINDOW_PRE",
    "EV_PREMIUM_SPIKE",
    "EV_PREMIUM_COMPRESSION",
)

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
FUNDING_INTERVAL_MS = 28_800_000


@dataclass(frozen=True)
class FeatureParams:
    ema_fast: int = 12
    ema_slow: int = 48
    atr: int = 14
    vol: int = 24
    slope: int = 24
    zscore: int = 24
    wide_days: int = 30
    wide_min_days: int = 7
    funding_interval_min: int = 480
    funding_window_min: int = 30
    state_ttl_ms: int = 60 * MINUTE_MS
    # Carry open interest forward over missing samples before taking changes.  Off: a value
    # older than its time-to-live is never used.
    pad_open_interest: bool = False


@dataclass(frozen=True)
class RegimeParams:
    trend_ema_min: float = 0.005
    trend_slope_min: float = 0.0
    vol_low: float = 33.0 / 100.0
    vol_high: float = 66.0 / 100.0
    vol_days: int = 7
    vol_min_rows: int = 24
    funding_flat: float = 1.0 / 1e4
    funding_extreme: float = 5.0 / 1e4
    funding_z_extreme: float = 2.0
    basis_bp: float = 5.0
    liquidity_thin: float = -1.0
    liquidity_thick: float = 1.0


@dataclass(frozen=True)
class EventParams:
    flip_min_bp: float = 0.5
    extreme_z: float = 2.0
    extreme_rate: float = 5.0 / 1e4
    oi_change: float = 0.03
    oi_z_min: float = 1.0
    breakout_quantile: float = 0.99
    breakout_days: int = 30
    breakout_min_days: int = 3
    breakout_min_rows: int = 24
    breakout_z: float = 2.0
    premium_z: float = 2.0
    pre_funding_min: float = 30.0


@dataclass(frozen=True)
class FrictionParams:
    """Round-trip friction in percent, and per-side rates as fractions."""

    taker_round_trip: float = 0.18
    maker_round_trip: float = 0.10
    # The rule text states a lower round trip for a pure maker trade than the statistics use.
    maker_round_trip_rules: float = 0.08
    fee_only_round_trip: float = 0.08
    taker_fee_side: float = 0.0004
    maker_fee_side: float = 0.0002
    taker_slippage_side: float = 0.0005
    pre_fee_floor_taker: float = 0.30
    pre_fee_floor_maker: float = 0.20


@dataclass(frozen=True)
class StabilityParams:
    folds: int = 3
    min_n: int = 80
    perms: int = 1000
    seed: int = 17
    p_pass: float = 0.05
    p_pass_maker: float = 0.10


@dataclass(frozen=True)
class SelectionParams:
    min_n: int = 80
    min_hit: float = 0.55
    min_ratio: float = 1.0
    min_n_ranking: int = 30


@dataclass(frozen=True)
class SegmentParams:
    """How a long series is cut so that no task ever holds a whole one."""

    rows: int = 32_768
    asof_bucket_ms: int = 7 * DAY_MS


@dataclass(frozen=True)
class StudyParams:
    features: FeatureParams = field(default_factory=FeatureParams)
    regimes: RegimeParams = field(default_factory=RegimeParams)
    events: EventParams = field(default_factory=EventParams)
    friction: FrictionParams = field(default_factory=FrictionParams)
    stability: StabilityParams = field(default_factory=StabilityParams)
    selection: SelectionParams = field(default_factory=SelectionParams)
    segments: SegmentParams = field(default_factory=SegmentParams)
    horizons: dict = field(default_factory=lambda: dict(HORIZONS))
