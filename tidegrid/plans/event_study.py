"""Event studies end to end.

``run_study`` fuses features, regimes, events and outcomes: the bars are cut into segments
once, and every frame of every step runs on that one partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.rolling import add_rolling, look_back
from tidegrid.functions.segments import cut, ensure_index
from tidegrid.operators.events import breakout_spec, event_columns, event_rows
from tidegrid.operators.features import (
    FEATURE_COLUMNS,
    SPARE,
    ema_spread,
    narrow_features,
    narrow_look_back,
    narrow_specs,
    pad_forward,
    wide_feature_specs,
)
from tidegrid.operators.leaderboard import build_leaderboard
from tidegrid.operators.outcomes import look_ahead, outcome_columns, outcome_rows
from tidegrid.operators.regimes import REGIME_COLUMNS, regime_columns, vol_rank_spec
from tidegrid.params import SERIES_KEYS, StudyParams
from tidegrid.session import cut_lineage


@dataclass(frozen=True)
class Study:
    """One row per bar with features, labels, ``_events`` and ``_outcomes``, and its views."""

    bars: DataFrame

    def stored(self) -> "Study":
        """Write the bars once; the views are then narrow scans of that table."""
        return Study(cut_lineage(self.bars))

    @property
    def features(self) -> DataFrame:
        return self.bars.select(*FEATURE_COLUMNS)

    @property
    def regimes(self) -> DataFrame:
        return self.bars.select(*REGIME_COLUMNS)

    @property
    def events(self) -> DataFrame:
        return event_rows(self.bars, F.col("composite_label"))

    @property
    def outcomes(self) -> DataFrame:
        return outcome_rows(event_rows(self.bars, F.col("composite_label"), ("_outcomes",)))

    @property
    def strong_outcomes(self) -> DataFrame:
        """Outcomes with the strength of their event, all that cells are made of."""
        rows = event_rows(self.bars, F.col("composite_label"), ("_outcomes",))
        return outcome_rows(rows, ("event_strength",))

    @property
    def leaderboard(self) -> DataFrame:
        return build_leaderboard(cut_lineage(self.strong_outcomes))


def run_study(bars_joined: DataFrame, p: StudyParams = StudyParams()) -> Study:
    """Call ``.stored()`` on the result when several views are wanted."""
    timeframes = tuple(p.horizons)
    bars = ensure_index(bars_joined, SERIES_KEYS, p.segments.rows)
    if p.features.pad_open_interest:
        bars = pad_forward(bars, "oi_base", "_oi_padded", p.segments)
    # The rank of volatility and the range level are frames over narrow features, and an
    # event compares with the bar before: the look-backs add up.
    first = wide_feature_specs(p.features)
    second = (vol_rank_spec(p.regimes), breakout_spec(p.events))
    seg = cut(
        bars,
        SERIES_KEYS,
        "ts_open_ms",
        p.segments.rows,
        before=F.greatest(look_back(first), look_back(second)) + narrow_look_back(p.features) + 1,
        after=look_ahead(p.horizons),
    )
    seg = add_rolling(narrow_features(seg, p.features, timeframes), [*narrow_specs(p.features), *first, *second], SPARE)
    seg = seg.with_columns({"ema_fast_minus_slow_pct": ema_spread()})
    seg = event_columns(regime_columns(seg, p.regimes), p.events)
    seg = outcome_columns(seg, p.horizons)
    # Only bars with an event keep their outcomes.
    seg = seg.with_columns({"_outcomes": F.when(F.size("_events") > 0, F.col("_outcomes"))})
    keep = dict.fromkeys([*FEATURE_COLUMNS, *REGIME_COLUMNS, "high", "low", "bar_idx", "_events", "_outcomes"])
    return Study(seg.owned().select(*keep))


def shock_outcomes(bars: DataFrame, p: StudyParams = StudyParams(), z_rows: int = 24, z_min: float = 2.0) -> DataFrame:
    """The smallest study: z-score of one-bar returns, first cross, outcomes with strength.

    Built-in functions only; one event type, ``EV_RETURN_SHOCK``.
    """
    from tidegrid.functions.scalars import change, event_id
    from tidegrid.operators.events import first_cross, holds
    from tidegrid.operators.features import zscore

    indexed = ensure_index(bars, SERIES_KEYS, p.segments.rows)
    narrow = indexed.select(*SERIES_KEYS, "ts_open_ms", "bar_idx", "high", "low", "close")
    seg = cut(
        narrow,
        SERIES_KEYS,
        "ts_open_ms",
        p.segments.rows,
        before=z_rows + 2,
        after=look_ahead(p.horizons),
    )
    seg = seg.with_columns({"_ret": change(F.col("close"), F.lag("close", 1).over(seg.window()))})
    seg = seg.with_columns({"_z": zscore("_ret", seg, z_rows)})
    seg = seg.with_columns({"_on": holds(F.abs("_z") >= z_min)})
    seg = seg.with_columns({"_fires": first_cross("_on", seg)})
    fired = (
        outcome_columns(seg, p.horizons)
        .owned()
        .filter("_fires")
        .withColumns({"event_type": F.lit("EV_RETURN_SHOCK"), "event_strength": F.abs("_z")})
    )
    fired = fired.withColumn("event_id", event_id("symbol", "timeframe", F.col("event_type"), "ts_open_ms"))
    return outcome_rows(fired, ("event_strength",))
