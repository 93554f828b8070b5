"""Statistics per cell, a cell being (series, event type, horizon)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.quantiles import exact_medians
from tidegrid.functions.scalars import horizon_bars
from tidegrid.params import SERIES_KEYS

CELL = (*SERIES_KEYS, "event_type", "horizon")

LEADERBOARD_COLUMNS = (
    "event_type",
    "horizon",
    "count",
    "count_incomplete",
    "mean_forward_return",
    "median_forward_return",
    "hit_rate_at_zero",
    "median_mfe",
    "median_mae",
    "mfe_mae_ratio",
    "sharpe_like",
    "mean_event_strength",
    *SERIES_KEYS,
)


def mean_strength(events: DataFrame) -> DataFrame:
    return events.groupBy(*SERIES_KEYS, "event_type").agg(F.avg("event_strength").alias("mean_event_strength"))


def build_leaderboard(outcomes: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """``events`` gives the mean strength per event type.  Without it the outcomes must carry
    ``event_strength``: every event has one row per horizon, so the mean is the same."""
    fr = F.col("forward_return_pct")
    moments = [
        F.count(fr).alias("count"),
        (F.count(F.lit(1)) - F.count(fr)).alias("count_incomplete"),
        F.avg(fr).alias("mean_forward_return"),
        F.avg((fr > 0).cast("double")).alias("hit_rate_at_zero"),
        F.stddev_samp(fr).alias("_std"),
    ]
    if events is None:
        moments.append(F.avg("event_strength").alias("mean_event_strength"))
    # Excursions of cut-off windows count towards their medians.
    cells = exact_medians(
        outcomes,
        CELL,
        {"forward_return_pct": "median_forward_return", "mfe_pct": "median_mfe", "mae_pct": "median_mae"},
        moments,
        stored=True,
    )
    if events is not None:
        cells = cells.join(mean_strength(events), [*SERIES_KEYS, "event_type"], "left")
    return cells.withColumns(
        {
            "mfe_mae_ratio": F.col("median_mfe") / F.nullif(F.abs("median_mae"), F.lit(0.0)),
            "sharpe_like": F.col("mean_forward_return") / F.nullif(F.col("_std"), F.lit(0.0)),
        }
    ).select(*LEADERBOARD_COLUMNS)


def canonical_order(cells: DataFrame) -> DataFrame:
    """By event type, then by the length of the horizon rather than its text."""
    return cells.orderBy("event_type", horizon_bars("horizon"), *SERIES_KEYS)
