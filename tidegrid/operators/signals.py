"""Signal tables: one row per evaluated bar with a direction or the reason for none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.asof import AsofSide, asof_join
from tidegrid.functions.scalars import ms_to_date, timeframe_ms
from tidegrid.functions.segments import cut, ensure_index, with_row_index
from tidegrid.operators.joins import INSTRUMENT, mask_known_gaps
from tidegrid.params import FUNDING_INTERVAL_MS, MINUTE_MS, SERIES_KEYS, SegmentParams


def _none() -> Column:
    return F.lit(0)


def bar_move_pct(prefix: str = "") -> Column:
    opened = F.nullif(F.col(f"{prefix}open"), F.lit(0.0))
    return (F.col(f"{prefix}close") / opened - 1.0) * 100.0


def lead_lag_signal(
    bars: DataFrame, leader: str, follower: str, impulse_pct: float = 0.35, same_bar_pct: float = 0.12
) -> DataFrame:
    """The leader moves and the follower has not yet: trade the follower."""
    key = ["exchange", "timeframe", "ts_open_ms"]
    a = bars.filter(F.col("symbol") == leader).select(*key, bar_move_pct().alias("leader_move_pct"))
    b = bars.filter(F.col("symbol") == follower).select(*key, "symbol", bar_move_pct().alias("follower_move_pct"))
    lead, follow = F.col("leader_move_pct"), F.col("follower_move_pct")
    direction = (
        F.when((lead >= impulse_pct) & (follow <= same_bar_pct), 1)
        .when((lead <= -impulse_pct) & (follow >= -same_bar_pct), -1)
        .otherwise(_none())
    )
    return b.join(a, key).withColumn("direction", direction)


def compression_breakout_signal(
    bars: DataFrame, rows: int = 12, max_range_pct: float = 0.35, segments: SegmentParams = SegmentParams()
) -> DataFrame:
    """A close outside the range of the previous ``rows`` bars, where that range is narrow."""
    indexed = ensure_index(bars, SERIES_KEYS, segments.rows).select(
        *SERIES_KEYS, "ts_open_ms", "bar_idx", "high", "low", "close"
    )
    seg = cut(indexed, SERIES_KEYS, "ts_open_ms", segments.rows, before=rows)
    past = seg.frame(-rows, -1)
    seg = seg.with_columns(
        {
            "compression_high": F.max("high").over(past),
            "compression_low": F.min("low").over(past),
            "_rows": F.count(F.lit(1)).over(past),
        }
    )
    top, bottom, close = F.col("compression_high"), F.col("compression_low"), F.col("close")
    mid = (top + bottom) / 2.0
    width = F.when(mid > 0, (top - bottom) / F.nullif(mid, F.lit(0.0)) * 100.0).otherwise(F.lit(0.0))
    checked = F.col("_rows") >= rows
    out = seg.with_columns({"checked": checked, "compression_range_pct": F.when(checked, width)}).owned()
    tight = F.col("checked") & (F.col("compression_range_pct") <= max_range_pct)
    direction = F.when(tight & (close > top), 1).when(tight & (close < bottom), -1).otherwise(_none())
    reason = (
        F.when(~F.col("checked"), "warm_up")
        .when(~tight, "no_compression")
        .when(direction == 0, "no_breakout")
    )
    return out.withColumns({"condition_met": tight, "direction": direction, "skip_reason": reason}).drop("_rows")


def settlement_displacement_signal(
    bars: DataFrame,
    window_min: int = 30,
    displacement_pct: float = 0.35,
    settle_ms: int = FUNDING_INTERVAL_MS,
) -> DataFrame:
    """Fade the move into a settlement: close at settlement minus one bar against the close
    ``window_min`` before it, evaluated on the bar that ends one bar after it.

    Rows are found by their clock time, so a gap gives a reason and not another row.  Each
    bar belongs to at most one settlement: one aggregate, no self-joins.
    """
    width = timeframe_ms("timeframe")
    end = F.col("ts_open_ms") + width
    reach = F.lit(window_min * MINUTE_MS)
    settle = F.floor((end + reach) / F.lit(settle_ms)) * F.lit(settle_ms)
    at = settle - end
    rows = bars.select(*SERIES_KEYS, "close", settle.alias("settle_ms"), at.alias("_at"), width.alias("_w"))
    rows = rows.filter((F.col("_at") == reach) | (F.abs("_at") == F.col("_w")))
    pick = lambda cond: F.max(F.when(cond, F.col("close")))
    found = rows.groupBy(*SERIES_KEYS, "settle_ms").agg(
        pick(F.col("_at") == reach).alias("start_close"),
        pick(F.col("_at") == F.col("_w")).alias("last_close"),
        F.bool_or(F.col("_at") == -F.col("_w")).alias("_evaluated"),
        F.max(F.col("settle_ms") + F.col("_w")).alias("signal_ts"),
    )
    move = 100.0 * (F.col("last_close") / F.nullif(F.col("start_close"), F.lit(0.0)) - 1.0)
    usable = F.col("start_close") > 0
    shift = F.col("displacement_pct")
    direction = F.when(shift >= displacement_pct, -1).when(shift <= -displacement_pct, 1).otherwise(_none())
    return (
        found.filter("_evaluated")
        .withColumn("displacement_pct", F.when(usable, move))
        .withColumns(
            {
                "direction": direction,
                "skip_reason": F.when(F.col("start_close").isNull(), "missing_pre_window_start")
                .when(F.col("last_close").isNull(), "missing_last_pre_settlement")
                .when(direction == 0, "no_displacement"),
            }
        )
        .drop("_evaluated")
    )


def close_bars(observations: DataFrame, width_ms: int, needed: int) -> DataFrame:
    """Bars built from closes alone, labelled by their end.

    ``observations(exchange, symbol, ts_ms, value)`` with ``ts_ms`` the end of an
    observation; one at the end of a bar belongs to that bar.  Whole bars have ``needed``.
    """
    end = F.ceil(F.col("ts_ms") / F.lit(width_ms)) * F.lit(width_ms)
    return observations.groupBy(*INSTRUMENT, end.alias("bar_end_ms")).agg(
        F.min_by("value", "ts_ms").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts_ms").alias("close"),
        F.count(F.lit(1)).alias("observations"),
        (F.count(F.lit(1)) == needed).alias("complete"),
    )


def funding_premium_signal(
    price_bars: DataFrame,
    premium: DataFrame,
    funding: DataFrame,
    gaps: DataFrame | None = None,
    width_ms: int = 5 * MINUTE_MS,
    needed: int = 5,
    funding_min: float = 1e-4,
    premium_min: float = 1.5e-4,
    segments: SegmentParams = SegmentParams(),
) -> DataFrame:
    """High funding while the premium falls over a bar: short; the mirror image: long.

    ``price_bars(exchange, symbol, bar_end_ms)``; only whole premium bars outside known gaps
    count, and funding only from its own time on.
    """
    bars = close_bars(premium, width_ms, needed).withColumn("bar_start_ms", F.col("bar_end_ms") - F.lit(width_ms))
    if gaps is None:
        bars = bars.withColumn("known_gap", F.lit(False))
    else:
        bars = mask_known_gaps(bars, gaps, F.lit(width_ms), start="bar_start_ms")
    side = bars.select(
        *INSTRUMENT,
        "bar_end_ms",
        (F.col("close") - F.col("open")).alias("premium_delta"),
        (F.col("complete") & ~F.col("known_gap")).alias("_whole"),
        "known_gap",
    )
    joined = price_bars.select(*INSTRUMENT, "bar_end_ms").join(side, [*INSTRUMENT, "bar_end_ms"], "left")
    matched = asof_join(
        joined,
        [AsofSide("_funding", funding, "ts_settle_ms", ("funding_rate",))],
        INSTRUMENT,
        "bar_end_ms",
        segments.asof_bucket_ms,
    ).withColumn("funding_rate", F.col("_funding.funding_rate")).drop("_funding")
    rate, delta = F.col("funding_rate"), F.col("premium_delta")
    reason = (
        F.when(F.col("_whole").isNull(), "missing_premium")
        .when(F.col("known_gap"), "known_gap")
        .when(~F.col("_whole"), "incomplete_premium")
        .when(rate.isNull(), "missing_funding")
    )
    found = (
        F.when((rate >= funding_min) & (delta <= -premium_min), -1)
        .when((rate <= -funding_min) & (delta >= premium_min), 1)
        .otherwise(_none())
    )
    out = matched.withColumns({"_reason": reason, "direction": F.when(reason.isNull(), found).otherwise(_none())})
    return out.select(
        *INSTRUMENT,
        "bar_end_ms",
        "premium_delta",
        "funding_rate",
        F.coalesce("known_gap", F.lit(False)).alias("known_gap"),
        "direction",
        F.when(F.col("_reason").isNotNull(), F.col("_reason")).when(F.col("direction") == 0, "no_condition").alias("skip_reason"),
    )


def history_zscore(
    funding: DataFrame, history: int = 90, segments: SegmentParams = SegmentParams()
) -> DataFrame:
    """z-score against the ``history`` settlements before this one (population deviation),
    only with a full history."""
    bucket = F.floor(F.col("ts_settle_ms") / F.lit(FUNDING_INTERVAL_MS * segments.rows))
    indexed = with_row_index(funding, INSTRUMENT, ["ts_settle_ms"], bucket, out="_at")
    seg = cut(indexed, INSTRUMENT, "ts_settle_ms", segments.rows, before=history, idx="_at")
    past, rate = seg.frame(-history, -1), F.col("funding_rate")
    z = (rate - F.avg(rate).over(past)) / F.nullif(F.stddev_pop(rate).over(past), F.lit(0.0))
    return seg.with_columns({"funding_zscore": F.when(F.count(rate).over(past) >= history, z)}).owned().drop("_at")


def funding_zscore_signal(
    funding: DataFrame,
    z_min: float = 2.0,
    history: int = 90,
    follow_sign: bool = False,
    segments: SegmentParams = SegmentParams(),
) -> DataFrame:
    """Long on an extreme of either sign; with ``follow_sign`` in the direction of it."""
    z = F.col("funding_zscore")
    side = F.signum(z).cast("int") if follow_sign else F.lit(1)
    direction = F.when(F.abs(z) >= z_min, side).otherwise(_none())
    return history_zscore(funding, history, segments).withColumn("direction", direction)


def signal_funnel(signals: DataFrame, ts: str, reasons: tuple[str, ...]) -> DataFrame:
    """Per symbol and day: rows checked, signals each way, and one count per reason."""
    return signals.groupBy(*INSTRUMENT, ms_to_date(ts).alias("date")).agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(F.col("direction") > 0).alias("long_signals"),
        F.count_if(F.col("direction") < 0).alias("short_signals"),
        *[F.count_if(F.col("skip_reason") == r).alias(r) for r in reasons],
    )
