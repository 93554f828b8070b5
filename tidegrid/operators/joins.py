"""Putting sparse series on the bar grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.asof import AsofSide, asof_join
from tidegrid.params import MINUTE_MS, SERIES_KEYS, FeatureParams, SegmentParams

INSTRUMENT = ("exchange", "symbol")
OI_COLUMNS = ("oi_base", "oi_value_quote")
CROWDING_COLUMNS = ("long_short_account_ratio", "top_trader_position_ratio", "taker_long_short_vol_ratio")


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the first row per key in ``order`` (file and row position for stored data).

    An aggregate, not a window: copies of one key collapse before the shuffle, so a key with
    very many copies is no hot spot.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_first")
    kept = df.groupBy(*keys).agg(first)
    return kept.select(*keys, "_first.*").select(*df.columns)


def physical_order() -> tuple[Column, Column]:
    """Where a Parquet row is stored; use it in the select that reads the files."""
    return F.col("_metadata.file_path"), F.col("_metadata.row_index")


def funding_columns(match: Column) -> dict[str, Column]:
    """Rate while it is younger than its own interval; the countdown is never masked."""
    age = F.col("ts_open_ms") - match["ts"]
    fresh = age <= F.coalesce(match["funding_interval_ms"], F.lit(0))
    return {
        "funding_rate_ffill": F.when(fresh, match["funding_rate"]),
        "funding_minutes_to_next": (match["ts"] + match["funding_interval_ms"] - F.col("ts_open_ms"))
        / F.lit(float(MINUTE_MS)),
    }


def fresh_columns(match: Column, names: Sequence[str], ttl_ms: int) -> dict[str, Column]:
    fresh = F.col("ts_open_ms") - match["ts"] <= F.lit(ttl_ms)
    return {n: F.when(fresh, match[n]) for n in names}


def asof_funding(bars: DataFrame, funding: DataFrame, segments: SegmentParams = SegmentParams()) -> DataFrame:
    side = AsofSide("_funding", funding, "ts_settle_ms", ("funding_rate", "funding_interval_ms"))
    out = asof_join(bars, [side], INSTRUMENT, "ts_open_ms", segments.asof_bucket_ms)
    return out.withColumns(funding_columns(F.col("_funding"))).drop("_funding")


def asof_oi(
    bars: DataFrame, oi: DataFrame, ttl_ms: int = 60 * MINUTE_MS, segments: SegmentParams = SegmentParams()
) -> DataFrame:
    out = asof_join(bars, [AsofSide("_oi", oi, "ts_ms", OI_COLUMNS)], INSTRUMENT, "ts_open_ms", segments.asof_bucket_ms)
    return out.withColumns(fresh_columns(F.col("_oi"), OI_COLUMNS, ttl_ms)).drop("_oi")


def asof_crowding(
    bars: DataFrame, oi: DataFrame, ttl_ms: int = 60 * MINUTE_MS, segments: SegmentParams = SegmentParams()
) -> DataFrame:
    side = AsofSide("_crowd", oi, "ts_ms", CROWDING_COLUMNS)
    out = asof_join(bars, [side], INSTRUMENT, "ts_open_ms", segments.asof_bucket_ms)
    return out.withColumns(fresh_columns(F.col("_crowd"), CROWDING_COLUMNS, ttl_ms)).drop("_crowd")


def join_closes(bars: DataFrame, mark: DataFrame, index: DataFrame) -> DataFrame:
    """Mark and index closes of exactly the same bar.

    Both closes come from one aggregate per bar instead of two joins.  A side holds one close per
    bar (``dedupe_keep_first`` makes it so); different closes of one bar are an error.
    """

    def only(name: str) -> Column:
        found = F.when(F.min(name).eqNullSafe(F.max(name)), F.max(name))
        return found.otherwise(F.raise_error(F.lit(f"several values of {name} for one bar"))).alias(name)

    key = [*SERIES_KEYS, "ts_open_ms"]
    closes = (
        mark.select(*key, "mark_close", F.lit(None).cast("double").alias("index_close"))
        .unionByName(index.select(*key, F.lit(None).cast("double").alias("mark_close"), "index_close"))
        .groupBy(*key)
        .agg(only("mark_close"), only("index_close"))
    )
    return bars.join(closes, key, "left")


def join_state(
    bars: DataFrame,
    funding: DataFrame,
    oi: DataFrame,
    mark: DataFrame,
    index: DataFrame,
    p: FeatureParams = FeatureParams(),
    segments: SegmentParams = SegmentParams(),
) -> DataFrame:
    """Bars with funding, open interest, crowding ratios and closes.

    Right sides must hold one row per time (see ``dedupe_keep_first``).  Funding, open
    interest and crowding are matched in a single shuffle.
    """
    sides = [
        AsofSide("_funding", funding, "ts_settle_ms", ("funding_rate", "funding_interval_ms")),
        AsofSide("_oi", oi, "ts_ms", (*OI_COLUMNS, *CROWDING_COLUMNS)),
    ]
    out = asof_join(join_closes(bars, mark, index), sides, INSTRUMENT, "ts_open_ms", segments.asof_bucket_ms)
    return out.withColumns(
        {
            **funding_columns(F.col("_funding")),
            **fresh_columns(F.col("_oi"), (*OI_COLUMNS, *CROWDING_COLUMNS), p.state_ttl_ms),
        }
    ).drop("_funding", "_oi")


def bar_of(ts: Column, width: Column) -> Column:
    return F.floor(ts / width) * width


def mask_known_gaps(
    bars: DataFrame, gaps: DataFrame, width: Column, start: str = "ts_open_ms", by: Sequence[str] = ()
) -> DataFrame:
    """Add ``known_gap``: does the bar [start, start + width) hold a time of ``gaps(gap_ms)``?

    Bars lie on a grid, so the range join is an equality join on the bar a gap falls into.
    """
    by = list(by)
    hit = gaps.select(*by, bar_of(F.col("gap_ms"), width).alias(start)).distinct().withColumn("known_gap", F.lit(True))
    return bars.join(hit, [*by, start], "left").withColumn("known_gap", F.coalesce("known_gap", F.lit(False)))
