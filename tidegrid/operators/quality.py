"""Quality of series: completeness, duplicates, order, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import bars_per
from tidegrid.functions.segments import cut, running, with_row_index
from tidegrid.params import DAY_MS, FUNDING_INTERVAL_MS, MINUTE_MS, SERIES_KEYS, SegmentParams

INSTRUMENT = ("exchange", "symbol")


def rank_mismatches(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    physical: Sequence[str],
    physical_bucket: Column,
    sorted_bucket: Column,
) -> DataFrame:
    """Per series: rows whose stored position differs in time from the sorted position.

    Sorted, the copies of a time fill one stretch of positions, so a row is in place when its
    stored position lies in the stretch of its time.  Copies collapse to a count before the
    shuffle; nothing is sorted but the distinct times of a bucket.
    """
    keys = list(keys)
    stored = with_row_index(df.select(*keys, ts, *physical), keys, list(physical), physical_bucket, out="_at")
    copies = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_copies"))
    ends = running(copies, keys, ts, sorted_bucket, {"_end": ("sum", F.col("_copies"))})
    placed = (F.col("_at") >= F.col("_end") - F.col("_copies")) & (F.col("_at") < F.col("_end"))
    return (
        stored.join(ends, [*keys, ts]).groupBy(*keys).agg(F.count_if(~placed).alias("out_of_order_rows"))
    )


def status_label() -> Column:
    share = F.col("deduped_bars") / F.nullif(F.col("expected_bars"), F.lit(0))
    clean = (F.col("duplicate_bars") == 0) & (F.col("out_of_order_rows") == 0)
    return (
        F.when(share.isNull(), "yellow")
        .when((share >= 0.99) & clean, "green")
        .when(share >= 0.95, "yellow")
        .otherwise("red")
    )


def series_quality(
    bars: DataFrame,
    days: int,
    physical: Sequence[str],
    physical_bucket: Column,
    segments: SegmentParams = SegmentParams(),
    window: tuple[int, int] | None = None,
) -> DataFrame:
    """Expected, received, missing, duplicate and misplaced bars of each series.

    ``expected`` counts ``days`` full days while every stored row is received; pass
    ``window`` to count only the rows between two times.  ``physical`` names the columns of
    the stored order (file and row).
    """
    if window is not None:
        bars = bars.filter(F.col("ts_open_ms").between(*window))
    # Two aggregates, so that copies of a time collapse before anything is counted distinct.
    per_time = bars.groupBy(*SERIES_KEYS, "ts_open_ms").agg(F.count(F.lit(1)).alias("_copies"))
    counts = per_time.groupBy(*SERIES_KEYS).agg(
        F.sum("_copies").alias("received_bars"),
        F.count(F.lit(1)).alias("deduped_bars"),
        F.min("ts_open_ms").alias("first_ts_ms"),
        F.max("ts_open_ms").alias("last_ts_ms"),
    )
    sorted_bucket = F.floor(F.col("ts_open_ms") / F.lit(segments.asof_bucket_ms))
    misplaced = rank_mismatches(bars, SERIES_KEYS, "ts_open_ms", physical, physical_bucket, sorted_bucket)
    return (
        counts.join(misplaced, [*SERIES_KEYS], "left")
        .withColumn("expected_bars", (bars_per("timeframe", DAY_MS) * F.lit(days)).cast("long"))
        .withColumn("missing_bars", F.greatest(F.col("expected_bars") - F.col("deduped_bars"), F.lit(0)))
        .withColumn("duplicate_bars", F.col("received_bars") - F.col("deduped_bars"))
        .withColumn("status", status_label())
    )


def funding_quality(funding: DataFrame, days: int) -> DataFrame:
    per_day = DAY_MS // FUNDING_INTERVAL_MS
    return funding.groupBy(*INSTRUMENT).agg(
        F.count(F.lit(1)).alias("funding_rows_received"),
        F.lit(per_day * days).cast("long").alias("funding_rows_expected_in_window"),
        F.min("ts_settle_ms").alias("first_settle_ms"),
        F.max("ts_settle_ms").alias("last_settle_ms"),
    )


def neighbour_gaps(df: DataFrame, keys: Sequence[str], ts: str, bucket_ms: int) -> DataFrame:
    """Rows (keys, ts, ``gap``): distance to the previous different time of the series.

    Distinct times are cut into buckets; the first of a bucket compares with the last of an
    earlier one, which comes from one summary row per bucket.
    """
    from pyspark.sql import Window

    keys = list(keys)
    times = df.select(*keys, ts).distinct().withColumn("_bucket", F.floor(F.col(ts) / F.lit(bucket_ms)))
    ends = times.groupBy(*keys, "_bucket").agg(F.max(ts).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket")
    carry = ends.select(*keys, "_bucket", F.lag("_end").over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    prev = F.coalesce(F.lag(ts).over(inside), F.col("_carry"))
    return times.join(carry, [*keys, "_bucket"]).select(*keys, ts, (F.col(ts) - prev).alias("gap"))


def oi_quality(oi: DataFrame, segments: SegmentParams = SegmentParams()) -> DataFrame:
    """Rows, extent and the longest gap in minutes; a single row has no gap."""
    counts = oi.groupBy(*INSTRUMENT).agg(
        F.count(F.lit(1)).alias("oi_rows_received"),
        F.min("ts_ms").alias("oi_first_ts_ms"),
        F.max("ts_ms").alias("oi_last_ts_ms"),
    )
    gaps = neighbour_gaps(oi, INSTRUMENT, "ts_ms", segments.asof_bucket_ms).groupBy(*INSTRUMENT)
    widest = gaps.agg(F.max("gap").alias("_gap"))
    # Several rows at one single time have a gap of zero.
    gap = F.coalesce("_gap", F.when(F.col("oi_rows_received") > 1, F.lit(0)))
    return (
        counts.join(widest, [*INSTRUMENT], "left")
        .withColumn("oi_gap_max_minutes", gap / F.lit(float(MINUTE_MS)))
        .drop("_gap")
    )


def gap_stats(
    df: DataFrame, keys: Sequence[str], ts: str, interval_ms: int, segments: SegmentParams = SegmentParams()
) -> DataFrame:
    """Missing steps between neighbouring times, and rows that repeat a time."""
    keys = list(keys)
    copies = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_copies"))
    counts = copies.groupBy(*keys).agg(
        F.sum("_copies").alias("_rows"), F.count(F.lit(1)).alias("_distinct"), F.min(ts).alias("_first"), F.max(ts).alias("_last")
    )
    missing = neighbour_gaps(df, keys, ts, segments.asof_bucket_ms).groupBy(*keys).agg(
        F.coalesce(
            F.sum(F.when(F.col("gap") > interval_ms, F.floor(F.col("gap") / F.lit(interval_ms)) - 1)), F.lit(0)
        ).alias("missing")
    )
    return counts.join(missing, keys).select(
        *keys,
        (F.floor((F.col("_last") - F.col("_first")) / F.lit(interval_ms)) + 1).alias("expected"),
        "missing",
        (F.col("_rows") - F.col("_distinct")).alias("duplicates"),
    )


def monotonic(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    physical: Sequence[str],
    bucket: Column,
    strict: bool,
    segments: SegmentParams = SegmentParams(),
) -> DataFrame:
    """Per series: do times grow in stored order?  Strict forbids equal neighbours."""
    keys = list(keys)
    placed = with_row_index(df.select(*keys, ts, *physical), keys, list(physical), bucket, out="_at")
    seg = cut(placed, keys, "_at", segments.rows, before=1, idx="_at")
    prev = F.lag(ts).over(seg.window())
    bad = (F.col(ts) <= prev) if strict else (F.col(ts) < prev)
    return (
        seg.with_columns({"_bad": F.coalesce(bad, F.lit(False))})
        .owned()
        .groupBy(*keys)
        .agg((~F.bool_or("_bad")).alias("timestamp_monotonic"))
    )


def series_inventory(tables: dict[str, DataFrame], ts: str = "ts_open_ms") -> DataFrame:
    """Rows, first and last time of each series in each table; tables without a time column
    report their rows only."""
    out = None
    for kind, df in tables.items():
        has_ts = ts in df.columns
        one = df.groupBy(*SERIES_KEYS).agg(
            F.count(F.lit(1)).alias("rows"),
            (F.min(ts) if has_ts else F.lit(None).cast("long")).alias("first_ts_ms"),
            (F.max(ts) if has_ts else F.lit(None).cast("long")).alias("last_ts_ms"),
        )
        one = one.select(F.lit(kind).alias("kind"), *one.columns)
        out = one if out is None else out.unionByName(one)
    return out
