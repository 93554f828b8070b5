"""Market tables from a table of events: every event type is a symbol, every event a trade.

``events(event_id, ts, user_id, event_type, value, props)`` with ``props`` = {"k": 0..99}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalars import ntz_to_ms
from tidegrid.params import DAY_MS, FUNDING_INTERVAL_MS, HOUR_MS, MINUTE_MS

EXCHANGE = "sim"
OI_STEP_MS = 300_000


def read_ticks(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.select(
        F.lit(EXCHANGE).alias("exchange"),
        F.col("event_type").alias("symbol"),
        "event_id",
        ntz_to_ms("ts").alias("ts_ms"),
        (F.lit(1000.0) + F.col("value")).alias("px"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


#: Start of the series of dense ticks.
DENSE_START_MS = 1_704_067_200_000


def read_dense_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """One long series: each order is a five-minute bar, its lines are the trades of it.

    Its frames of a month fill up, which those of the events never do.
    """
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    ts = F.lit(DENSE_START_MS).cast("long") + F.col("l_orderkey") * F.lit(5 * MINUTE_MS) + F.col("l_linenumber") * F.lit(1000)
    return lines.select(
        F.lit(EXCHANGE).alias("exchange"),
        F.lit("all").alias("symbol"),
        (F.col("l_partkey") * F.lit(1_000_000) + F.col("l_suppkey")).alias("event_id"),
        ts.alias("ts_ms"),
        (F.lit(999.0) + F.lit(2.0) * F.col("l_quantity")).alias("px"),
        (F.lit(2.0) * F.col("l_quantity") - F.lit(1.0)).alias("value"),
        F.pmod("l_partkey", F.lit(100)).cast("int").alias("k"),
    )


def _bucket(ts: Column, width: Column) -> Column:
    return F.floor(ts / width) * width


_UNIT_MS = {"m": MINUTE_MS, "h": HOUR_MS, "d": DAY_MS}


def bars_from_ticks(ticks: DataFrame, timeframes: tuple[str, ...] = ("1h",)) -> DataFrame:
    """OHLCV bars.  All timeframes come from one pass; partial aggregation runs before the
    shuffle, so a symbol with most of the ticks costs no more than its number of bars.

    First and last are by time, then id.  The order is one number, so that the aggregate can
    hash: a struct as order would make it sort all ticks first.
    """
    frames = F.array(
        *[F.struct(F.lit(t).alias("timeframe"), F.lit(int(t[:-1]) * _UNIT_MS[t[-1]]).cast("long").alias("_w")) for t in timeframes]
    )
    wide = ticks.select("*", F.inline(frames))
    width = F.col("_w")
    start = _bucket(F.col("ts_ms"), width)
    place = (F.col("ts_ms") - start).cast("decimal(9,0)") * F.lit(str(10**19)).cast("decimal(20,0)")
    when = (place + F.col("event_id").cast("decimal(19,0)")).cast("decimal(29,0)")
    wide = wide.withColumns({"ts_open_ms": start, "_when": when})
    buy = F.col("k") % 2 == 0
    bars = wide.groupBy("exchange", "symbol", "timeframe", "_w", "ts_open_ms").agg(
        F.min_by("px", "_when").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "_when").alias("close"),
        F.sum("value").alias("volume_base"),
        F.sum(F.col("value") * F.col("px")).alias("volume_quote"),
        F.count(F.lit(1)).alias("trades"),
        F.coalesce(F.sum(F.when(buy, F.col("value"))), F.lit(0.0)).alias("taker_buy_base"),
        F.coalesce(F.sum(F.when(buy, F.col("value") * F.col("px"))), F.lit(0.0)).alias("taker_buy_quote"),
        F.avg("px").alias("mean_px"),
    )
    return bars.withColumn("ts_close_ms", F.col("ts_open_ms") + width - 1).drop("_w")


def mark_from_bars(bars: DataFrame) -> DataFrame:
    return bars.select(
        "exchange", "symbol", "timeframe", "ts_open_ms", "ts_close_ms", F.col("close").alias("mark_close")
    )


def index_from_bars(bars: DataFrame) -> DataFrame:
    return bars.select("exchange", "symbol", "timeframe", "ts_open_ms", "ts_close_ms", F.col("mean_px").alias("index_close"))


def funding_from_ticks(ticks: DataFrame) -> DataFrame:
    width = F.lit(FUNDING_INTERVAL_MS)
    return (
        ticks.groupBy("exchange", "symbol", _bucket(F.col("ts_ms"), width).alias("ts_settle_ms"))
        .agg(((F.avg("value") - 50) / 20000).alias("funding_rate"))
        .withColumn("funding_interval_ms", width.cast("long"))
    )


def oi_from_ticks(ticks: DataFrame) -> DataFrame:
    """Open interest and, to have the ratio columns too, shares of the same ticks."""
    k, value = F.col("k"), F.col("value")
    return ticks.groupBy("exchange", "symbol", _bucket(F.col("ts_ms"), F.lit(OI_STEP_MS)).alias("ts_ms")).agg(
        (F.lit(1000.0) + F.avg("k")).alias("oi_base"),
        (F.lit(1000.0) * F.avg("px")).alias("oi_value_quote"),
        F.avg((k % 2 == 0).cast("double")).alias("long_short_account_ratio"),
        F.avg((k % 3 == 0).cast("double")).alias("top_trader_position_ratio"),
        F.avg((value > 50).cast("double")).alias("taker_long_short_vol_ratio"),
    )
