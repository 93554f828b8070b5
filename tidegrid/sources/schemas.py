"""Column layouts of raw files and tables (fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

KLINE_FIELDS = (
    "open_time",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "close_time",
    "quote_volume",
    "count",
    "taker_buy_volume",
    "taker_buy_quote_volume",
    "ignore",
)
FUNDING_FIELDS = ("calc_time", "funding_interval_hours", "last_funding_rate")
METRICS_FIELDS = (
    "create_time",
    "symbol",
    "sum_open_interest",
    "sum_open_interest_value",
    "count_toptrader_long_short_ratio",
    "sum_toptrader_long_short_ratio",
    "count_long_short_ratio",
    "sum_taker_long_short_vol_ratio",
)

BARS = T.StructType(
    [
        T.StructField("ts_open_ms", T.LongType()),
        T.StructField("ts_close_ms", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume_base", "volume_quote")],
        T.StructField("trades", T.LongType()),
        T.StructField("taker_buy_base", T.DoubleType()),
        T.StructField("taker_buy_quote", T.DoubleType()),
        *[T.StructField(c, T.StringType()) for c in ("exchange", "symbol", "timeframe")],
    ]
)

TIER1_KLINES = (
    "timestamp_open_utc",
    "timestamp_close_utc",
    "symbol",
    "open",
    "high",
    "low",
    "close",
    "volume_base",
    "volume_quote",
    "trade_count",
    "taker_buy_base",
    "taker_buy_quote",
    "source",
    "ingested_at_utc",
)
TIER1_PRICES = (
    "timestamp_open_utc",
    "timestamp_close_utc",
    "symbol",
    "open",
    "high",
    "low",
    "close",
    "source",
    "ingested_at_utc",
)
TIER1_FUNDING = ("timestamp_utc", "symbol", "funding_rate", "mark_price_at_funding", "source", "ingested_at_utc")

TIER1 = {
    "um_klines_1m": TIER1_KLINES,
    "premium_index_klines": TIER1_PRICES,
    "mark_price_klines": TIER1_PRICES,
    "index_price_klines": TIER1_PRICES,
    "funding_rate_history": TIER1_FUNDING,
}


def strings(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
