"""Small inputs and brute-force results."""

from __future__ import annotations

import numpy as np
import pandas as pd

KEYS = {"exchange": "x", "symbol": "A", "timeframe": "1h"}
HOUR = 3_600_000


def price_frame(n: int, seed: int = 1, symbol: str = "A", timeframe: str = "1h", step: int = HOUR) -> pd.DataFrame:
    """Random bars with state columns, some of it missing."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    spread = np.abs(rng.normal(0, 0.005, n)) * close
    volume = rng.uniform(1, 10, n)
    ts = np.arange(n, dtype="int64") * step
    frame = pd.DataFrame(
        {
            "exchange": "x",
            "symbol": symbol,
            "timeframe": timeframe,
            "ts_open_ms": ts,
            "ts_close_ms": ts + step - 1,
            "open": close * (1 + rng.normal(0, 0.001, n)),
            "high": close + spread,
            "low": close - spread,
            "close": close,
            "volume_base": volume,
            "volume_quote": volume * close,
            "trades": rng.integers(1, 50, n),
            "taker_buy_base": volume * rng.uniform(0, 1, n),
            "taker_buy_quote": volume * close * rng.uniform(0, 1, n),
            "funding_rate_ffill": np.repeat(rng.normal(0, 3e-4, n // 8 + 1), 8)[:n],
            "funding_minutes_to_next": 480.0 - (np.arange(n) % 8) * 60.0,
            "oi_base": 1000 * np.exp(np.cumsum(rng.normal(0, 0.01, n))),
            "mark_close": close * (1 + rng.normal(0, 1e-4, n)),
            "index_close": close,
            "long_short_account_ratio": rng.uniform(0, 2, n),
            "top_trader_position_ratio": rng.uniform(0, 2, n),
            "taker_long_short_vol_ratio": rng.uniform(0, 2, n),
        }
    )
    frame.loc[rng.choice(n, n // 20, replace=False), "oi_base"] = np.nan
    frame.loc[rng.choice(n, n // 20, replace=False), "mark_close"] = np.nan
    return frame


def to_spark(spark, frame: pd.DataFrame):
    """NaN becomes null."""
    df = spark.createDataFrame(frame)
    from pyspark.sql import functions as F

    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def close_to(got, want) -> None:
    np.testing.assert_allclose(np.asarray(got, dtype=float), np.asarray(want, dtype=float), rtol=1e-9, atol=1e-12, equal_nan=True)
