"""Cutting a series into segments must never change a value."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from helpers import price_frame, to_spark
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegrid.functions.asof import AsofSide, asof_join
from tidegrid.functions.quantiles import exact_quantiles
from tidegrid.functions.rolling import Rolling, add_rolling, look_back, warm_up_rows
from tidegrid.functions.segments import cut, ensure_index, running, with_row_index
from tidegrid.operators.quality import neighbour_gaps
from tidegrid.params import SERIES_KEYS


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_row_index(spark, bucket):
    rows = [("a", i * 3) for i in range(50)] + [("b", i) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, ts long").repartition(4)
    out = with_row_index(df, ["k"], ["ts"], F.floor(F.col("ts") / bucket), total="n").toPandas().sort_values(["k", "ts"])
    assert out[out.k == "a"].bar_idx.tolist() == list(range(50))
    assert out[out.k == "b"].bar_idx.tolist() == list(range(20))
    assert set(out[out.k == "a"].n) == {50}


@pytest.mark.parametrize("rows", [5, 16, 1000])
def test_frames_over_segments(spark, rows):
    frame = price_frame(100)
    bars = ensure_index(to_spark(spark, frame), SERIES_KEYS, 10)
    seg = cut(bars, SERIES_KEYS, "ts_open_ms", rows, before=7, after=4)
    got = seg.with_columns(
        {
            "back": F.lag("close", 7).over(seg.window()),
            "ahead": F.lead("close", 4).over(seg.window()),
            "mean": F.avg("close").over(seg.frame(-7, 0)),
            "top": F.max("high").over(seg.frame(2, 4)),
        }
    ).owned().toPandas().sort_values("ts_open_ms")
    assert len(got) == 100
    np.testing.assert_allclose(got.back, frame.close.shift(7))
    np.testing.assert_allclose(got.ahead, frame.close.shift(-4))
    np.testing.assert_allclose(got["mean"], frame.close.rolling(8, min_periods=1).mean())
    top = [frame.high[i + 2 : i + 5].max() for i in range(100)]
    np.testing.assert_allclose(got.top.astype(float), top)


@pytest.mark.parametrize("rows", [64, 4096])
def test_wide_statistics_match_pandas(spark, rows):
    frame = price_frame(900, seed=3)
    specs = [
        Rolling("ewm", "ewm", "close", min_rows=48, arg=2 / 49),
        Rolling("z", "zscore", "oi_base", days=2, min_days=1),
        Rolling("q", "quantile", "close", days=3, min_days=1, arg=0.99),
        Rolling("rank", "rank", "oi_base", days=2, min_days=1),
    ]
    bars = ensure_index(to_spark(spark, frame), SERIES_KEYS, 100)
    seg = cut(bars, SERIES_KEYS, "ts_open_ms", rows, before=look_back(specs))
    got = add_rolling(seg, specs).owned().toPandas().sort_values("ts_open_ms").reset_index(drop=True)
    oi, close = frame.oi_base, frame.close
    roll = oi.rolling(48, min_periods=24)
    np.testing.assert_allclose(got["ewm"], close.ewm(span=48, adjust=False, min_periods=48).mean(), rtol=1e-12)
    np.testing.assert_allclose(got.z, (oi - roll.mean()) / roll.std(), rtol=1e-8)
    np.testing.assert_allclose(got.q, close.rolling(72, min_periods=24).quantile(0.99), rtol=1e-12)
    rank = oi.rolling(48, min_periods=24).apply(
        lambda x: np.nan if np.isnan(x[-1]) else np.sum(x[:-1] <= x[-1]) / max(len(x) - 1, 1), raw=True
    )
    np.testing.assert_allclose(got["rank"], rank, rtol=1e-12)


def test_warm_up_is_long_enough():
    for alpha in (1 / 14, 2 / 13, 2 / 49):
        assert (1 - alpha) ** warm_up_rows(alpha) <= 2.0**-80


def test_zero_spread_gives_null(spark):
    frame = price_frame(60).assign(close=5.0)
    spec = Rolling("z", "zscore", "close", days=1, min_days=1)
    seg = cut(ensure_index(to_spark(spark, frame), SERIES_KEYS, 100), SERIES_KEYS, "ts_open_ms", 16, before=look_back([spec]))
    assert add_rolling(seg, [spec]).owned().filter("z is not null").count() == 0


def test_running(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"k": "a", "i": range(200), "x": rng.normal(size=200)})
    df = spark.createDataFrame(frame).repartition(4)
    out = running(df, ["k"], "i", F.floor(F.col("i") / 13), {"m": ("max", F.col("x")), "s": ("sum", F.col("x")), "l": ("min", F.col("x"))})
    out = out.toPandas().sort_values("i")
    np.testing.assert_allclose(out.m, frame.x.cummax())
    np.testing.assert_allclose(out.l, frame.x.cummin())
    np.testing.assert_allclose(out.s, frame.x.cumsum())


@pytest.mark.parametrize("bucket", [10, 1000])
def test_asof_matches_pandas(spark, bucket):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"k": "a", "t": np.sort(rng.choice(500, 80, replace=False)).astype("int64")})
    right = pd.DataFrame({"k": "a", "u": np.sort(rng.choice(500, 15, replace=False)).astype("int64"), "v": rng.normal(size=15)})
    side = AsofSide("m", spark.createDataFrame(right), "u", ("v",))
    got = asof_join(spark.createDataFrame(left).repartition(3), [side], ["k"], "t", bucket)
    got = got.select("t", "m.ts", "m.v").toPandas().sort_values("t").reset_index(drop=True)
    want = pd.merge_asof(left, right, left_on="t", right_on="u")
    np.testing.assert_allclose(got.v.astype(float), want.v)
    np.testing.assert_allclose(got.ts.astype(float), want.u)


@pytest.mark.parametrize("accuracy", [50, 20_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(4)
    parts = [("a", float(x)) for x in rng.normal(size=5000)] + [("b", float(x)) for x in rng.integers(0, 3, 777)] + [("c", None), ("d", 1.5)]
    df = spark.createDataFrame(parts, "k string, x double").repartition(4)
    wanted = {"p5": ("x", 0.05), "p50": ("x", 0.5), "p99": ("x", 0.99)}
    got = exact_quantiles(df, ["k"], wanted, [F.count("x").alias("n")], accuracy).toPandas().set_index("k")
    frame = pd.DataFrame(parts, columns=["k", "x"])
    for k in "abd":
        for name, (_, p) in wanted.items():
            assert got.loc[k, name] == pytest.approx(frame[frame.k == k].x.quantile(p), rel=1e-12)
    assert got.loc["c", "n"] == 0 and pd.isna(got.loc["c", "p50"])


@pytest.mark.parametrize("bucket", [7, 10_000])
def test_neighbour_gaps(spark, bucket):
    times = [5, 5, 9, 30, 31, 90]
    df = spark.createDataFrame([("a", t) for t in times], "k string, t long")
    got = neighbour_gaps(df, ["k"], "t", bucket).toPandas().sort_values("t")
    assert got.gap.fillna(-1).tolist() == [-1, 4, 21, 1, 59]


def test_one_hot_series_spreads(spark):
    """One series, many segments: no segment holds more than its rows and the halo."""
    df = spark.range(10_000).select(
        F.lit("x").alias("exchange"), F.lit("A").alias("symbol"), F.lit("1h").alias("timeframe"), (F.col("id") * 3_600_000).alias("ts_open_ms")
    )
    seg = cut(ensure_index(df, SERIES_KEYS, 500), SERIES_KEYS, "ts_open_ms", 500, before=50, after=10)
    sizes = seg.group().count().toPandas()["count"]
    assert sizes.max() <= 560 and len(sizes) >= 20
    w = Window.partitionBy("bar_idx")
    assert seg.owned().withColumn("c", F.count(F.lit(1)).over(w)).filter("c > 1").count() == 0


@pytest.mark.parametrize("rows", [40, 4096])
def test_narrow_frames_are_those_of_window_functions(spark, rows):
    """Frames of a few rows give the very numbers of Spark's aggregates; nulls, runs of one value and infinite ones included."""
    frame = price_frame(150, seed=5)
    frame.loc[60:90, "close"] = 7.1
    bars = ensure_index(to_spark(spark, frame).withColumn("close", F.when(F.col("ts_open_ms") == 120 * 3_600_000, float("inf")).otherwise(F.col("close"))), SERIES_KEYS, 50)
    seg = cut(bars, SERIES_KEYS, "ts_open_ms", rows, before=24)
    specs = [Rolling(f"{kind}_{x}", f"full_{kind}", x, rows=24) for x in ("close", "oi_base", "mark_close") for kind in ("spread", "zscore", "slope")]
    got = add_rolling(seg, specs, ("trades",)).owned()
    assert "trades" not in got.columns
    for x in ("close", "oi_base", "mark_close"):
        w = Window.partitionBy(*SERIES_KEYS).orderBy("ts_open_ms").rowsBetween(-23, 0)
        full = F.count(x).over(w) >= 24
        spread = F.stddev_samp(x).over(w)
        got = got.withColumns(
            {
                f"want_spread_{x}": F.when(full, spread),
                f"want_zscore_{x}": F.when(full, (F.col(x) - F.avg(x).over(w)) / F.nullif(spread, F.lit(0.0))),
                f"want_slope_{x}": F.when(full, F.regr_slope(F.col(x), F.col("bar_idx").cast("double")).over(w)),
            }
        )
    same = [F.col(s.out).eqNullSafe(F.col(f"want_{s.out}")) for s in specs]
    assert got.count() == 150 and got.filter(~F.least(*same)).count() == 0
    assert got.filter(F.col("zscore_close").isNotNull()).count() > 50
