"""Features to cells against plain pandas."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from helpers import close_to, price_frame, to_spark
from pyspark.sql import functions as F

from tidegrid.functions.segments import cut, ensure_index
from tidegrid.operators.events import attach_context, detect_events, event_counts, first_cross
from tidegrid.operators.features import FEATURE_COLUMNS, build_features, non_null_counts
from tidegrid.operators.joins import asof_funding, asof_oi, dedupe_keep_first, join_closes, join_state, mask_known_gaps
from tidegrid.operators.leaderboard import build_leaderboard
from tidegrid.operators.outcomes import build_outcomes, forward_universe, outcome_columns
from tidegrid.operators.regimes import build_regimes
from tidegrid.params import EVENT_TYPES, SERIES_KEYS, FeatureParams, SegmentParams, StudyParams
from tidegrid.plans.event_study import run_study

SMALL = SegmentParams(rows=512, asof_bucket_ms=86_400_000)


@pytest.fixture(scope="module")
def frame():
    return price_frame(900, seed=11)


@pytest.fixture(scope="module")
def feats(spark, frame):
    return build_features(to_spark(spark, frame), segments=SMALL).toPandas().sort_values("ts_open_ms").reset_index(drop=True)


def test_features_match_pandas(frame, feats):
    f = frame
    ret = f.close.pct_change()
    z = lambda x, n, m: (x - x.rolling(n, min_periods=m).mean()) / x.rolling(n, min_periods=m).std()
    prev = f.close.shift()
    tr = pd.concat([(f.high - f.low).abs(), (f.high - prev).abs(), (f.low - prev).abs()], axis=1).max(axis=1)
    x = np.arange(24) - 11.5
    slope = np.log(f.close).rolling(24).apply(lambda y: (x * (y - y.mean())).sum() / (x * x).sum(), raw=True)
    basis = (f.mark_close - f.index_close) / f.index_close * 1e4
    want = {
        "ret_3": f.close.pct_change(3),
        "ret_72": f.close.pct_change(72),
        "vol_close_to_close_24": ret.rolling(24).std(),
        "atr_14": tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(),
        "ema_fast_minus_slow_pct": (f.close.ewm(span=12, adjust=False, min_periods=12).mean() - f.close.ewm(span=48, adjust=False, min_periods=48).mean()) / f.close,
        "slope_ret_24": slope,
        "vol_zscore_24": z(ret, 24, 24),
        "taker_imbalance": (2 * f.taker_buy_base - f.volume_base) / f.volume_base,
        "taker_quote_zscore_24": z(f.taker_buy_quote, 24, 24),
        "basis_bp": basis,
        "basis_zscore_24": z(basis, 24, 24),
        "oi_pct_change_1h": f.oi_base / f.oi_base.shift(1) - 1,
        "oi_pct_change_24h": f.oi_base / f.oi_base.shift(24) - 1,
    }
    for name, series in want.items():
        np.testing.assert_allclose(feats[name].astype(float), series, rtol=1e-6, atol=1e-9, err_msg=name)
    np.testing.assert_allclose(feats.oi_zscore_30d, z(f.oi_base, 720, 168), rtol=1e-7)
    np.testing.assert_allclose(feats.funding_rate_zscore_30d, z(f.funding_rate_ffill, 720, 168), rtol=1e-6, atol=1e-9)
    assert feats.pre_funding_30m.isna().sum() == 0


def test_features_do_not_see_the_future(spark, frame, feats):
    part = build_features(to_spark(spark, frame.head(400)), segments=SMALL).toPandas().sort_values("ts_open_ms")
    for name in FEATURE_COLUMNS[5:]:
        close_to(part[name], feats[name].head(400))


def test_segment_size_changes_nothing(spark, frame, feats):
    other = build_features(to_spark(spark, frame).repartition(5), segments=SegmentParams(rows=200)).toPandas().sort_values("ts_open_ms")
    for name in FEATURE_COLUMNS[5:]:
        np.testing.assert_allclose(other[name].astype(float), feats[name].astype(float), rtol=1e-8, atol=1e-11, err_msg=name)


def test_padded_open_interest(spark, frame):
    got = build_features(to_spark(spark, frame), FeatureParams(pad_open_interest=True), SMALL).toPandas().sort_values("ts_open_ms")
    close_to(got.oi_pct_change_1h, frame.oi_base.ffill() / frame.oi_base.ffill().shift(1) - 1)


def test_fused_study_equals_single_operators(spark, frame):
    p = StudyParams(segments=SegmentParams(rows=700))
    bars = ensure_index(to_spark(spark, frame), SERIES_KEYS, 300)
    study = run_study(bars, p).stored()
    f = build_features(bars, segments=SMALL)
    r = build_regimes(f, segments=SMALL)
    e = detect_events(f, r, segments=SMALL)
    o = build_outcomes(bars, e, segments=SegmentParams(rows=100))
    assert study.regimes.exceptAll(r).count() == 0 and r.count() == 900
    a, b = (x.toPandas().sort_values(["ts_open_ms", "event_type"]).reset_index(drop=True) for x in (study.events, e))
    assert len(a) > 50
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)
    sort = ["ts_open_ms", "event_type", "horizon"]
    a, b = (x.toPandas().sort_values(sort).reset_index(drop=True) for x in (study.outcomes, o))
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)
    counts = event_counts(e, EVENT_TYPES).toPandas().iloc[0]
    assert sum(counts[t] for t in EVENT_TYPES) == e.count()
    assert non_null_counts(f).toPandas().close.tolist() == [900]


def test_event_id():
    want = hashlib.sha1(b"A|1h|EV_OI_FLUSH|7").hexdigest()[:16]
    from pyspark.sql import SparkSession

    from tidegrid.functions.scalars import event_id

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([("A", "1h", 7)], "symbol string, timeframe string, ts_open_ms long")
    assert df.select(event_id("symbol", "timeframe", F.lit("EV_OI_FLUSH"), "ts_open_ms").alias("i")).first().i == want


def test_first_cross(spark):
    flags = [True, True, False, None, True, False, True]
    rows = [("x", "A", "1h", i, i, f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, timeframe string, ts_open_ms long, bar_idx long, c boolean")
    seg = cut(df, SERIES_KEYS, "ts_open_ms", 3, before=1).with_columns({"c": F.coalesce("c", F.lit(False))})
    got = seg.with_columns({"f": first_cross("c", seg)}).owned().toPandas().sort_values("bar_idx").f.tolist()
    assert got == [True, False, False, False, True, False, True]


# ---- as-of rules ------------------------------------------------------------------------------


def _bars_at(spark, times):
    return spark.createDataFrame([("x", "A", "1h", t) for t in times], "exchange string, symbol string, timeframe string, ts_open_ms long")


def test_funding_boundaries(spark):
    funding = spark.createDataFrame(
        [("x", "A", 1000, 0.1, 500), ("x", "A", 5000, 0.2, 500)],
        "exchange string, symbol string, ts_settle_ms long, funding_rate double, funding_interval_ms long",
    )
    got = asof_funding(_bars_at(spark, [999, 1000, 1500, 1501, 5000]), funding, SMALL).toPandas().sort_values("ts_open_ms")
    assert got.funding_rate_ffill.fillna(-1).tolist() == [-1, 0.1, 0.1, -1, 0.2]
    # The countdown is not masked and goes below zero.
    close_to(got.funding_minutes_to_next, [np.nan, 500 / 6e4, 0, -1 / 6e4, 500 / 6e4])


def test_open_interest_ttl(spark):
    oi = spark.createDataFrame([("x", "A", 0, 7.0, 8.0)], "exchange string, symbol string, ts_ms long, oi_base double, oi_value_quote double")
    got = asof_oi(_bars_at(spark, [0, 3_600_000, 3_600_001]), oi, segments=SMALL).toPandas().sort_values("ts_open_ms")
    assert got.oi_base.fillna(-1).tolist() == [7, 7, -1]


def test_empty_right_sides(spark):
    bars = to_spark(spark, price_frame(5)).drop(
        "funding_rate_ffill", "funding_minutes_to_next", "oi_base", "mark_close", "index_close",
        "long_short_account_ratio", "top_trader_position_ratio", "taker_long_short_vol_ratio",
    )
    funding = spark.createDataFrame([], "exchange string, symbol string, ts_settle_ms long, funding_rate double, funding_interval_ms long")
    oi = spark.createDataFrame(
        [], "exchange string, symbol string, ts_ms long, oi_base double, oi_value_quote double, long_short_account_ratio double, "
        "top_trader_position_ratio double, taker_long_short_vol_ratio double",
    )
    key = "exchange string, symbol string, timeframe string, ts_open_ms long"
    mark = spark.createDataFrame([], f"{key}, mark_close double")
    index = spark.createDataFrame([], f"{key}, index_close double")
    got = join_state(bars, funding, oi, mark, index)
    assert got.count() == 5 and got.filter("oi_base is not null or mark_close is not null").count() == 0
    assert build_features(got, segments=SMALL).count() == 5


def test_dedupe_keeps_first_stored(spark):
    df = spark.createDataFrame([("a", 1, 10, None), ("a", 1, 5, 7.0), ("b", 1, 1, 1.0)], "k string, t long, pos long, v double")
    got = {r.k: (r.pos, r.v) for r in dedupe_keep_first(df, ["k", "t"], ["pos"]).collect()}
    assert got == {"a": (5, 7.0), "b": (1, 1.0)}


def test_known_gap_mask(spark):
    gaps = spark.createDataFrame([(3_600_000,), (7_199_999,)], "gap_ms long")
    got = mask_known_gaps(_bars_at(spark, [0, 3_600_000, 7_200_000]), gaps, F.lit(3_600_000)).toPandas().sort_values("ts_open_ms")
    assert got.known_gap.tolist() == [False, True, False]


def test_context_defaults_to_unknown(spark):
    e = spark.createDataFrame([("i", 5, "EV", 1.0, "", "x", "A", "1h")], "event_id string, ts_open_ms long, event_type string, event_strength double, context_regime string, exchange string, symbol string, timeframe string")
    r = spark.createDataFrame([("x", "A", "1h", 6, "l")], "exchange string, symbol string, timeframe string, ts_open_ms long, composite_label string")
    assert attach_context(e, r).first().context_regime == "unknown"


# ---- outcomes ------------------------------------------------------------------------------------


def _loop(frame: pd.DataFrame, i: int, h: int):
    """Outcome of one event, step by step."""
    n, t = len(frame), i + 1
    if t >= n or frame.close[t] == 0:
        return (np.nan,) * 5 + (0,)
    used = min(h, n - 1 - t)
    if used <= 0:
        return (np.nan,) * 5 + (0,)
    base = frame.close[t]
    high, low = frame.high[t + 1 : t + used + 1].to_numpy(), frame.low[t + 1 : t + used + 1].to_numpy()
    ret = (frame.close[t + h] / base - 1) * 100 if t + h < n else np.nan
    return ret, (high.max() / base - 1) * 100, (low.min() / base - 1) * 100, high.argmax() + 1, low.argmin() + 1, used


@pytest.mark.parametrize("rows", [10, 1000])
def test_outcomes_with_ties_and_truncation(spark, rows):
    frame = price_frame(60, seed=8)
    frame[["high", "low"]] = frame[["high", "low"]].round(0)
    frame.loc[20, "close"] = 0.0
    bars = to_spark(spark, frame)
    events = bars.select("exchange", "symbol", "timeframe", "ts_open_ms", F.col("ts_open_ms").cast("string").alias("event_id"), F.lit("E").alias("event_type"))
    events = events.unionByName(events.limit(1).withColumn("ts_open_ms", F.lit(-5).cast("long")))
    got = build_outcomes(bars, events, {"1h": (1, 3, 12)}, SegmentParams(rows=rows)).toPandas()
    assert len(got) == 180
    got = got.set_index(["ts_open_ms", "horizon"])
    cols = ["forward_return_pct", "mfe_pct", "mae_pct", "time_to_mfe_bars", "time_to_mae_bars", "max_holding_bars_used"]
    for i in range(60):
        for h in (1, 3, 12):
            np.testing.assert_allclose(got.loc[(i * 3_600_000, f"h+{h}"), cols].astype(float), _loop(frame, i, h), rtol=1e-7, atol=1e-9)


def test_forward_universe(spark):
    rows = [("x", "A", "1h", i * 3_600_000, c) for i, c in enumerate([100.0, 110.0, 121.0, 132.0])]
    bars = spark.createDataFrame(rows, "exchange string, symbol string, timeframe string, ts_open_ms long, close double")
    got = forward_universe(bars, {"1h": (1,)}, SegmentParams(rows=2)).toPandas().sort_values("ts_open_ms")
    np.testing.assert_allclose(got.forward_return_pct, [10.0, 10.0, (132 / 121 - 1) * 100])


def test_leaderboard(spark):
    rows = [("x", "A", "1h", "E", "h+1", r, m, -m, s) for r, m, s in [(1.0, 2.0, 1.0), (-1.0, 4.0, 2.0), (3.0, 6.0, 3.0), (None, 8.0, 4.0)]]
    rows += [("x", "A", "1h", "F", "h+1", None, None, None, 1.0)]
    o = spark.createDataFrame(rows, "exchange string, symbol string, timeframe string, event_type string, horizon string, forward_return_pct double, mfe_pct double, mae_pct double, event_strength double")
    got = build_leaderboard(o).toPandas().set_index("event_type")
    e = got.loc["E"]
    assert (e["count"], e.count_incomplete) == (3, 1)
    assert e.mean_forward_return == 1 and e.median_forward_return == 1 and e.median_mfe == 5 and e.mfe_mae_ratio == 1
    assert e.hit_rate_at_zero == pytest.approx(2 / 3) and e.sharpe_like == pytest.approx(0.5) and e.mean_event_strength == 2.5
    assert got.loc["F", "count"] == 0 and pd.isna(got.loc["F", "median_mfe"])


def test_unknown_timeframe_fails(spark):
    bars = to_spark(spark, price_frame(40, timeframe="15m"))
    with pytest.raises(Exception, match="no horizons for timeframe 15m"):
        forward_universe(bars).collect()


def test_closes_of_one_bar_must_agree(spark):
    bars = to_spark(spark, price_frame(3)).drop("mark_close", "index_close")
    key = bars.select("exchange", "symbol", "timeframe", "ts_open_ms")
    mark, index = key.withColumn("mark_close", F.lit(1.0)), key.withColumn("index_close", F.lit(2.0))
    same = join_closes(bars, mark.unionAll(mark), index).collect()
    assert [(r.mark_close, r.index_close) for r in same] == [(1.0, 2.0)] * 3
    with pytest.raises(Exception, match="several values of mark_close"):
        join_closes(bars, mark.unionAll(mark.withColumn("mark_close", F.lit(9.0))), index).collect()


def test_wide_frames_are_made_of_shorter_ones(spark, frame, capsys):
    """No row looks at all rows of its frames: neither narrow statistics nor outcomes slide over them in the plan."""
    study = run_study(to_spark(spark, frame))
    study.outcomes.explain("formatted")
    plan = capsys.readouterr().out.lower()
    assert "rowframe, -23" not in plan and "stddev_samp" not in plan
    assert "rowframe, 2, 73" not in plan and "rowframe, 2, 13" not in plan


@pytest.mark.parametrize("rows", [64, 4096])
def test_extremes_of_any_horizon(spark, rows):
    """Against a loop: missing prices, ties, the end of the series, and horizons that are no multiples of each other."""
    n, horizons = 400, {"1h": (1, 2, 5, 7, 13, 100, 150)}
    rng = np.random.default_rng(4)
    frame = price_frame(n, seed=6)
    for c in ("high", "low"):
        frame[c] = rng.integers(90, 110, n).astype(float)
        frame.loc[rng.choice(n, 60, replace=False), c] = np.nan
    frame.loc[200:230, ["high", "low"]] = np.nan
    bars = ensure_index(to_spark(spark, frame), SERIES_KEYS, 50)
    seg = cut(bars, SERIES_KEYS, "ts_open_ms", rows, after=151)
    got = outcome_columns(seg, horizons).owned().select("bar_idx", F.inline("_outcomes")).collect()
    assert len(got) == n * len(horizons["1h"])
    for r in got:
        h, i = int(r.horizon[2:]), r.bar_idx
        ahead = frame.iloc[i + 2 : i + 2 + h]
        if i + 1 >= n:
            assert (r.mfe_pct, r.time_to_mfe_bars, r.max_holding_bars_used) == (None, None, 0)
            continue
        entry = frame.close[i + 1]
        assert r.max_holding_bars_used == len(ahead)
        assert (r.forward_return_pct is None) == (i + 1 + h >= n)
        for best, pct, after, c in (("idxmax", r.mfe_pct, r.time_to_mfe_bars, "high"), ("idxmin", r.mae_pct, r.time_to_mae_bars, "low")):
            known = ahead[c].dropna()
            if known.empty:
                assert (pct, after) == (None, None)
            else:
                at = getattr(known, best)()
                assert after == at - i - 1 and pct == (known[at] - entry) / entry * 100
