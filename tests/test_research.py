"""Stability, selection, trades, signals, ledger, Monte Carlo."""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
import pytest
from helpers import price_frame, to_spark
from pyspark.sql import functions as F

from tidegrid.functions.scalars import horizon_bars
from tidegrid.functions.segments import cut, ensure_index
from tidegrid.operators import ledger, montecarlo, selection, signals, stability, trades
from tidegrid.operators.leaderboard import CELL
from tidegrid.params import SERIES_KEYS, SegmentParams, StabilityParams

SMALL = SegmentParams(rows=50)
OUT = ", ".join(f"{c} string" for c in CELL) + ", ts_open_ms long, forward_return_pct double"


def cell(spark, values, symbol="A", event="E", horizon="h+1"):
    rows = [("x", symbol, "1h", event, horizon, i * 3_600_000, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, OUT)


def test_horizon_text(spark):
    df = spark.createDataFrame([("h+1",), ("H+72 ",), ("h+x",), ("7",), ("h+0",)], "h string")
    assert [r.n for r in df.select(horizon_bars("h").alias("n")).collect()] == [1, 72, 1, 1, 1]


def test_small_cell(spark):
    r = stability.walk_forward(cell(spark, [0.1] * 10)).first()
    assert (r.verdict, r.n_complete, r.sign_stable, r.sign_stable_maker) == ("INSUFFICIENT_N", 10, False, False)
    assert r.fold1_n == 0 and r.fold1_net is None and r.fold1_net_maker is None


def test_maker_only_cell(spark):
    r = stability.walk_forward(cell(spark, np.random.default_rng(1).normal(0.15, 0.01, 100))).first()
    assert r.full_net < 0 < r.full_net_maker and r.sign_stable and r.sign_stable_maker and r.verdict == "STABLE"


@pytest.mark.parametrize("n", [79, 80, 81, 82])
def test_fold_bounds(spark, n):
    values = np.arange(n, dtype=float)
    r = stability.walk_forward(cell(spark, values).repartition(3), segments=SegmentParams(rows=7)).first()
    bounds = [0, n // 3, 2 * n // 3, n]
    if n < 80:
        assert r.verdict == "INSUFFICIENT_N"
        return
    assert [r.fold1_n, r.fold2_n, r.fold3_n] == list(np.diff(bounds))
    assert r.fold2_net == pytest.approx(values[bounds[1] : bounds[2]].mean() - 0.18)


def test_cell_without_complete_outcome(spark):
    o = spark.createDataFrame([("x", "A", "1h", "E", "h+1", 0, None)], OUT)
    r = stability.walk_forward(o).first()
    assert (r.n_complete, r.full_mean, r.verdict, r.folds_same_sign) == (0, None, "INSUFFICIENT_N", 0)


def _universe(spark, values):
    rows = [("x", "A", "1h", "h+1", i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "exchange string, symbol string, timeframe string, horizon string, bar_idx long, forward_return_pct double")


def _observed(spark, n, mean):
    return spark.createDataFrame([("x", "A", "1h", "E", "h+1", n, float(mean))], ", ".join(f"{c} string" for c in CELL) + ", n_complete long, full_mean double")


@pytest.mark.parametrize("rows", [500, 100_000])
def test_permutation(spark, rows):
    rng = np.random.default_rng(3)
    universe = _universe(spark, rng.normal(0, 1, 3000))
    p, seg = StabilityParams(perms=300), SegmentParams(rows=rows)
    null = stability.permutation_test(_observed(spark, 200, 0.0), universe, p, segments=seg).first()
    assert null.p_value == 1.0 and null.verdict == "FAIL" and null.n_universe == 3000
    far = stability.permutation_test(_observed(spark, 200, 10.0), universe, p, segments=seg).first()
    assert far.verdict == "PASS" and far.p_value == pytest.approx(1 / 301)
    few = stability.permutation_test(_observed(spark, 10, 1.0), universe, p, segments=seg).first()
    assert few.verdict == "INSUFFICIENT_N" and few.p_value is None
    # One deviation of the mean of 200 draws: about 0.317, whatever the segments.
    one = stability.permutation_test(_observed(spark, 200, 1 / np.sqrt(200)), universe, p, segments=seg).first()
    assert abs(one.p_value - 0.317) < 4 * np.sqrt(0.317 * 0.683 / 300)


def test_draws_are_functions_of_cell_permutation_and_place(spark):
    """The same p-value for any segments and partitions, and that of drawing everything at once."""
    values = np.random.default_rng(3).normal(0, 1, 800)
    universe, p = _universe(spark, values), StabilityParams(perms=130)
    found = {
        (rows, parts): stability.permutation_test(_observed(spark, 90, 0.1), universe.repartition(parts), p, segments=SegmentParams(rows=rows)).first().p_value
        for rows, parts in ((100, 1), (100, 7), (33, 2), (10_000, 3))
    }
    key = int(hashlib.md5(b"17|x|A|1h|E|h+1").hexdigest()[:8], 16)
    at = stability.drawn_positions(key, np.arange(130), np.arange(90), 800)
    whole = np.floor(values / 1e-9 + 0.5).astype(np.int64)
    extreme = int((np.abs(whole[at].sum(axis=1) * 1e-9 / 90) >= 0.1).sum())
    assert set(found.values()) == {(extreme + 1) / 131}
    assert 0 < extreme < 130


def test_draws_in_shares_and_pieces(spark, monkeypatch):
    """Dense events: several tasks share a segment, draws come in several pieces."""
    universe = _universe(spark, np.random.default_rng(4).normal(0, 1, 500))
    p = StabilityParams(perms=120)
    want = stability.permutation_test(_observed(spark, 400, 0.05), universe, p).first().p_value
    monkeypatch.setattr(stability, "_PLACES", 64)
    monkeypatch.setattr(stability, "_DRAW_LIMIT", 5000)
    assert stability.permutation_test(_observed(spark, 400, 0.05), universe, p, segments=SegmentParams(rows=200)).first().p_value == want


def test_positions_are_even():
    at = stability.drawn_positions(99, np.arange(500), np.arange(400), 7)
    assert at.min() == 0 and at.max() == 6
    counts = np.bincount(at.reshape(-1).astype(int), minlength=7)
    assert np.abs(counts - counts.mean()).max() < 5 * np.sqrt(counts.mean())
    wide = stability.drawn_positions(5, np.arange(3), np.arange(3), (1 << 31) - 1)
    assert len(np.unique(wide)) == 9


# ---- candidates --------------------------------------------------------------------------------


def _wf(spark, rows):
    cols = "exchange string, symbol string, timeframe string, event_type string, horizon string, n_complete long, full_mean double, sign_stable boolean, sign_stable_maker boolean"
    full = [("x", s, "1h", "E", "h+1", n, m, t, k) for s, n, m, t, k, _ in rows]
    wf = spark.createDataFrame(full, cols)
    pm = spark.createDataFrame([("x", s, "1h", "E", "h+1", p) for s, *_, p in rows], "exchange string, symbol string, timeframe string, event_type string, horizon string, p_value double")
    return selection.research_candidates(wf, pm)


CASES = {
    "none": ((100, 0.20, True, True, 0.30), []),
    "maker only": ((120, 0.15, False, True, 0.08), [("M", "long", 0.05)]),
    "fade": ((150, -0.40, True, True, 0.01), [("M", "fade", 0.30), ("T", "fade", 0.22)]),
    "within friction": ((200, 0.01, True, True, 0.01), []),
    "small": ((79, 1.0, True, True, 0.01), []),
}


@pytest.mark.parametrize("name", CASES)
def test_candidate_gates(spark, name):
    row, want = CASES[name]
    got = sorted((r.tier, r.direction, round(r.net, 6)) for r in _wf(spark, [("A", *row)]).collect())
    assert got == want


def test_cross_symbol(spark):
    c = _wf(spark, [("A", 110, 0.40, True, True, 0.01), ("B", 90, 0.35, True, True, 0.02)])
    got = selection.cross_symbol(c, "A", "B").filter("tier = 'T'").collect()
    assert len(got) == 1 and got[0].direction == "long" and (got[0].a_n, got[0].b_n) == (110, 90)
    assert selection.cross_symbol(c, "A", "C").count() == 0


def _lb(spark, rows):
    cols = "exchange string, symbol string, timeframe string, event_type string, horizon string, count long, mean_forward_return double, hit_rate_at_zero double, mfe_mae_ratio double, sharpe_like double"
    return spark.createDataFrame([("x", s, "1h", e, "h+1", n, m, h, r, m) for s, e, n, m, h, r in rows], cols)


def test_pareto(spark):
    good, poor = (100, 1.0, 0.6, 1.2), (100, -1.0, 0.4, 0.5)
    lb = _lb(spark, [("A", "E", *good), ("B", "E", *good), ("A", "F", *good), ("B", "F", *poor), ("A", "G", *poor), ("C", "G", *poor)])
    got = selection.pareto(lb, "A", "B").collect()
    assert [(r.event_type, r.both_pass, r.one_symbol_only) for r in got] == [("E", True, False), ("F", False, True)]
    decide = lambda df: selection.pareto_decision(selection.pareto(df, "A", "B")).first().decision
    assert decide(lb) == "RESEARCH CANDIDATE"
    assert decide(lb.filter("event_type = 'F'")) == "WATCHLIST ONLY"
    assert decide(lb.filter("event_type = 'G'")) == "NO CANDIDATE"
    assert [r.event_type for r in selection.top_by_net(lb, 2).collect()] == ["G", "F"]


# ---- fills, stops, days --------------------------------------------------------------------------

FILLS = [
    # side, limit, high, low, close, action
    (1, 100.0, 101.0, 99.0, 99.95, "fill"),
    (1, 100.0, 101.0, 99.0, 99.96, "expire"),
    (1, 100.0, 101.0, 100.5, 100.7, "drop"),
    (-1, 100.0, 101.0, 99.0, 100.05, "fill"),
    (-1, 100.0, 101.0, 99.0, 100.04, "expire"),
    (-1, 100.0, 99.5, 99.0, 99.2, "drop"),
    (1, 100.0, None, None, None, "pending"),
]


def test_maker_decision(spark):
    df = spark.createDataFrame(FILLS, "side int, limit double, high double, low double, close double, want string")
    got = df.withColumn("got", trades.maker_decision(*[F.col(c) for c in ("side", "limit", "low", "high", "close")], 5.0))
    assert got.filter("got <> want").count() == 0


def test_stop_latch(spark):
    equity = [100.0, 120.0, 97.0, 96.0, 130.0, 90.0]
    df = spark.createDataFrame([("s", i, e) for i, e in enumerate(equity)], "strategy_id string, seq long, equity double")
    got = trades.latched_stop(df, ["strategy_id"], "seq", F.floor(F.col("seq") / 2)).toPandas().sort_values("seq")
    assert got.tripped.tolist() == [False, False, False, True, True, True]
    assert got.peak.tolist() == [100, 120, 120, 120, 130, 130]
    with pytest.raises(ValueError):
        trades.latched_stop(df, ["strategy_id"], "seq", F.lit(0), stop=0.3)


def test_daily_summary(spark):
    t = spark.createDataFrame([("s", "d1", 0.005, 0.003), ("s", "d1", -0.002, -0.004), ("s", "d1", 0.001, 0.0)], "strategy_id string, date string, pre_fee double, post_fee double")
    e = spark.createDataFrame([("s", "d1", 1, 100.0), ("s", "d1", 2, 110.0), ("s", "d1", 3, 99.0), ("s", "d2", 4, 50.0)], "strategy_id string, date string, seq long, equity double")
    got = trades.daily_summary(t, e, rows_per_segment=2).toPandas().set_index("date")
    assert got.loc["d1", "trades"] == 3 and got.loc["d1", "win_rate"] == pytest.approx(1 / 3)
    assert got.loc["d1", "intraday_max_dd"] == pytest.approx(0.1) and got.loc["d2", "trades"] == 0 and got.loc["d2", "intraday_max_dd"] == 0


def test_fees(spark):
    df = spark.range(1).select(trades.leg_fee(F.lit(50_000.0), F.lit(-0.01), 0.0004).alias("t"), trades.leg_fee(F.lit(50_000.0), F.lit(0.01), 0.0002).alias("m"))
    assert tuple(round(x, 9) for x in df.first()) == (0.2, 0.1)


@pytest.mark.parametrize("block", [3, 1000])
@pytest.mark.parametrize("group", [2, 4096])
def test_path_summary(spark, block, group, monkeypatch):
    monkeypatch.setattr(trades, "_GROUP", group)
    rng = np.random.default_rng(9)
    r = rng.normal(0, 5, 40)
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(r)], "strategy_id string, i long, r double").repartition(3)
    got = trades.path_summary(df, ["strategy_id"], "i", "r", F.floor(F.col("i") / block), start=200.0).first()
    eq = 200 * np.cumprod(1 + r / 100)
    peak = np.maximum.accumulate(np.r_[200, eq])[1:]
    assert got.final_equity == pytest.approx(eq[-1]) and got.max_drawdown_pct == pytest.approx(((peak - eq) / peak).max() * 100)
    ruin = df.unionByName(df.limit(1).withColumns({"i": F.lit(20).cast("long"), "r": F.lit(-100.0)}))
    assert tuple(trades.path_summary(ruin, ["strategy_id"], "i", "r", F.floor(F.col("i") / block)).first())[1:] == (0.0, 100.0)


def test_falsification(spark):
    def run(n, mean, seed=0):
        x = np.random.default_rng(seed).normal(mean, 0.5, n)
        rows = [("s", i, "IS" if i < n // 2 else "OOS", float(v) + 0.1, float(v)) for i, v in enumerate(x)]
        return trades.falsification(spark.createDataFrame(rows, "strategy_id string, trade_seq long, sample string, pre_fee_pct double, post_fee_pct double"))

    assert run(300, 0.5).first().verdict == "PRELIMINARY_PASS"
    assert run(299, 0.5).first().verdict == "INCONCLUSIVE"
    assert run(300, -0.5).first().verdict == "FAIL"
    mc = spark.createDataFrame([("s", "FAIL")], "strategy_id string, verdict string")
    assert trades.final_verdict(run(300, 0.5), mc).first().final_verdict == "FAIL"


# ---- Monte Carlo ----------------------------------------------------------------------------------


def _returns(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "strategy_id string, trade_seq long, pnl_pct double")


def test_return_column(spark):
    df = spark.createDataFrame([("s", 1, "0.5", 1.0), ("s", 2, " ", 2.0)], "strategy_id string, trade_seq long, return_pct string, profit_pct double")
    assert [r.pnl_pct for r in montecarlo.trade_returns(df).collect()] == [0.5]
    with pytest.raises(ValueError):
        montecarlo.trade_returns(df.select("strategy_id", "trade_seq"))


@pytest.mark.parametrize("mode", ["bootstrap", "shuffle"])
@pytest.mark.parametrize("block", [7, 1000])
def test_simulations(spark, mode, block):
    """Reordering keeps the product; the length of stretches changes nothing."""
    values = np.random.default_rng(2).normal(0.1, 1, 60)
    paths = montecarlo.simulate_equity(_returns(spark, values), sims=120, mode=mode, block=block).toPandas()
    assert sorted(paths.sim) == list(range(120)) and paths.max_drawdown_pct.between(0, 100).all()
    whole = 200 * np.prod(1 + values / 100)
    if mode == "shuffle":
        np.testing.assert_allclose(paths.final_equity, whole)
        assert paths.max_drawdown_pct.nunique() > 100
    else:
        spread = np.log(paths.final_equity / 200)
        want = np.log(1 + values / 100)
        assert abs(spread.mean() - want.sum()) < 4 * want.std() * np.sqrt(60) / np.sqrt(120)


def test_reordering_is_a_bijection():
    for n in [*range(1, 60), 1000, 4097]:
        got = montecarlo.reordered(12345, np.arange(n), n)
        assert sorted(got.tolist()) == list(range(n))
        assert montecarlo.reordered(12345, np.arange(n)[::7], n).tolist() == got[::7].tolist()
    # Every trade comes to every place about as often.
    at = np.stack([montecarlo.reordered(int(k), np.arange(10), 10) for k in np.random.default_rng(1).integers(0, 1 << 32, 4000)])
    counts = np.stack([np.bincount(at[:, i], minlength=10) for i in range(10)])
    assert np.abs(counts - 400).max() < 5 * np.sqrt(400 * 0.9)


def test_ruin(spark):
    paths = montecarlo.simulate_equity(_returns(spark, [-100.0] * 3), sims=3).collect()
    assert all((r.final_equity, r.max_drawdown_pct) == (0.0, 100.0) for r in paths)


@pytest.mark.parametrize(("n", "want"), [(299, "INCONCLUSIVE"), (300, "PASS")])
def test_monte_carlo_verdict(spark, n, want):
    r = _returns(spark, [0.5, 0.4] * (n // 2) + [0.5] * (n % 2))
    counts = r.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("trades"))
    assert montecarlo.monte_carlo_summary(montecarlo.simulate_equity(r, sims=20), counts).first().verdict == want


# ---- signals and ledger ------------------------------------------------------------------------------


def test_settlement_signal(spark):
    ends = {27_000_000: 100.0, 28_500_000: 101.0, 29_100_000: 100.5, 57_300_000: 50.0, 57_900_000: 50.0}
    rows = [("x", "A", "5m", e - 300_000, c) for e, c in ends.items()]
    df = spark.createDataFrame(rows, "exchange string, symbol string, timeframe string, ts_open_ms long, close double")
    got = {r.settle_ms: r for r in signals.settlement_displacement_signal(df).collect()}
    assert got[28_800_000].direction == -1 and got[28_800_000].displacement_pct == pytest.approx(1.0)
    assert got[28_800_000].signal_ts == 29_100_000
    assert got[57_600_000].direction == 0 and got[57_600_000].skip_reason == "missing_pre_window_start"


def test_breakout_signal(spark):
    rows = [("x", "A", "1h", i * 3_600_000, 100.1, 100.0, 100.05) for i in range(12)] + [("x", "A", "1h", 12 * 3_600_000, 101.0, 100.0, 100.9)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, timeframe string, ts_open_ms long, high double, low double, close double")
    got = signals.compression_breakout_signal(df, segments=SegmentParams(rows=5)).toPandas().sort_values("ts_open_ms")
    assert got.direction.tolist() == [0] * 12 + [1] and got.skip_reason.tolist()[0] == "warm_up"


@pytest.mark.parametrize("follow", [False, True])
def test_history_signal(spark, follow):
    rates = np.r_[np.random.default_rng(0).normal(0, 1, 90), -9.0, 9.0]
    df = spark.createDataFrame([("x", "A", i * 28_800_000, float(v)) for i, v in enumerate(rates)], "exchange string, symbol string, ts_settle_ms long, funding_rate double")
    got = signals.funding_zscore_signal(df, follow_sign=follow, segments=SegmentParams(rows=20)).toPandas().sort_values("ts_settle_ms")
    assert got.direction.tolist()[:90] == [0] * 90
    assert got.direction.tolist()[90:] == ([-1, 1] if follow else [1, 1])
    past = rates[1:91]
    assert got.funding_zscore.iloc[-1] == pytest.approx((9.0 - past.mean()) / past.std())


def _greedy(frame, live, hold, stop):
    """Bar by bar: take a signal when flat."""
    n, busy, taken = len(frame), -1, {}
    for i, side in live:
        if i < busy or i + 2 >= n:
            continue
        entry, out = frame.close[i + 1], min(i + 1 + hold, n - 1)
        for j in range(i + 2, out + 1):
            if side * (frame.close[j] / entry - 1) <= -stop:
                out = j
                break
        taken[i], busy = out, out
    return taken


@pytest.mark.parametrize("rows", [9, 40, 5000])
def test_ledger_matches_walk(spark, rows):
    frame = price_frame(300, seed=6)
    rng = np.random.default_rng(1)
    live = [(i, int(rng.choice([-1, 1]))) for i in range(300) if rng.random() < 0.4]
    bars = to_spark(spark, frame)
    sig = spark.createDataFrame([("s", "x", "A", "1h", i * 3_600_000, d) for i, d in live], "strategy_id string, exchange string, symbol string, timeframe string, ts_open_ms long, direction int")
    got = ledger.trade_ledger(sig, bars, hold_bars=6, stop_frac=0.015, segments=SegmentParams(rows=rows)).toPandas()
    want = _greedy(frame, live, 6, 0.015)
    assert dict(zip(got[got.taken].signal_idx, got[got.taken].exit_idx, strict=True)) == want
    assert len(got) == len(live) and (got[~got.taken].skip_reason.notna()).all()
    assert trades.leakage_audit(ledger.taken_trades(ledger.trade_ledger(sig, bars, 6))).first().violations == 0


def test_first_against():
    rng = np.random.default_rng(3)
    close = np.where(rng.random(300) < 0.1, np.nan, rng.normal(100, 3, 300))
    first, last = rng.integers(0, 300, 500), rng.integers(0, 320, 500)
    side, entry = rng.choice([-1, 1], 500), rng.choice([100.0, 99.0, -100.0, 0.0], 500)
    got = ledger.first_against(close, first, last, side, entry, 0.04)
    with np.errstate(all="ignore"):
        hits = side[:, None] * (close[None, :] / entry[:, None] - 1.0) <= -0.04
    want = [next((j for j in range(a, min(b, 299) + 1) if h[j]), -1) for a, b, h in zip(first, last, hits, strict=True)]
    assert got.tolist() == want and (got >= 0).any() and (got < 0).any()


def _plain(frame, live, hold, stop):
    """Exit place and reason of each signal, bar by bar; a bar without a close does not count."""
    n, out = len(frame), {}
    for i, side in live:
        if i + 1 >= n or np.isnan(frame.close[i + 1]):
            out[i] = (None, "no_entry_bar")
            continue
        seen = [j for j in range(i + 2, min(i + 1 + hold, n - 1) + 1) if not np.isnan(frame.close[j])]
        hit = next((j for j in seen if side * (frame.close[j] / frame.close[i + 1] - 1) <= -stop), None)
        if not seen:
            out[i] = (None, "no_exit_bar")
        else:
            out[i] = (hit, "stop") if hit is not None else (seen[-1], "time_exit" if seen[-1] == i + 1 + hold else "end_of_data")
    return out


@pytest.mark.parametrize(("rows", "hold"), [(7, 40), (16, 3), (64, 150), (5000, 25)])
def test_exits_across_segments(spark, rows, hold):
    frame = price_frame(260, seed=9)
    rng = np.random.default_rng(2)
    frame.loc[rng.choice(260, 20, replace=False), "close"] = np.nan
    live = [(i, int(rng.choice([-1, 1]))) for i in range(260)]
    sig = spark.createDataFrame([("s", "x", "A", "1h", i * 3_600_000, d) for i, d in live] * 2, "strategy_id string, exchange string, symbol string, timeframe string, ts_open_ms long, direction int")
    got = ledger.candidate_trades(sig, to_spark(spark, frame), hold, 0.03, SegmentParams(rows=rows)).toPandas()
    have = {r.signal_idx: (None if pd.isna(r.exit_idx) else int(r.exit_idx), r.exit_reason or r.skip_reason) for r in got.itertuples()}
    assert len(got) == len(live) and have == _plain(frame, live, hold, 0.03)
    assert {w for _, w in have.values()} >= {"stop", "time_exit", "no_entry_bar", "no_exit_bar"}


def test_exits_salted(spark, monkeypatch):
    """More signals on a segment than one task takes are spread; the exits stay."""
    frame = price_frame(80, seed=4)
    bars = to_spark(spark, frame)
    sig = spark.createDataFrame([(f"s{k}", "x", "A", "1h", i * 3_600_000, 1) for i in range(80) for k in range(3)], "strategy_id string, exchange string, symbol string, timeframe string, ts_open_ms long, direction int")
    pick = lambda df: sorted((r.strategy_id, r.signal_idx, r.exit_idx, r.exit_reason) for r in df.filter("exit_idx is not null").collect())
    whole = pick(ledger.candidate_trades(sig, bars, 9, 0.02))
    monkeypatch.setattr(ledger, "_SIGNALS_PER_BAR", 1)
    assert pick(ledger.candidate_trades(sig, bars, 9, 0.02, SegmentParams(rows=8))) == whole and len(whole) == 3 * 78


def test_maker_fill_window(spark):
    frame = price_frame(30).assign(side=1)
    frame["limit_price"] = frame.close
    seg = cut(ensure_index(to_spark(spark, frame), SERIES_KEYS, 7), SERIES_KEYS, "ts_open_ms", 7, after=1)
    got = seg.with_columns({"a": trades.maker_fill(seg)}).owned().toPandas().sort_values("ts_open_ms")
    assert got.a.iloc[-1] == "pending" and set(got.a[:-1]) <= {"fill", "expire", "drop"}


def test_exact_fees(spark):
    df = spark.createDataFrame([(1, 100.0, 110.0, 2.0)], "direction int, entry_price double, exit_price double, quantity double")
    r = trades.add_exact_fees(df, 0.0002, 0.0004).first()
    assert r.pre_fee_pct == pytest.approx(10.0) and r.post_fee_pct == pytest.approx(10 - 100 * (0.04 + 0.088) / 200)
    assert trades.add_trade_returns(df).first().full_friction_pct == pytest.approx(9.82)


def test_run_totals(spark):
    rows = [("s", i, 1.0) for i in range(10)]
    r = trades.run_totals(spark.createDataFrame(rows, "strategy_id string, trade_seq long, post_fee_pct double"), block_rows=3).first()
    assert r.net_return_pct == pytest.approx((1.01**10 - 1) * 100) and r.too_few_trades and r.max_drawdown_pct == 0


def test_pandas_version_of_ratio(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 1.0), (4.0, 2.0), (1.0, None)], "a double, b double")
    from tidegrid.functions.scalars import change

    got = [r.c for r in df.select(change(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == float("inf") and got[1] is None and got[2] is None and got[3] == 1.0 and got[4] is None
    assert pd.notna(got[3])
