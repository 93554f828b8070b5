"""Streams over files give what the batch operators give; state survives between batches."""

from __future__ import annotations

import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators.signals import close_bars, funding_zscore_signal
from tidegrid.params import HOUR_MS, MINUTE_MS
from tidegrid.streaming import streams as st


def feed(spark, folder, parts):
    """A stream that reads one file per batch; files are read in the order of their age."""
    os.makedirs(folder, exist_ok=True)
    for i, df in enumerate(parts):
        path = f"{folder}/{i}.parquet"
        df.toPandas().to_parquet(path)
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def stateful(spark, stream, idle_batches=True):
    return st.with_state_store(spark, lambda: st.run_available(spark, stream), idle_batches)


def test_close_bars(spark, tmp_path):
    # Ends of observations: minute 5 belongs to the first bar; the second one lacks one.
    minutes = [1, 2, 3, 4, 5, 6, 7, 8, 10, 30, 60]
    df = spark.createDataFrame([("x", "A", m * MINUTE_MS, float(m)) for m in minutes], "exchange string, symbol string, ts_ms long, value double")
    s = feed(spark, str(tmp_path / "in"), [df.filter("ts_ms <= 360000"), df.filter("ts_ms > 360000")])
    got = st.run_available(spark, st.stream_close_bars(s)).toPandas().sort_values("bar_end_ms")
    batch = close_bars(df, 5 * MINUTE_MS, 5).toPandas().sort_values("bar_end_ms")
    assert got.complete.tolist()[:2] == [True, False] and got.observations.tolist()[:2] == [5, 4]
    n = len(got)
    assert got[["open", "high", "low", "close"]].values.tolist() == batch[["open", "high", "low", "close"]].head(n).values.tolist()


def test_latest_funding_over_batches(spark, tmp_path):
    schema = "exchange string, symbol string, ts_ms long, funding_rate double"
    one = spark.createDataFrame([("x", "A", 1, None), ("x", "A", 5, 0.1), ("x", "A", 5, None)], schema)
    two = spark.createDataFrame([("x", "A", 9, None), ("x", "A", 12, 0.2), ("x", "A", 13, None)], schema)
    got = stateful(spark, st.stream_latest_funding(feed(spark, str(tmp_path / "in"), [one, two])))
    assert sorted((r.bar_end_ms, r.funding_rate) for r in got.collect()) == [(5, 0.1), (9, 0.1), (13, 0.2)]


def test_history_over_batches(spark, tmp_path):
    rates = [0.1, -0.2, 0.3, 0.0, 5.0, 0.1]
    rows = [("x", "A", i * 28_800_000, r) for i, r in enumerate(rates)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, ts_settle_ms long, funding_rate double")
    # The second file repeats a settlement.
    s = feed(spark, str(tmp_path / "in"), [df.filter("ts_settle_ms <= 57600000"), df.filter("ts_settle_ms >= 57600000")])
    got = stateful(spark, st.stream_funding_signal(s, history=3)).toPandas().sort_values("ts_settle_ms")
    want = funding_zscore_signal(df, history=3).toPandas().sort_values("ts_settle_ms")
    assert got.direction.tolist() == want.direction.tolist() and len(got) == 6
    assert got.funding_zscore.dropna().tolist() == pytest.approx(want.funding_zscore.dropna().tolist())


def test_first_cross_over_batches(spark, tmp_path):
    schema = "exchange string, symbol string, ts_ms long, cond boolean"
    one = spark.createDataFrame([("x", "A", 1, True), ("x", "A", 2, True), ("x", "A", 3, False), ("x", "A", 4, True)], schema)
    two = spark.createDataFrame([("x", "A", 5, True), ("x", "A", 6, None), ("x", "A", 7, True)], schema)
    got = stateful(spark, st.stream_first_cross(feed(spark, str(tmp_path / "in"), [one, two])))
    assert sorted(r.ts_ms for r in got.collect()) == [1, 4, 7]


def test_stop_over_batches(spark, tmp_path):
    schema = "strategy_id string, seq long, equity double"
    one = spark.createDataFrame([("s", 1, 100.0), ("s", 2, 120.0)], schema)
    two = spark.createDataFrame([("s", 3, 96.0), ("s", 4, 130.0)], schema)
    got = stateful(spark, st.stream_stop_latch(feed(spark, str(tmp_path / "in"), [one, two]))).toPandas().sort_values("seq")
    assert got.tripped.tolist() == [False, False, True, True] and got.drawdown.tolist() == pytest.approx([0, 0, 0.2, 0])


def test_match_waits_for_partner(spark, tmp_path):
    price = spark.createDataFrame([("x", "A", m * MINUTE_MS) for m in (5, 10, 15)], "exchange string, symbol string, bar_end_ms long")
    late = [spark.createDataFrame([("x", "A", m * MINUTE_MS, 0.1, True)], "exchange string, symbol string, bar_end_ms long, premium_delta double, complete boolean") for m in (10, 5)]
    a, b = feed(spark, str(tmp_path / "a"), [price]), feed(spark, str(tmp_path / "b"), late)
    got = st.run_available(spark, st.stream_match_bars(a, b))
    assert sorted(r.bar_end_ms for r in got.collect()) == [5 * MINUTE_MS, 10 * MINUTE_MS]


def test_repeats_are_dropped(spark, tmp_path):
    schema = "exchange string, symbol string, ts_settle_ms long"
    parts = [spark.createDataFrame([("x", "A", h * HOUR_MS) for h in hours], schema) for hours in ((96, 104, 104), (104, 112))]
    got = stateful(spark, st.stream_drop_repeats(feed(spark, str(tmp_path / "in"), parts)))
    assert sorted(r.ts_settle_ms // HOUR_MS for r in got.collect()) == [96, 104, 112]
    # A time that is new but late is dropped, as if the feed had gone on.
    parts = [spark.createDataFrame([("x", "A", h * HOUR_MS) for h in hours], schema) for hours in ((96, 104), (100, 112), (112, 108))]
    got = stateful(spark, st.stream_drop_repeats(feed(spark, str(tmp_path / "late"), parts), keep_ms=3_600_000), idle_batches=False)
    assert sorted(r.ts_settle_ms // HOUR_MS for r in got.collect()) == [96, 104, 112]


def test_bounded_input_ends(spark, tmp_path):
    """The last windows come out, whatever the number of batches; nothing of the end row does."""
    minutes = [1, 2, 3, 4, 5, 6, 7, 8, 10, 30, 60, 61]
    df = spark.createDataFrame([("x", "A", m * MINUTE_MS, float(m)) for m in minutes], "exchange string, symbol string, ts_ms long, value double")
    want = close_bars(df, 5 * MINUTE_MS, 5).orderBy("bar_end_ms").select("bar_end_ms", "open", "close", "complete").collect()
    for name, cuts in (("one", [99]), ("three", [5, 10, 99])):
        parts, low = [], 0
        for high in cuts:
            parts.append(df.filter((F.col("ts_ms") > low * MINUTE_MS) & (F.col("ts_ms") <= high * MINUTE_MS)))
            low = high
        s = feed(spark, str(tmp_path / name), parts)
        got = st.run_to_end(spark, s, "ts_ms", st.stream_close_bars)
        assert got.orderBy("bar_end_ms").select("bar_end_ms", "open", "close", "complete").collect() == want


def test_state_ends(spark, tmp_path):
    """A state that is kept for a moment only is gone with the next batch; with a long time it is there."""
    schema = "strategy_id string, seq long, equity double"
    parts = [spark.createDataFrame([("s", 1, 100.0), ("s", 2, 70.0)], schema), spark.createDataFrame([("s", 2, 1.0), ("s", 3, 70.0)], schema)]
    for keep, tripped in ((1, [False, True, False, False]), (86_400_000, [False, True, True])):
        got = stateful(spark, st.stream_stop_latch(feed(spark, str(tmp_path / str(keep)), parts), keep_ms=keep), idle_batches=False)
        assert [r.tripped for r in got.orderBy("seq", F.desc("equity")).collect()] == tripped


def test_daily_summary(spark, tmp_path):
    day = 24 * HOUR_MS
    df = spark.createDataFrame([("s", 1, 0.3, 0.1), ("s", 2, 0.1, -0.1), ("s", 3 * day, 0.0, 0.0)], "strategy_id string, exit_ms long, pre_fee double, post_fee double")
    got = st.run_available(spark, st.stream_daily_summary(feed(spark, str(tmp_path / "in"), [df]))).withColumn("d", F.col("day_ms") / day)
    r = got.collect()
    assert len(r) == 1 and (r[0].trades, r[0].win_rate) == (2, 0.5) and r[0].avg_pre_fee == pytest.approx(0.2)


class _Value:
    """A value state and its handle, without a store."""

    row = None

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


def processed(processor, frames):
    """What a processor gives out for one key, and the most bytes it held over its input and output."""
    processor.init(_Value())
    tracemalloc.start()
    parts, rows = [], 0
    for part in processor.handleInputRows(("x", "A"), frames, None):
        rows += len(part)
        parts.append(part.iloc[:: max(len(part) // 50, 1)].copy())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return pd.concat(parts), rows, peak


def frames_of(n, make):
    for i in range(0, n, 10_000):
        at = (np.arange(i, min(i + 10_000, n)) * 7919) % n
        yield make(at).assign(exchange="x" * 20, symbol="A" * 20).astype({"exchange": object, "symbol": object})


def test_long_batch_of_a_key_is_held_as_numbers():
    """A key with 200,003 rows in one batch, out of order: few bytes a row, and the results of a plain loop."""
    n = 200_003
    rate = lambda t: (t * 31 % 101) / 1000.0
    history = st.FundingHistory(90, 1.5, None)
    got, rows, peak = processed(history, frames_of(n, lambda t: pd.DataFrame({"ts_settle_ms": t, "funding_rate": rate(t)})))
    assert rows == n and peak < 130 * n
    for r in got.itertuples():
        if r.ts_settle_ms >= 90:
            before = rate(np.arange(r.ts_settle_ms - 90, r.ts_settle_ms))
            assert r.funding_zscore == pytest.approx((r.funding_rate - before.mean()) / before.std())
        else:
            assert np.isnan(r.funding_zscore)
    assert history._past.row == (n - 1, rate(np.arange(n - 90, n)).tolist())

    latest = st.LatestFunding(None)
    got, rows, peak = processed(latest, frames_of(n, lambda t: pd.DataFrame({"ts_ms": t, "funding_rate": np.where(t % 7 == 3, rate(t), np.nan)})))
    assert rows == sum(1 for t in range(3, n) if t % 7 != 3) and peak < 130 * n
    assert ((got.bar_end_ms - 3) // 7 * 7 + 3 == got.funding_ms).all() and (got.funding_rate == rate(got.funding_ms)).all()


def test_history_state_is_short_at_first():
    history = st.FundingHistory(4, 1.5, None)
    rows = lambda ts: iter([pd.DataFrame({"ts_settle_ms": ts, "funding_rate": [t / 10 for t in ts]})])
    history.init(_Value())
    list(history.handleInputRows(("x", "A"), rows([2, 1, 2]), None))
    assert history._past.row == (2, [0.1, 0.2])
    got = pd.concat(history.handleInputRows(("x", "A"), rows([5, 2, 3, 4, 6]), None))
    assert got.ts_settle_ms.tolist() == [3, 4, 5, 6] and history._past.row == (6, [0.3, 0.4, 0.5, 0.6])
    assert got.funding_zscore.isna().tolist() == [True, True, False, False]
