"""Streaming forms of the operators that read a feed bar by bar.

Inputs are streaming DataFrames with a ``ts`` timestamp next to the millisecond columns.
State is keyed by instrument or finer; every state has an end (watermark or time-to-live).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tidegrid.params import DAY_MS
from tidegrid.session import shared_folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TWO_DAYS_MS = 2 * DAY_MS


def event_time(df: DataFrame, ms: str, delay: str) -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis(ms)).withWatermark("ts", delay)


# ---- windows ------------------------------------------------------------------------------------


def stream_close_bars(observations: DataFrame, minutes: int = 5, needed: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Bars from closes, labelled by their end, emitted when the watermark passes.

    An observation at the end of a bar belongs to it, hence the shift by a millisecond.  The
    watermark also ends the state of old bars.
    """
    timed = observations.withColumn("ts", F.timestamp_millis(F.col("ts_ms") - 1)).withWatermark("ts", delay)
    bars = timed.groupBy("exchange", "symbol", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        # Of several observations at one time the lowest opens and the highest closes.
        F.min_by("value", F.struct("ts_ms", "value")).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", F.struct("ts_ms", "value")).alias("close"),
        F.count(F.lit(1)).alias("observations"),
    )
    return bars.select(
        "exchange",
        "symbol",
        F.unix_millis("w.end").alias("bar_end_ms"),
        "open",
        "high",
        "low",
        "close",
        "observations",
        (F.col("observations") == needed).alias("complete"),
    )


def stream_daily_summary(trades: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``trades(strategy_id, exit_ms, pre_fee, post_fee)``: one row per strategy and day, when
    the day is over."""
    timed = event_time(trades, "exit_ms", delay)
    return (
        timed.groupBy("strategy_id", F.window("ts", "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("trades"),
            F.avg((F.col("post_fee") > 0).cast("double")).alias("win_rate"),
            F.avg("pre_fee").alias("avg_pre_fee"),
            F.avg("post_fee").alias("avg_post_fee"),
        )
        .select("strategy_id", F.unix_millis("w.start").alias("day_ms"), "trades", "win_rate", "avg_pre_fee", "avg_post_fee")
    )


def stream_match_bars(price: DataFrame, premium: DataFrame, wait: str = "25 minutes") -> DataFrame:
    """Price bars with their premium bar of the same end, whichever comes first.

    A bar waits for its partner as long as the watermark allows, then it is given up.
    """
    a = event_time(price, "bar_end_ms", wait)
    b = event_time(premium.withColumnRenamed("bar_end_ms", "premium_end_ms"), "premium_end_ms", wait)
    b = b.select(
        F.col("exchange").alias("_e"), F.col("symbol").alias("_s"), F.col("ts").alias("_t"), "premium_delta", "complete"
    )
    on = (F.col("exchange") == F.col("_e")) & (F.col("symbol") == F.col("_s")) & (F.col("ts") == F.col("_t"))
    return a.join(b, on).select("exchange", "symbol", "bar_end_ms", "premium_delta", "complete")


# ---- arbitrary state ------------------------------------------------------------------------------

_KEY_FIELDS = [StructField("exchange", StringType()), StructField("symbol", StringType())]


#: Rows that a processor gives out, or works on, at a time.
_SLICE = 16_384


def _ordered(frames: Iterator[pd.DataFrame], order: str, other: str, later_than: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a key by time, in the order of arrival at one time, as plain arrays of time and value.

    Frames hold objects, hundreds of bytes a row with the key, so each is reduced to its 16 bytes a row as it
    comes.  Rows without a time, or not later than ``later_than``, take no part.
    """
    times, values = [np.empty(0, "int64")], [np.empty(0, "float64")]
    for frame in frames:
        wanted = frame[order].notna()
        if later_than is not None:
            wanted &= frame[order] > later_than
        times.append(frame.loc[wanted, order].to_numpy("int64"))
        values.append(frame.loc[wanted, other].to_numpy("float64", na_value=np.nan))
    # One column after the other, so that the parts of a column go before the next one is put together.
    ts = np.concatenate(times)
    times.clear()
    value = np.concatenate(values)
    values.clear()
    if (ts[1:] < ts[:-1]).any():
        place = np.argsort(ts, kind="stable")
        ts, value = ts[place], value[place]
    return ts, value


def _first_of_time(ts: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows at one time the first stays."""
    first = np.concatenate((np.full(min(len(ts), 1), True), ts[1:] != ts[:-1]))
    return (ts, value) if first.all() else (ts[first], value[first])


def _slices(n: int) -> Iterator[slice]:
    return (slice(i, min(i + _SLICE, n)) for i in range(0, n, _SLICE))


def _stateful(grouped, processor: StatefulProcessor, schema: StructType, keep_ms: int | None) -> DataFrame:
    """State that is not touched for ``keep_ms`` of wall-clock time ends; without it, it stays.

    For a bounded run with ``keep_ms`` see ``with_state_store``.
    """
    mode = "None" if keep_ms is None else "ProcessingTime"
    return grouped.transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


class NewSettlements(StatefulProcessor):
    """Settlements later than all that were seen: repeats and late ones are dropped."""

    def __init__(self, keep_ms: int | None) -> None:
        self._keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", StructType([StructField("ts", LongType())]), self._keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self._last.get()[0] if self._last.exists() else -(2**62)
        # Only the different times of a batch are held.
        times = pd.Series(dtype="int64")
        for frame in rows:
            fresh = frame["ts_settle_ms"].dropna().astype("int64")
            times = pd.concat([times, fresh[fresh > last]]).drop_duplicates()
        times = times.sort_values()
        if len(times):
            self._last.update((int(times.iloc[-1]),))
        yield pd.DataFrame({"exchange": key[0], "symbol": key[1], "ts_settle_ms": times.astype("int64")})

    def close(self) -> None:
        pass


def stream_drop_repeats(funding: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Settlements per instrument in the order of time; what is not later than the newest one is dropped."""
    schema = StructType([*_KEY_FIELDS, StructField("ts_settle_ms", LongType())])
    return _stateful(funding.groupBy("exchange", "symbol"), NewSettlements(keep_ms), schema, keep_ms)


class LatestFunding(StatefulProcessor):
    """Bars and settlements in one stream: each bar gets the last rate known at its end."""

    def __init__(self, keep_ms: int | None) -> None:
        self._keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("ts", LongType()), StructField("rate", DoubleType())])
        self._last = handle.getValueState("last", schema, self._keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ts, rate = _ordered(rows, "ts_ms", "funding_rate")
        settled = ~np.isnan(rate)
        known = self._last.get() if self._last.exists() else None
        at, rates = ts[settled], rate[settled]
        if len(at) and (known is None or at[-1] > known[0]):
            self._last.update((int(at[-1]), float(rates[-1])))
        bars = ts[~settled]
        del ts, rate, settled
        for part in _slices(len(bars)):
            end = bars[part]
            # Settlements at the time of a bar's end or before it; of the same time the last that came.
            before = np.searchsorted(at, end, side="right")
            found = before > 0
            funding_ms, funding = np.zeros(len(end), "int64"), np.zeros(len(end))
            funding_ms[found], funding[found] = at[before[found] - 1], rates[before[found] - 1]
            if known is not None:
                funding_ms[~found], funding[~found] = known
                found |= funding_ms <= end
            yield pd.DataFrame(
                {
                    "exchange": key[0],
                    "symbol": key[1],
                    "bar_end_ms": end[found],
                    "funding_ms": funding_ms[found],
                    "funding_rate": funding[found],
                }
            )

    def close(self) -> None:
        pass


def stream_latest_funding(mixed: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """``mixed(exchange, symbol, ts_ms, funding_rate)``: a settlement has a rate, a bar none."""
    schema = StructType(
        [*_KEY_FIELDS, StructField("bar_end_ms", LongType()), StructField("funding_ms", LongType()), StructField("funding_rate", DoubleType())]
    )
    return _stateful(mixed.groupBy("exchange", "symbol"), LatestFunding(keep_ms), schema, keep_ms)


class FundingHistory(StatefulProcessor):
    """z-score against the last settlements; repeats and late settlements are ignored."""

    def __init__(self, history: int, z_min: float, keep_ms: int | None) -> None:
        self._n, self._z_min, self._keep_ms = history, z_min, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("ts", LongType()), StructField("rates", ArrayType(DoubleType()))])
        self._past = handle.getValueState("past", schema, self._keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, past = self._past.get() if self._past.exists() else (-(2**62), [])
        ts, rates = _first_of_time(*_ordered(rows, "ts_settle_ms", "funding_rate", last))
        if not len(ts):
            return
        past = list(past)[-self._n :]
        empty = self._n - len(past)
        line = np.concatenate((np.full(empty, np.nan), np.asarray(past, "float64"), rates))
        self._past.update((int(ts[-1]), line[max(len(ts), empty) :].tolist()))
        # Windows of the settlements before each one, a slice of rows at a time: their spread needs all of them as numbers.
        for part in _slices(len(ts)):
            windows = np.lib.stride_tricks.sliding_window_view(line[part.start : part.stop - 1 + self._n], self._n)
            spread = windows.std(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                z = np.where(spread > 0, (rates[part] - windows.mean(axis=1)) / spread, np.nan)
            yield pd.DataFrame(
                {
                    "exchange": key[0],
                    "symbol": key[1],
                    "ts_settle_ms": ts[part],
                    "funding_rate": rates[part],
                    "funding_zscore": z,
                    "direction": (np.abs(z) >= self._z_min).astype("int64"),
                }
            )

    def close(self) -> None:
        pass


def stream_funding_signal(funding: DataFrame, history: int = 90, z_min: float = 2.0, keep_ms: int | None = None) -> DataFrame:
    schema = StructType(
        [
            *_KEY_FIELDS,
            StructField("ts_settle_ms", LongType()),
            StructField("funding_rate", DoubleType()),
            StructField("funding_zscore", DoubleType()),
            StructField("direction", LongType()),
        ]
    )
    return _stateful(funding.groupBy("exchange", "symbol"), FundingHistory(history, z_min, keep_ms), schema, keep_ms)


class FirstCross(StatefulProcessor):
    """Rows on which a condition starts to hold.  The flag of an instrument that is silent
    for two days of event time is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("ts", LongType()), StructField("on", BooleanType())])
        self._handle = handle
        self._prev = handle.getValueState("prev", schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self._prev.exists()
        seen, on = self._prev.get() if known else (-(2**62), False)
        ts, cond = _ordered(rows, "ts_ms", "cond", seen)
        if not len(ts):
            return
        now = cond == 1.0
        before = np.concatenate(([bool(on)], now[:-1]))
        last = int(ts[-1])
        self._prev.update((last, bool(now[-1])))
        if known:
            self._handle.deleteTimer(seen + _TWO_DAYS_MS)
        self._handle.registerTimer(last + _TWO_DAYS_MS)
        fired = ts[now & ~before]
        for part in _slices(len(fired)):
            yield pd.DataFrame({"exchange": key[0], "symbol": key[1], "ts_ms": fired[part]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._prev.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_first_cross(flags: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``flags(exchange, symbol, ts_ms, cond)``."""
    schema = StructType([*_KEY_FIELDS, StructField("ts_ms", LongType())])
    return event_time(flags, "ts_ms", delay).groupBy("exchange", "symbol").transformWithStateInPandas(
        statefulProcessor=FirstCross(), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


class StopLatch(StatefulProcessor):
    """Running peak and a stop that stays tripped; what is not later than the newest row is ignored."""

    def __init__(self, stop: float, keep_ms: int | None) -> None:
        self._stop, self._keep_ms = stop, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("seq", LongType()), StructField("peak", DoubleType()), StructField("tripped", BooleanType())])
        self._state = handle.getValueState("latch", schema, self._keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen, top, tripped = self._state.get() if self._state.exists() else (-(2**62), float("-inf"), False)
        seq, equity = _first_of_time(*_ordered(rows, "seq", "equity", seen))
        if not len(seq):
            return
        line = pd.Series(equity)
        peak = line.cummax().clip(lower=top)
        drop = ((peak - line) / peak).where(peak > 0, 0.0)
        hit = (drop >= self._stop).cummax() | bool(tripped)
        self._state.update((int(seq[-1]), float(peak.iloc[-1]), bool(hit.iloc[-1])))
        for part in _slices(len(seq)):
            yield pd.DataFrame(
                {
                    "strategy_id": key[0],
                    "seq": seq[part],
                    "equity": equity[part],
                    "drawdown": drop.to_numpy()[part],
                    "tripped": hit.to_numpy()[part],
                }
            )

    def close(self) -> None:
        pass


def stream_stop_latch(equity: DataFrame, stop: float = 0.20, keep_ms: int | None = None) -> DataFrame:
    """``equity(strategy_id, seq, equity)``."""
    schema = StructType(
        [
            StructField("strategy_id", StringType()),
            StructField("seq", LongType()),
            StructField("equity", DoubleType()),
            StructField("drawdown", DoubleType()),
            StructField("tripped", BooleanType()),
        ]
    )
    return _stateful(equity.groupBy("strategy_id"), StopLatch(stop, keep_ms), schema, keep_ms)


# ---- running a stream over what is there ------------------------------------------------------------


#: The time of the row that ends an input: later than all that a feed will hold.
END_MS = 253_370_764_800_000


def _run(stream: DataFrame, place: str, mode: str) -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{place}/table")
        .option("checkpointLocation", f"{place}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_available(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all data its sources hold now; the result is a table, read back.

    Table and progress go to the shared checkpoint folder of the session.
    """
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    _run(stream, place, mode)
    return spark.read.schema(stream.schema).parquet(f"{place}/table")


def run_to_end(spark: SparkSession, source: DataFrame, ms: str, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Run ``build(source)`` over a bounded input, with the windows that are open at its end.

    A watermark follows the newest row, so the last windows of an input that stops would stay open for ever.
    Here a second source stands beside the first, empty while that is read.  Then it gets one row, far
    in the future and null but for ``ms``, and the same query goes on from its own progress: the watermark passes
    every open window, while the row's own one stays open.
    """
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ends = f"{place}/end"
    spark.createDataFrame([], source.schema).write.parquet(ends)
    stream = build(source.unionByName(spark.readStream.schema(source.schema).parquet(ends)))
    _run(stream, place, mode)
    row = [END_MS if f.name == ms else None for f in source.schema]
    nullable = StructType([StructField(f.name, f.dataType) for f in source.schema])
    spark.createDataFrame([row], nullable).write.mode("append").parquet(ends)
    _run(stream, place, mode)
    return spark.read.schema(stream.schema).parquet(f"{place}/table")


def with_state_store(spark: SparkSession, run: Callable[[], DataFrame], idle_batches: bool = True) -> DataFrame:
    """Arbitrary state needs the RocksDB store; the settings are put back afterwards.

    A state with a time to live asks for batches without data for ever, so a bounded run of one
    must go without them.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    if not idle_batches:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return run()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
