"""Trades, equity and verdicts on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.segments import Segments, running, with_row_index
from tidegrid.params import FrictionParams

# ---- fees and returns ------------------------------------------------------------------------


def leg_fee(price: Column, quantity: Column, rate: float) -> Column:
    return F.lit(rate) * F.abs(quantity) * price


def leg_slippage(price: Column, rate: float = FrictionParams().taker_slippage_side) -> Column:
    return F.lit(rate) * price


def add_trade_returns(trades: DataFrame, p: FrictionParams = FrictionParams()) -> DataFrame:
    """Percent returns before fees, after fees, and after full friction."""
    gross = F.col("direction") * (F.col("exit_price") / F.nullif(F.col("entry_price"), F.lit(0.0)) - 1.0) * 100.0
    return trades.withColumns(
        {
            "pre_fee_pct": gross,
            "post_fee_pct": gross - F.lit(p.fee_only_round_trip),
            "full_friction_pct": gross - F.lit(p.taker_round_trip),
        }
    )


def add_exact_fees(trades: DataFrame, entry_rate: float, exit_rate: float) -> DataFrame:
    """Percent of entry notional after the fee of each leg."""
    quantity = F.abs("quantity")
    notional = F.col("entry_price") * quantity
    gross = (F.col("exit_price") - F.col("entry_price")) * quantity * F.col("direction")
    fees = leg_fee(F.col("entry_price"), quantity, entry_rate) + leg_fee(F.col("exit_price"), quantity, exit_rate)
    share = lambda x: F.when(notional > 0, 100.0 * x / notional).otherwise(F.lit(0.0))
    return trades.withColumns({"pre_fee_pct": share(gross), "post_fee_pct": share(gross - fees)})


def leakage_audit(trades: DataFrame, signal_ts: str = "signal_ts", execution_ts: str = "entry_ts") -> DataFrame:
    """Trades that execute no later than their signal, per strategy and symbol."""
    late = F.col(execution_ts) - F.col(signal_ts) > 0
    return trades.groupBy("strategy_id", "symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(~F.coalesce(late, F.lit(False))).alias("violations")
    )


def maker_fill(seg: Segments, adverse_bp: float = 5.0) -> Column:
    """Does a limit order placed at this bar fill on the next one?

    ``fill`` needs a touch and a close beyond the limit by ``adverse_bp``; a touch alone
    gives ``expire`` (the fill would be fantasy), no touch gives ``drop``.
    """
    w = seg.window()
    side, limit = F.col("side"), F.col("limit_price")
    low, high, close = (F.lead(c, 1).over(w) for c in ("low", "high", "close"))
    return maker_decision(side, limit, low, high, close, adverse_bp)


def maker_decision(side: Column, limit: Column, low: Column, high: Column, close: Column, adverse_bp: float) -> Column:
    edge = F.lit(adverse_bp / 10_000.0)
    touched = F.when(side > 0, low <= limit).otherwise(high >= limit)
    adverse = F.when(side > 0, close <= limit * (1.0 - edge)).otherwise(close >= limit * (1.0 + edge))
    return (
        F.when(touched.isNull(), "pending")
        .when(~touched, "drop")
        .when(adverse, "fill")
        .otherwise("expire")
    )


# ---- drawdown --------------------------------------------------------------------------------


def drawdown(equity: DataFrame, keys: Sequence[str], order: str, segment: Column) -> DataFrame:
    """Running peak and drawdown (as a fraction of the peak) of an equity column."""
    out = running(equity, keys, order, segment, {"peak": ("max", F.col("equity"))})
    share = F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak"))
    return out.withColumn("drawdown", F.coalesce(share, F.lit(0.0)))


def latched_stop(
    equity: DataFrame, keys: Sequence[str], order: str, segment: Column, stop: float = 0.20
) -> DataFrame:
    """``tripped`` from the first drawdown of ``stop`` on; it never resets."""
    if not 0.0 < stop <= 0.20:
        raise ValueError("the stop may be tighter than 20 %, not looser")
    with_dd = drawdown(equity, keys, order, segment)
    hit = (F.col("drawdown") >= stop).cast("int")
    latched = running(with_dd, keys, order, segment, {"_hit": ("max", hit)})
    return latched.withColumn("tripped", F.coalesce(F.col("_hit") == 1, F.lit(False))).drop("_hit")


# ---- compounding paths --------------------------------------------------------------------------


_GROUP = 4096


def block_of_path(returns: Column) -> Column:
    """Summary of a stretch of percent returns, relative to its start.

    growth   product of (1 + r)
    low      smallest running product
    high     largest running product
    drop     deepest fall below an earlier point of the stretch, as a fraction
    """
    zero = F.struct(
        F.lit(1.0).alias("growth"),
        F.lit(float("inf")).alias("low"),
        F.lit(float("-inf")).alias("high"),
        F.lit(0.0).alias("drop"),
    )

    def step(acc: Column, r: Column) -> Column:
        growth = acc["growth"] * (1.0 + r / 100.0)
        high = F.greatest(acc["high"], growth)
        return F.struct(
            growth.alias("growth"),
            F.least(acc["low"], growth).alias("low"),
            high.alias("high"),
            F.greatest(acc["drop"], F.when(high > 0, 1.0 - growth / high).otherwise(F.lit(0.0))).alias("drop"),
        )

    return F.aggregate(returns, zero, step)


def merge_blocks(blocks: Column) -> Column:
    """Fold summaries of neighbouring stretches, in order, to the summary of all of them."""
    first, rest = F.element_at(blocks, 1), F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def step(a: Column, b: Column) -> Column:
        fall = F.when(a["high"] > 0, 1.0 - a["growth"] * b["low"] / a["high"]).otherwise(F.lit(0.0))
        return F.struct(
            (a["growth"] * b["growth"]).alias("growth"),
            F.least(a["low"], a["growth"] * b["low"]).alias("low"),
            F.greatest(a["high"], a["growth"] * b["high"]).alias("high"),
            F.greatest(a["drop"], b["drop"], fall).alias("drop"),
        )

    return F.aggregate(rest, first, step)


def join_blocks(blocks: Column, start: float) -> Column:
    """Fold block summaries in order to (final equity, deepest drawdown in percent).

    The deepest fall inside a block is either against a peak in the block or against the
    peak before it: ``1 - x / max(a, b)`` is the larger of ``1 - x / a`` and ``1 - x / b``.
    Once equity is gone the path stays at (0, 100).
    """
    zero = F.struct(
        F.lit(float(start)).alias("equity"),
        F.lit(float(start)).alias("peak"),
        F.lit(0.0).alias("drop"),
        F.lit(False).alias("ruined"),
    )

    def step(acc: Column, b: Column) -> Column:
        return F.struct(
            (acc["equity"] * b["growth"]).alias("equity"),
            F.greatest(acc["peak"], acc["equity"] * b["high"]).alias("peak"),
            F.greatest(acc["drop"], b["drop"], 1.0 - acc["equity"] * b["low"] / acc["peak"]).alias("drop"),
            (acc["ruined"] | (b["low"] <= 0)).alias("ruined"),
        )

    def done(acc: Column) -> Column:
        return F.struct(
            F.when(acc["ruined"], F.lit(0.0)).otherwise(acc["equity"]).alias("final_equity"),
            F.when(acc["ruined"], F.lit(100.0)).otherwise(acc["drop"] * 100.0).alias("max_drawdown_pct"),
        )

    return F.aggregate(blocks, zero, step, done)


def path_summary(
    rows: DataFrame, keys: Sequence[str], order: str, value: str, block: Column, start: float = 100.0
) -> DataFrame:
    """Final equity and deepest drawdown of compounding paths, one row per ``keys``.

    ``block`` numbers the stretches of a path in ``order``.  Stretches are folded on their
    own, then groups of stretches, then the groups: no task holds more than one stretch, one
    group, or one summary per group.
    """
    keys = list(keys)
    stretch = rows.groupBy(*keys, block.alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("r")))).alias("_rows")
    )
    blocks = stretch.select(*keys, "_block", block_of_path(F.transform("_rows", lambda x: x["r"])).alias("_sum"))
    group = F.floor(F.col("_block") / F.lit(_GROUP))
    ordered = lambda at: F.transform(F.array_sort(F.collect_list(F.struct(at, "_sum"))), lambda x: x["_sum"])
    groups = blocks.groupBy(*keys, group.alias("_group")).agg(merge_blocks(ordered("_block")).alias("_sum"))
    whole = groups.groupBy(*keys).agg(ordered("_group").alias("_all"))
    return whole.select(*keys, join_blocks(F.col("_all"), start).alias("_path")).select(*keys, "_path.*")


# ---- reports on trades ------------------------------------------------------------------------------


def daily_summary(trades: DataFrame, equity: DataFrame, rows_per_segment: int = 32_768) -> DataFrame:
    """Per strategy and day: trades, win rate, mean results, deepest intraday drawdown.

    Days with equity but no trade, and the other way round, are reported.  The intraday peak
    starts anew each day.
    """
    key = ["strategy_id", "date"]
    t = trades.groupBy(*key).agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg((F.col("post_fee") > 0).cast("double")).alias("win_rate"),
        F.avg("pre_fee").alias("avg_pre_fee"),
        F.avg("post_fee").alias("avg_post_fee"),
    )
    dd = drawdown(equity, key, "seq", F.floor(F.col("seq") / F.lit(rows_per_segment)))
    d = dd.groupBy(*key).agg(F.max("drawdown").alias("intraday_max_dd"))
    both = t.join(d, key, "full_outer")
    zero = F.lit(0.0)
    return both.select(
        *key,
        F.coalesce("trades", F.lit(0).cast("long")).alias("trades"),
        *[F.coalesce(c, zero).alias(c) for c in ("win_rate", "avg_pre_fee", "avg_post_fee", "intraday_max_dd")],
    )


def _ranked_path(trades: DataFrame, value: str, block_rows: int, start: float = 100.0) -> DataFrame:
    """Summary of the path of each strategy.  Stretches are cut by rank, so numbers with gaps, or far apart, make
    no more of them than there are trades for."""
    bucket = F.floor(F.col("trade_seq") / F.lit(100_000))
    ranked = with_row_index(trades.select("strategy_id", "trade_seq", value), ["strategy_id"], ["trade_seq", value], bucket, out="_place")
    return path_summary(ranked, ["strategy_id"], "_place", value, F.floor(F.col("_place") / F.lit(block_rows)), start)


def run_totals(
    trades: DataFrame, value: str = "post_fee_pct", start: float = 100.0, min_trades: int = 300, block_rows: int = 4096
) -> DataFrame:
    """Per strategy: net return and deepest drawdown of the compounding path, with a warning
    where there are too few trades for a verdict."""
    path = _ranked_path(trades, value, block_rows, start)
    n = trades.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("trades"))
    return path.join(n, "strategy_id").select(
        "strategy_id",
        "trades",
        ((F.col("final_equity") / F.lit(start) - 1.0) * 100.0).alias("net_return_pct"),
        "max_drawdown_pct",
        (F.col("trades") < min_trades).alias("too_few_trades"),
    )


def falsification(
    trades: DataFrame,
    horizon: str = "intraday",
    tier: str = "T",
    p: FrictionParams = FrictionParams(),
    pre_fee_floor: float | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """Six criteria per strategy on ``trades(strategy_id, trade_seq, sample, pre_fee_pct,
    post_fee_pct)`` with ``sample`` IS or OOS.

    1 enough trades, 2 out-of-sample Sharpe above 1, 3 out-of-sample net above 0, 4 drawdown
    below 25 %, 5 mean before fees at the floor of the tier, 6 half of the trades win in both
    samples, or gains are 1.25 times the losses.  The Sharpe ratio is mean over deviation per
    trade times the root of the number of trades.
    """
    floor = pre_fee_floor
    if floor is None:
        floor = p.pre_fee_floor_taker if tier == "T" else p.pre_fee_floor_maker
    need = 300 if horizon == "intraday" else 30
    post, oos = F.col("post_fee_pct"), F.col("sample") == "OOS"
    out_post = F.when(oos, post)
    stats = trades.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg("pre_fee_pct").alias("avg_pre_fee"),
        F.avg(out_post).alias("oos_avg_net"),
        (F.avg(out_post) / F.nullif(F.stddev_samp(out_post), F.lit(0.0)) * F.sqrt(F.count(out_post))).alias("oos_sharpe"),
        F.avg(F.when(~oos, (post > 0).cast("double"))).alias("is_win_rate"),
        F.avg(F.when(oos, (post > 0).cast("double"))).alias("oos_win_rate"),
        (F.sum(F.when(post > 0, post).otherwise(0.0)) / F.nullif(-F.sum(F.when(post < 0, post).otherwise(0.0)), F.lit(0.0))).alias("profit_factor"),
    )
    path = _ranked_path(trades, "post_fee_pct", block_rows).select("strategy_id", "max_drawdown_pct")
    no = F.lit(False)
    rows = stats.join(path, "strategy_id").withColumns(
        {
            "c1_trades": F.col("trades") >= need,
            "c2_sharpe": F.coalesce(F.col("oos_sharpe") > 1.0, no),
            "c3_net": F.coalesce(F.col("oos_avg_net") > 0, no),
            "c4_drawdown": F.col("max_drawdown_pct") < 25.0,
            "c5_pre_fee": F.coalesce(F.col("avg_pre_fee") >= floor, no),
            "c6_wins": F.coalesce((F.col("is_win_rate") >= 0.5) & (F.col("oos_win_rate") >= 0.5), no)
            | F.coalesce(F.col("profit_factor") >= 1.25, no),
        }
    )
    passed = F.col("c2_sharpe") & F.col("c3_net") & F.col("c4_drawdown") & F.col("c5_pre_fee") & F.col("c6_wins")
    missing = F.col("oos_avg_net").isNull() | F.col("is_win_rate").isNull()
    return rows.withColumn(
        "verdict",
        F.when(~F.col("c1_trades") | missing, "INCONCLUSIVE").when(passed, "PRELIMINARY_PASS").otherwise("FAIL"),
    )


def final_verdict(preliminary: DataFrame, monte_carlo: DataFrame) -> DataFrame:
    """The Monte Carlo audit decides on what passed the six criteria."""
    mc = monte_carlo.select("strategy_id", F.col("verdict").alias("_mc"))
    joined = preliminary.join(mc, "strategy_id", "left")
    first, audit = F.col("verdict"), F.col("_mc")
    final = F.when(first != "PRELIMINARY_PASS", first).when(audit == "PASS", "FINAL_PASS").when(audit == "FAIL", "FAIL").otherwise(first)
    return joined.withColumn("final_verdict", final).drop("_mc")


