"""Monte Carlo paths over per-trade returns (percent, after fees)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.stability import mixed
from tidegrid.operators.trades import path_summary

# Accepted names of the return column, first match wins.
RETURN_COLUMNS = ("pnl_pct", "return_pct", "pnl_percent", "profit_pct", "net_return_pct")

def trade_returns(trades: DataFrame, keys: tuple[str, ...] = ("strategy_id", "trade_seq")) -> DataFrame:
    """Pick the return column and drop blank rows; an unknown layout is an error, a return
    is never made up from other columns."""
    chosen = next((c for c in RETURN_COLUMNS if c in trades.columns), None)
    if chosen is None:
        raise ValueError(f"no return column among {trades.columns}; expected one of {', '.join(RETURN_COLUMNS)}")
    text = F.trim(F.col(chosen).cast("string"))
    return trades.filter(text.isNotNull() & (text != "")).select(*keys, text.cast("double").alias("pnl_pct"))


def _hash(seed: int, *cols: Column) -> Column:
    """A number below 16^15: the first hex digits of the MD5 of the seed and the columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


_ROUNDS = 4


def reordered(key: int, places: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` trades stands at each place: a bijection that depends on the key alone.

    A Feistel network over a rectangle that just holds ``n``; what falls outside goes through it
    again until it is inside, so any place is found without the others.
    """
    width = int(np.ceil(np.sqrt(n)))
    height = -(-n // width)
    out = places.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] % width, out[todo] // width
        for k in range(1, _ROUNDS + 1):
            size = width if k % 2 else height
            left, right = right, (left + mixed(key ^ mixed(right * 4 + k))) % size
        out[todo] = width * right + left
        todo = todo[out[todo] >= n]
    return out


def _reorder(block: int):
    """Places of stretches, with the trade at each."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, (n, stretch, sim, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_n", "_stretch", "sim", "_key")), strict=True)):
            places = np.arange(stretch * block, min(n, (stretch + 1) * block))
            yield i, places, reordered(int(mixed(np.array([key ^ int(mixed(np.array([sim]))[0])]))[0]), places, n)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(batch: pa.RecordBatch, parts: list) -> pa.RecordBatch:
            take = pa.array(np.concatenate([np.full(len(p), i) for i, p, _ in parts]))
            same = [batch.column(c).take(take) for c in ("strategy_id", "sim", "_stretch")]
            numbers = [pa.array(np.concatenate([x[k] for x in parts])) for k in (1, 2)]
            return pa.RecordBatch.from_arrays([*same, *numbers], ["strategy_id", "sim", "_stretch", "_order", "_idx"])

        for batch in batches:
            parts, held = [], 0
            for part in rows(batch):
                parts.append(part)
                held += len(part[1])
                if held > 1 << 18:
                    yield packed(batch, parts)
                    parts, held = [], 0
            if parts:
                yield packed(batch, parts)

    return of


def _paths(indexed: DataFrame, sims: int, mode: str, seed: int, start: float, block: int) -> DataFrame:
    """Paths are cut into stretches of places, the trade at each place is computed and joined in, and only
    stretch summaries meet.  ``indexed`` has ``_idx`` and ``_n`` per trade."""
    who = F.col("strategy_id").cast("string").alias("strategy_id")
    counts = indexed.groupBy("strategy_id").agg(F.first("_n").alias("_n"))
    stretches = counts.select(
        who, "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / F.lit(block)))).alias("_stretch")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim"))
    if mode == "shuffle":
        text = F.concat_ws("|", F.lit(str(seed)), F.col("strategy_id"))
        keyed = stretches.withColumn("_key", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))
        parts = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = keyed.repartition(parts, "strategy_id", "sim", "_stretch")
        placed = spread.mapInArrow(_reorder(block), "strategy_id string, sim int, _stretch long, _order long, _idx long")
    else:
        last = F.least((F.col("_stretch") + 1) * F.lit(block), F.col("_n")) - 1
        places = stretches.select("*", F.explode(F.sequence(F.col("_stretch") * F.lit(block), last)).alias("_order"))
        drawn = F.pmod(_hash(seed, F.col("strategy_id"), F.col("sim"), F.col("_order")), F.col("_n"))
        placed = places.select("strategy_id", "sim", "_stretch", "_order", drawn.alias("_idx"))
    rows = placed.join(indexed.select(who, "_idx", "pnl_pct"), ["strategy_id", "_idx"])
    return path_summary(rows, ["strategy_id", "sim"], "_order", "pnl_pct", F.col("_stretch"), start).select(
        "strategy_id", F.col("sim").cast("long").alias("sim"), "final_equity", "max_drawdown_pct"
    )


def simulate_equity(
    trades: DataFrame,
    sims: int = 1000,
    mode: str = "bootstrap",
    seed: int = 17,
    start: float = 200.0,
    block: int = 4096,
) -> DataFrame:
    """Final equity and deepest drawdown of each (strategy, simulation).

    ``trades(strategy_id, trade_seq, pnl_pct)``.  Bootstrap draws with replacement: every draw is
    a hash of seed, strategy, simulation and place.  Shuffle reorders by a keyed bijection, nothing is
    sorted.  So results depend neither on partitioning nor on ``block``, the length of the stretches
    that are folded alone.
    """
    if mode not in ("bootstrap", "shuffle"):
        raise ValueError(f"unknown mode {mode}")
    from tidegrid.functions.segments import with_row_index

    base = trades.select("strategy_id", "trade_seq", "pnl_pct")
    bucket = F.floor(F.col("trade_seq") / F.lit(100_000))
    indexed = with_row_index(base, ["strategy_id"], ["trade_seq"], bucket, out="_idx", total="_n")
    return _paths(indexed, sims, mode, seed, start, block)


def monte_carlo_summary(
    paths: DataFrame,
    trade_counts: DataFrame,
    start: float = 200.0,
    min_trades: int = 300,
    max_drawdown_pct: float = 25.0,
    max_loss_pct: float = 5.0,
) -> DataFrame:
    """Percentiles of the paths, the four conditions, and PASS, FAIL or INCONCLUSIVE.

    A group holds one row per simulation, a number the caller sets, so the built-in exact
    percentile is in its place here.
    """
    final, drop = F.col("final_equity"), F.col("max_drawdown_pct")
    s = paths.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("simulations"),
        F.percentile(final, 0.05).alias("p5_final_equity"),
        F.percentile(final, 0.5).alias("median_final_equity"),
        F.percentile(final, 0.95).alias("p95_final_equity"),
        F.percentile(drop, 0.5).alias("median_max_drawdown_pct"),
        F.percentile(drop, 0.95).alias("p95_max_drawdown_pct"),
        (F.avg((final < start).cast("double")) * 100.0).alias("prob_final_below_start"),
    )
    s = s.join(trade_counts.select("strategy_id", "trades"), "strategy_id").withColumns(
        {
            "cond_final_p5_gt_start": F.col("p5_final_equity") > start,
            "cond_dd_p95_lt_max": F.col("p95_max_drawdown_pct") < max_drawdown_pct,
            "cond_prob_loss_lt_max": F.col("prob_final_below_start") < max_loss_pct,
            "cond_trade_count_ok": F.col("trades") >= min_trades,
        }
    )
    good = F.col("cond_final_p5_gt_start") & F.col("cond_dd_p95_lt_max") & F.col("cond_prob_loss_lt_max")
    return s.withColumn(
        "verdict", F.when(~F.col("cond_trade_count_ok"), "INCONCLUSIVE").when(good, "PASS").otherwise("FAIL")
    )
