"""Ranking cells and choosing candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalars import horizon_bars
from tidegrid.operators.stability import net_fade, net_long
from tidegrid.params import FrictionParams, SelectionParams, StabilityParams

PAIR_KEYS = ("event_type", "timeframe", "horizon")
_TIES = ("symbol", "timeframe")


def with_net(leaderboard: DataFrame, friction: FrictionParams = FrictionParams()) -> DataFrame:
    return leaderboard.withColumn("net_after_fee", net_long(F.col("mean_forward_return"), friction.taker_round_trip))


def top_by_net(
    leaderboard: DataFrame, k: int = 30, p: SelectionParams = SelectionParams(), friction: FrictionParams = FrictionParams()
) -> DataFrame:
    """The k cells with the largest net in either direction."""
    cells = with_net(leaderboard, friction).filter(F.col("count") >= p.min_n)
    return cells.orderBy(F.abs("net_after_fee").desc(), *_TIES, horizon_bars("horizon"), "event_type").limit(k)


def top_by_sharpe(leaderboard: DataFrame, k: int = 12, p: SelectionParams = SelectionParams()) -> DataFrame:
    cells = with_net(leaderboard).filter((F.col("count") >= p.min_n_ranking) & F.col("sharpe_like").isNotNull())
    return cells.orderBy(F.abs("sharpe_like").desc(), *_TIES, horizon_bars("horizon"), "event_type").limit(k)


def top_by_maker_net(walk_forward: DataFrame, k: int = 20, p: SelectionParams = SelectionParams()) -> DataFrame:
    cells = walk_forward.filter(F.col("n_complete") >= p.min_n)
    order = [F.col("full_net_maker").desc_nulls_last(), F.col("n_complete").desc()]
    return cells.orderBy(*order, *_TIES, horizon_bars("horizon"), "event_type").limit(k)


def top_by_p_value(permutation: DataFrame, k: int = 20, p: SelectionParams = SelectionParams()) -> DataFrame:
    cells = permutation.filter(F.col("n_complete") >= p.min_n)
    order = [F.col("p_value").asc_nulls_last(), F.col("n_complete").desc()]
    return cells.orderBy(*order, *_TIES, horizon_bars("horizon"), "event_type").limit(k)


def _clears(p: SelectionParams, prefix: str) -> Column:
    return F.coalesce(
        (F.col(f"{prefix}_count") >= p.min_n)
        & (F.col(f"{prefix}_net") > 0)
        & (F.col(f"{prefix}_hit") > p.min_hit)
        & (F.col(f"{prefix}_ratio") >= p.min_ratio),
        F.lit(False),
    )


def pair_symbols(
    leaderboard: DataFrame, a: str, b: str, friction: FrictionParams = FrictionParams()
) -> DataFrame:
    """Cells that two symbols have in common, side by side.

    One aggregate over the cells instead of a self-join.
    """
    cells = with_net(leaderboard, friction).filter(F.col("symbol").isin(a, b))
    picks = {
        "count": "count",
        "mean": "mean_forward_return",
        "hit": "hit_rate_at_zero",
        "ratio": "mfe_mae_ratio",
        "net": "net_after_fee",
    }
    sides = [
        F.max(F.when(F.col("symbol") == s, F.col(src))).alias(f"{tag}_{out}")
        for tag, s in (("a", a), ("b", b))
        for out, src in picks.items()
    ]
    paired = cells.groupBy("exchange", *PAIR_KEYS).agg(*sides, F.count_distinct("symbol").alias("_both"))
    return (
        paired.filter(F.col("_both") == 2)
        .drop("_both")
        .withColumn("avg_net", (F.col("a_net") + F.col("b_net")) / 2.0)
        .withColumn("min_net", F.least("a_net", "b_net"))
    )


def pareto(
    leaderboard: DataFrame,
    a: str,
    b: str,
    p: SelectionParams = SelectionParams(),
    friction: FrictionParams = FrictionParams(),
) -> DataFrame:
    """Paired cells with the tests of both symbols, in rank order."""
    one, two = _clears(p, "a"), _clears(p, "b")
    pairs = pair_symbols(leaderboard, a, b, friction).withColumns(
        {"both_pass": one & two, "one_symbol_only": one != two}
    )
    return pairs.orderBy(*pareto_order())


def pareto_order() -> list[Column]:
    return [
        F.col("both_pass").desc(),
        F.col("avg_net").desc_nulls_last(),
        F.col("min_net").desc_nulls_last(),
        *[F.col(k) for k in PAIR_KEYS],
    ]


def pareto_decision(pairs: DataFrame) -> DataFrame:
    """One row: the verdict on the best common cell and on the watch list."""
    best = F.struct(
        F.col("both_pass"),
        F.coalesce("avg_net", F.lit(float("-inf"))),
        F.coalesce("min_net", F.lit(float("-inf"))),
    )
    one = F.struct("both_pass", "a_net", "b_net")
    agg = pairs.agg(
        F.max_by(one, best).alias("_best"),
        F.coalesce(F.bool_or("one_symbol_only"), F.lit(False)).alias("_single"),
        F.count(F.lit(1)).alias("pairs"),
    )
    positive = F.coalesce((F.col("_best.a_net") > 0) | (F.col("_best.b_net") > 0), F.lit(False))
    return agg.select(
        "pairs",
        F.when(F.col("_best.both_pass"), "RESEARCH CANDIDATE")
        .when(F.col("_single") | positive, "WATCHLIST ONLY")
        .otherwise("NO CANDIDATE")
        .alias("decision"),
    )


def research_candidates(
    walk_forward: DataFrame,
    permutation: DataFrame,
    p: SelectionParams = SelectionParams(),
    s: StabilityParams = StabilityParams(),
    friction: FrictionParams = FrictionParams(),
) -> DataFrame:
    """Cells that clear every gate, one row per (cell, tier, direction).

    The cells are read once: each row carries its gates as an array of candidates.
    """
    key = ["exchange", "symbol", "timeframe", "event_type", "horizon"]
    both = walk_forward.join(permutation.select(*key, "p_value"), key)
    tiers = (
        ("T", "sign_stable", friction.taker_round_trip, s.p_pass),
        ("M", "sign_stable_maker", friction.maker_round_trip, s.p_pass_maker),
    )
    mean = F.col("full_mean")
    options = []
    for tier, stable, cost, p_max in tiers:
        gate = (F.col("n_complete") >= p.min_n) & F.col(stable) & (F.col("p_value") <= p_max)
        for direction, net in (("long", net_long(mean, cost)), ("fade", net_fade(mean, cost))):
            row = F.struct(F.lit(tier).alias("tier"), F.lit(direction).alias("direction"), net.alias("net"))
            options.append(F.when(gate & (net > 0), row))
    return both.select(*key, "n_complete", "p_value", F.inline(F.array_compact(F.array(*options))))


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Rank inside each section (tier and direction), best net first."""
    order = Window.partitionBy("tier", "direction").orderBy(
        F.col("net").desc(), F.col("n_complete").desc(), "symbol", "timeframe", "event_type", "horizon"
    )
    return candidates.withColumn("rank", F.row_number().over(order))


def cross_symbol(candidates: DataFrame, a: str, b: str) -> DataFrame:
    """Candidates that hold for both symbols at the same tier and direction."""
    picks = {"n": "n_complete", "net": "net", "p": "p_value"}
    sides = [
        F.max(F.when(F.col("symbol") == s, F.col(src))).alias(f"{tag}_{out}")
        for tag, s in (("a", a), ("b", b))
        for out, src in picks.items()
    ]
    key = ["exchange", "tier", "direction", *PAIR_KEYS]
    both = candidates.filter(F.col("symbol").isin(a, b)).groupBy(*key).agg(*sides, F.count_distinct("symbol").alias("_both"))
    return both.filter(F.col("_both") == 2).drop("_both")
