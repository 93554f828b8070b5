"""Is the mean of a cell stable over time, and is it unlikely at random bars?"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import timeframe_ms
from tidegrid.functions.segments import with_row_index
from tidegrid.operators.leaderboard import CELL
from tidegrid.params import SERIES_KEYS, FrictionParams, SegmentParams, StabilityParams


def net_long(mean: Column, friction: float) -> Column:
    return mean - F.lit(friction)


def net_fade(mean: Column, friction: float) -> Column:
    """The trade in the other direction pays the friction as well."""
    return -mean - F.lit(friction)


def fold_number(rank: Column, n: Column, folds: int) -> Column:
    """Fold (from 0) of the row at ``rank`` (from 0) of ``n``.

    Fold i starts at floor(i * n / folds): the largest such i at or below the rank is
    floor(((rank + 1) * folds - 1) / n), so the last fold takes the remainder.
    """
    return F.floor(((rank + 1) * F.lit(folds) - 1) / n).cast("int")


def walk_forward(
    outcomes: DataFrame,
    p: StabilityParams = StabilityParams(),
    friction: FrictionParams = FrictionParams(),
    segments: SegmentParams = SegmentParams(),
) -> DataFrame:
    """Per cell: means of chronological folds, after taker and maker friction.

    Positions inside a cell come from bucket counts (``with_row_index``), so a cell with very
    many events is spread over many tasks.
    """
    complete = outcomes.select(*CELL, "ts_open_ms", "forward_return_pct").filter(F.col("forward_return_pct").isNotNull())
    bucket = F.floor(F.col("ts_open_ms") / (timeframe_ms("timeframe") * F.lit(segments.rows)))
    ranked = with_row_index(complete, CELL, ["ts_open_ms"], bucket, out="_rank", total="_n")
    fold, fr = fold_number(F.col("_rank"), F.col("_n"), p.folds), F.col("forward_return_pct")
    sums = ranked.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_complete"),
        F.avg(fr).alias("full_mean"),
        *[F.count_if(fold == i).alias(f"_n{i}") for i in range(p.folds)],
        *[F.avg(F.when(fold == i, fr)).alias(f"_m{i}") for i in range(p.folds)],
    )
    # Cells without any complete outcome are reported too.
    cells = outcomes.select(*CELL).distinct().join(sums, [*CELL], "left")
    n = F.coalesce("n_complete", F.lit(0).cast("long"))
    enough = n >= p.min_n
    sides = {"": friction.taker_round_trip, "_maker": friction.maker_round_trip}
    out = {"n_complete": n}
    for side, cost in sides.items():
        full = net_long(F.col("full_mean"), cost)
        nets = [net_long(F.col(f"_m{i}"), cost) for i in range(p.folds)]
        same = sum(((F.signum(x) == F.signum(full)) & (full != 0)).cast("int") for x in nets)
        same = F.when(enough, F.coalesce(same, F.lit(0))).otherwise(F.lit(0))
        out[f"full_net{side}"] = full
        out[f"folds_same_sign{side}"] = same
        out[f"sign_stable{side}"] = same == p.folds
        out |= {f"fold{i + 1}_net{side}": F.when(enough, x) for i, x in enumerate(nets)}
    out |= {f"fold{i + 1}_n": F.when(enough, F.col(f"_n{i}")).otherwise(F.lit(0).cast("long")) for i in range(p.folds)}
    out["verdict"] = (
        F.when(~enough, "INSUFFICIENT_N")
        .when(F.col("full_mean").isNull(), "NO_DATA")
        .when(out["sign_stable"], "STABLE")
        .otherwise("UNSTABLE")
    )
    rows = cells.select(*CELL, "full_mean", *[c.alias(name) for name, c in out.items()])
    return rows


def stable_counts(wf: DataFrame, pm: DataFrame) -> DataFrame:
    """Per series: stable cells and passing cells, with the number of cells."""
    a = wf.groupBy(*SERIES_KEYS).agg(
        F.count_if(F.col("verdict") == "STABLE").alias("stable"), F.count(F.lit(1)).alias("walk_forward_cells")
    )
    b = pm.groupBy(*SERIES_KEYS).agg(
        F.count_if(F.col("verdict") == "PASS").alias("passed"), F.count(F.lit(1)).alias("permutation_cells")
    )
    return a.join(b, [*SERIES_KEYS], "left")


# ---- bootstrap against random bars --------------------------------------------------------

#: Permutations whose sums travel in one array, and draws of each that are made at a time.
_PERM_BLOCK = 50
_PLACES = 16_384
#: Draws that meet the values of one segment in one task.
_DRAW_LIMIT = 8_000_000
#: Returns are summed in whole billionths of a percent, so sums do not depend on their order.
UNIT = 1e-9
_WORD = 0xFFFFFFFF


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words in which every input bit moves every output bit."""
    x = x ^ (x >> 16)
    x = (x * 0x7FEB352D) & _WORD
    x = x ^ (x >> 15)
    x = (x * 0x31848BAB) & _WORD
    return x ^ (x >> 14)


def drawn_positions(key: int, perms: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Positions below ``size`` per permutation and place: functions of these and the cell's key alone."""
    stream = mixed(key ^ mixed(perms.astype(np.int64)))
    word = mixed(stream[:, None] ^ mixed(places.astype(np.int64))[None, :])
    return (word.astype(np.uint64) * np.uint64(size)) >> np.uint64(32)


def _draw(keep: list[str], segment_rows: int):
    """Per piece of work the draws that fall into each segment: which permutation, which place in the segment."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                key, n, size, block, perms, chunk = (row.column(c)[0].as_py() for c in ("_key", "n_complete", "n_universe", "_block", "_perms", "_chunk"))
                places = np.arange(chunk * _PLACES, min(n, (chunk + 1) * _PLACES))
                found = drawn_positions(key, block * _PERM_BLOCK + np.arange(perms), places, size)
                perm = np.broadcast_to(np.arange(perms, dtype="<u2")[:, None], found.shape).reshape(-1)
                found = found.reshape(-1)
                order = np.argsort(found, kind="stable")
                found, perm = found[order], perm[order]
                seg, first = np.unique(found // np.uint64(segment_rows), return_index=True)
                ends = [*first[1:].tolist(), len(found)]
                offset = (found % np.uint64(segment_rows)).astype("<u4")
                same = pa.table([row.column(c) for c in keep], keep).take(pa.array(np.zeros(len(seg), np.int64))).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays(
                    [
                        *same.columns,
                        pa.array(seg.astype(np.int64)),
                        pa.array([perm[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary()),
                        pa.array([offset[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary()),
                    ],
                    [*keep, "_seg", "_perm", "_offset"],
                )

    return of


def _resolve(keep: list[str]):
    """Sums of the drawn values of one segment, an array over the permutations of a block."""

    def run(values: pa.Table, draws: pa.Table) -> pa.Table:
        table = np.zeros(1 + (pa.compute.max(values.column("_at")).as_py() if values.num_rows else 0), np.int64)
        table[np.asarray(values.column("_at"))] = np.asarray(values.column("_value"))
        sums = []
        for perms, perm, offset in zip(*(draws.column(c) for c in ("_perms", "_perm", "_offset")), strict=True):
            who = np.frombuffer(perm.as_buffer(), "<u2")
            picked = table[np.frombuffer(offset.as_buffer(), "<u4")]
            # In two halves, so that adding up stays exact.
            low = np.bincount(who, weights=picked & _WORD, minlength=perms.as_py()).astype(np.int64)
            high = np.bincount(who, weights=picked >> 32, minlength=perms.as_py()).astype(np.int64)
            sums.append((high << 32) + low)
        out = draws.select(keep)
        return out.append_column("_sums", pa.array(sums, pa.list_(pa.int64())))

    return run


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by key into the session's number of partitions.  Little data stands for much
    work here, so partitions must not be merged for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def permutation_test(
    cells: DataFrame,
    universe: DataFrame,
    p: StabilityParams = StabilityParams(),
    friction: FrictionParams = FrictionParams(),
    segments: SegmentParams = SegmentParams(),
) -> DataFrame:
    """p-value of each cell's mean against means of as many random bars of its series.

    ``cells`` has ``n_complete`` and ``full_mean`` per cell (see ``walk_forward``);
    ``universe`` comes from ``outcomes.forward_universe``.

    A draw is a hash of seed, cell, permutation and place, so any task can make any of them and
    results depend neither on segments nor on partitions.  Draws are made in pieces of bounded size and go,
    packed, to the segments that hold their positions; from there come arrays of sums, one number per
    permutation.  Neither the bars nor the draws of a cell are ever gathered.
    """
    horizon_key = [*SERIES_KEYS, "horizon"]
    bucket = F.floor(F.col("bar_idx") / F.lit(segments.rows))
    returns = universe.select(*horizon_key, "bar_idx", "forward_return_pct")
    ranked = with_row_index(returns, horizon_key, ["bar_idx"], bucket, out="_rank")
    totals = returns.groupBy(*horizon_key).agg(F.count(F.lit(1)).alias("n_universe"))
    base = (
        cells.select(*CELL, "n_complete", F.col("full_mean").alias("obs_mean"))
        .join(totals, horizon_key, "left")
        .withColumn("n_universe", F.coalesce("n_universe", F.lit(0).cast("long")))
        .withColumn(
            "_enough",
            (F.col("n_complete") >= p.min_n)
            & (F.col("n_universe") >= F.col("n_complete"))
            & F.col("obs_mean").isNotNull(),
        )
    )
    tested = base.filter("_enough")
    # Where events are dense, several tasks share the draws of a segment and get its values each.
    per_segment = F.sum("n_complete") * F.lit(p.perms) / F.ceil(F.max("n_universe") / F.lit(segments.rows))
    shares = tested.groupBy(*horizon_key).agg(F.ceil(per_segment / F.lit(_DRAW_LIMIT)).cast("int").alias("_shares"))
    text = F.concat_ws("|", F.lit(str(p.seed)), *CELL)
    work = tested.join(shares, horizon_key).select(
        *CELL,
        "n_complete",
        "n_universe",
        "_shares",
        F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").alias("_key"),
        F.explode(F.sequence(F.lit(0), F.lit((p.perms - 1) // _PERM_BLOCK))).alias("_block"),
    )
    work = work.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_complete") - 1) / F.lit(_PLACES)).cast("int"))).alias("_chunk"))
    work = work.withColumns(
        {
            "_perms": F.least(F.lit(_PERM_BLOCK), F.lit(p.perms) - F.col("_block") * F.lit(_PERM_BLOCK)),
            "_share": F.pmod(F.hash("_block", "_chunk"), F.col("_shares")),
        }
    )
    kept = [*CELL, "_block", "_perms", "_share"]
    names = ", ".join(f"{c} string" for c in CELL)
    draws = _spread(work, *CELL, "_block", "_chunk").mapInArrow(
        _draw(kept, segments.rows), f"{names}, _block int, _perms int, _share int, _seg long, _perm binary, _offset binary"
    )
    seg = F.floor(F.col("_rank") / F.lit(segments.rows))
    values = ranked.join(shares, horizon_key).select(
        *horizon_key,
        seg.alias("_seg"),
        F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"),
        (F.col("_rank") - seg * F.lit(segments.rows)).alias("_at"),
        F.floor(F.col("forward_return_pct") / F.lit(UNIT) + F.lit(0.5)).alias("_value"),
    )
    where = [*horizon_key, "_seg", "_share"]
    sums = (
        _spread(values, *where)
        .groupBy(*where)
        .cogroup(_spread(draws, *where).groupBy(*where))
        .applyInArrow(_resolve([*CELL, "_block"]), f"{names}, _block int, _sums array<long>")
    )
    means = sums.select(*CELL, "_block", F.posexplode("_sums").alias("_perm", "_sum")).groupBy(*CELL, "_block", "_perm").agg(F.sum("_sum").alias("_sum"))
    beyond = F.abs(F.col("_sum") * F.lit(UNIT) / F.col("n_complete")) >= F.abs("obs_mean")
    extreme = means.join(tested.select(*CELL, "n_complete", "obs_mean"), [*CELL]).groupBy(*CELL).agg(F.count_if(beyond).alias("_extreme"))
    p_value = (F.coalesce("_extreme", F.lit(0)) + 1) / F.lit(float(p.perms + 1))
    return (
        base.join(extreme, [*CELL], "left")
        .withColumn("p_value", F.when(F.col("_enough"), p_value))
        .select(
            *CELL,
            "n_complete",
            F.lit(p.perms).cast("long").alias("n_perms"),
            "n_universe",
            "obs_mean",
            net_long(F.col("obs_mean"), friction.taker_round_trip).alias("obs_net"),
            net_long(F.col("obs_mean"), friction.maker_round_trip).alias("obs_net_maker"),
            "p_value",
            F.when(~F.col("_enough"), "INSUFFICIENT_N")
            .when(F.col("p_value") <= p.p_pass, "PASS")
            .otherwise("FAIL")
            .alias("verdict"),
        )
    )
