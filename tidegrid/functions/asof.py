"""Backward as-of joins: the latest right row at or before each left row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AsofSide:
    """One right side.  Rows must be unique per (by, ts)."""

    name: str
    df: DataFrame
    ts: str
    values: tuple[str, ...]


def asof_join(
    left: DataFrame,
    sides: Sequence[AsofSide],
    by: Sequence[str],
    left_ts: str,
    bucket_ms: int,
) -> DataFrame:
    """Add one struct column per side, ``<name>`` = (ts, values...), null without a match.

    All sides are matched in one shuffle: the rows of both kinds are put together and cut
    by (by, time bucket), so a single very long series spreads over many tasks.  Within a
    bucket the last right row seen so far wins; a bucket starts from the last right row of
    the buckets before it, which comes from a table with one row per bucket.
    """
    by = list(by)
    names = [s.name for s in sides]
    types = {s.name: s.df.select(F.struct(F.col(s.ts).alias("ts"), *s.values).alias("v")).schema["v"].dataType for s in sides}

    def empty(name: str) -> Column:
        return F.lit(None).cast(types[name]).alias(name)

    mixed = left.select(
        *by,
        F.col(left_ts).alias("_ts"),
        F.lit(len(sides)).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
        *[empty(n) for n in names],
    )
    row_type = mixed.schema["_left"].dataType
    for i, side in enumerate(sides):
        mixed = mixed.unionByName(
            side.df.select(
                *by,
                F.col(side.ts).alias("_ts"),
                F.lit(i).alias("_side"),
                F.lit(None).cast(row_type).alias("_left"),
                *[
                    F.struct(F.col(side.ts).alias("ts"), *side.values).alias(n) if n == side.name else empty(n)
                    for n in names
                ],
            )
        )
    mixed = mixed.withColumn("_bucket", F.floor(F.col("_ts") / F.lit(bucket_ms)))

    tails = mixed.groupBy(*by, "_bucket").agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_ts"))).alias(n) for n in names]
    )
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*by, "_bucket", *[F.last(n, ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in names])

    # Right rows of the same time come first, so they are visible to the left row.
    seen = (
        Window.partitionBy(*by, "_bucket")
        .orderBy("_ts", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = mixed.withColumns({n: F.last(n, ignorenulls=True).over(seen) for n in names})
    return (
        matched.filter(F.col("_left").isNotNull())
        .join(carry, [*by, "_bucket"])
        .select("_left.*", *[F.coalesce(F.col(n), F.col(f"_carry_{n}")).alias(n) for n in names])
    )
