"""Exact quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task.  Here a
mergeable sketch first brackets each wanted position with a known rank error; a second pass
counts what lies below the bracket and looks only at the values inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import cut_lineage


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[str, float]],
    aggs: Sequence[Column] = (),
    accuracy: int = 20_000,
    stored: bool = False,
) -> DataFrame:
    """One row per group: keys, the plain aggregates ``aggs``, and ``{name: (column, p)}``
    as linearly interpolated quantiles, null where a group has no value.

    The input is read twice.  The bracket is eight times as wide as the rank error the
    sketch states; should a position fall outside, the query fails rather than return a
    wrong value.  Keys must not be null.

    With ``stored`` the brackets become a table first.  Their size is then known when the
    second pass is planned: if they are small they travel to the values, which are not
    shuffled at all; if not, both sides are joined by key.
    """
    keys, extra = list(keys), [f"_agg{i}" for i in range(len(aggs))]
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    slack = 8.0 / accuracy

    def sketch(c: str) -> list[Column]:
        x = F.col(c).cast("double")
        marks = [m for col, p in wanted.values() if col == c for m in (max(0.0, p - slack), min(1.0, p + slack))]
        return [
            F.count(x).alias(f"_n_{c}"),
            F.min(x).alias(f"_min_{c}"),
            F.max(x).alias(f"_max_{c}"),
            F.percentile_approx(x, [float(m) for m in marks], accuracy).alias(f"_marks_{c}"),
        ]

    stats = df.groupBy(*keys).agg(F.struct(F.lit(0).alias("_"), *aggs).alias("_agg"), *[s for c in columns for s in sketch(c)])

    def bracket(name: str, c: str, p: float) -> Column:
        at = 2 * [n for n, (col, _) in wanted.items() if col == c].index(name)
        lo = F.col(f"_min_{c}") if p - slack <= 0.0 else F.element_at(f"_marks_{c}", at + 1)
        hi = F.col(f"_max_{c}") if p + slack >= 1.0 else F.element_at(f"_marks_{c}", at + 2)
        return F.struct(
            F.lit(name).alias("name"),
            F.col(f"_n_{c}").alias("n"),
            ((F.col(f"_n_{c}") - 1) * F.lit(float(p))).alias("pos"),
            lo.alias("lo"),
            hi.alias("hi"),
        )

    brackets = stats.select(
        *keys, "_agg", F.explode(F.array(*[bracket(n, c, p) for n, (c, p) in wanted.items()])).alias("_b")
    ).withColumn("_name", F.col("_b.name"))
    values = df.select(
        *keys,
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("_name"), F.col(c).cast("double").alias("_v")) for n, (c, _) in wanted.items()])
        ),
    )
    if stored:
        brackets = cut_lineage(brackets)
    # A skewed group is split by adaptive execution, the brackets being few rows per group.
    # What lies below a bracket, and what is missing, collapses to one counter before the
    # shuffle.
    inside = values.join(brackets, [*keys, "_name"]).filter(F.col("_v").isNull() | (F.col("_v") <= F.col("_b.hi")))
    counted = inside.groupBy(*keys, "_agg", "_b", F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_x")).agg(
        F.count("_v").alias("_c")
    )
    upto = Window.partitionBy(*keys, "_b").orderBy(F.col("_x").asc_nulls_first())
    ranked = counted.withColumn(
        "_end", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).withColumn("_start", F.col("_end") - F.col("_c"))

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_start") <= position) & (position < F.col("_end")), F.col("_x")))

    pos = F.col("_b.pos")
    picked = ranked.groupBy(*keys, "_agg", "_b").agg(at(F.floor(pos)).alias("_lo"), at(F.ceil(pos)).alias("_hi"))
    missed = F.raise_error(F.lit("quantile bracket missed its position")).cast("double")
    lo, hi = F.coalesce("_lo", missed), F.coalesce("_hi", missed)
    q = F.when(F.col("_b.n") > 0, lo + (hi - lo) * (pos - F.floor(pos)))
    out = picked.withColumn("_q", q)
    return (
        out.groupBy(*keys, "_agg")
        .agg(*[F.max(F.when(F.col("_b.name") == n, F.col("_q"))).alias(n) for n in wanted])
        .select(*keys, "_agg.*", *wanted)
        .drop("_")
    )


def exact_medians(
    df: DataFrame, keys: Sequence[str], columns: dict[str, str], aggs: Sequence[Column] = (), stored: bool = False
) -> DataFrame:
    """Medians of several columns, ``{source: name}``, next to plain aggregates."""
    return exact_quantiles(df, keys, {name: (src, 0.5) for src, name in columns.items()}, aggs, stored=stored)
