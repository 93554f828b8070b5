"""Cutting long series into segments.

One series may hold a third of all rows, so ``Window.partitionBy(series)`` would put a third
of the data into one task.  The helpers here replace it:

* ``with_row_index`` numbers the rows of a series exactly, without a task that sees more than
  one bucket of it;
* ``cut`` sends each row to the segment that owns it and, where a neighbour segment looks
  back or ahead, to that one too.  Frames counted in rows then run per (series, segment) and
  give the same values as over the whole series;
* ``running`` computes prefix aggregates (running maximum, running sum) in two levels.

What does travel per series is one summary row per bucket or segment: thousands of times
fewer rows than the series has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalars import timeframe_ms

_SEG = "_seg"


def time_bucket(rows: int, ts: str = "ts_open_ms", timeframe: str = "timeframe") -> Column:
    """Bucket of about ``rows`` grid positions of a bar series."""
    return F.floor(F.col(ts) / (timeframe_ms(timeframe) * F.lit(rows)))


def with_row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    out: str = "bar_idx",
    total: str | None = None,
) -> DataFrame:
    """Add the position (from 0) of each row in its series.

    ``bucket`` must grow with ``order`` and hold few enough rows for one task.  Rows are
    numbered inside buckets; the bucket counts, one row each, give the offsets.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = tagged.withColumn("_rn", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_rn") + F.col("_offset"))
        .drop("_bucket", "_rn", "_offset")
    )


@dataclass(frozen=True)
class Segments:
    """Rows spread over segments of their series; some are copies for neighbours."""

    df: DataFrame
    keys: tuple[str, ...]
    order: str
    idx: str
    rows: int
    # Window objects made so far; building one takes several calls into the JVM.
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    def window(self):
        if None not in self._made:
            self._made[None] = Window.partitionBy(*self.keys, _SEG).orderBy(self.order)
        return self._made[None]

    def frame(self, first: int, last: int):
        if (first, last) not in self._made:
            self._made[first, last] = self.window().rowsBetween(first, last)
        return self._made[first, last]

    def over(self, first: int | None = None, last: int = 0) -> str:
        """The window, or a frame of it, as SQL text."""
        side = lambda n: "CURRENT ROW" if n == 0 else f"{abs(n)} {'FOLLOWING' if n > 0 else 'PRECEDING'}"
        frame = "" if first is None else f" ROWS BETWEEN {side(first)} AND {side(last)}"
        return f"OVER (PARTITION BY {', '.join([*self.keys, _SEG])} ORDER BY {self.order}{frame})"

    def having(self, df: DataFrame) -> "Segments":
        return replace(self, df=df)

    def with_columns(self, columns: dict[str, Column]) -> "Segments":
        return replace(self, df=self.df.withColumns(columns))

    def group(self):
        return self.df.groupBy(*self.keys, _SEG)

    def owned(self) -> DataFrame:
        """Drop the copies."""
        return self.df.filter(F.col(_SEG) == F.floor(F.col(self.idx) / F.lit(self.rows))).drop(_SEG)


def cut(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    rows: int,
    before: Column | int = 0,
    after: Column | int = 0,
    idx: str = "bar_idx",
) -> Segments:
    """Send each row to its own segment and to those that look at it.

    ``before`` and ``after`` say how many rows back and ahead any later expression looks;
    they may depend on the row (for example on its timeframe).
    """
    before = F.lit(before) if isinstance(before, int) else before
    after = F.lit(after) if isinstance(after, int) else after
    first = F.greatest(F.floor((F.col(idx) - after) / F.lit(rows)), F.lit(0))
    last = F.floor((F.col(idx) + before) / F.lit(rows))
    return Segments(
        df=df.withColumn(_SEG, F.explode(F.sequence(first, last))),
        keys=tuple(keys),
        order=order,
        idx=idx,
        rows=rows,
    )


def ensure_index(bars: DataFrame, keys: Sequence[str], rows: int, ts: str = "ts_open_ms") -> DataFrame:
    """Bars with ``bar_idx``; numbered here unless the stored table already has it."""
    if "bar_idx" in bars.columns:
        return bars
    return with_row_index(bars, keys, [ts], time_bucket(rows, ts))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    segment: Column,
    columns: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Prefix aggregates per series: ``{name: ("max" | "min" | "sum", value)}``.

    Each segment is scanned on its own; the totals of earlier segments, one row per segment,
    are carried in.
    """
    keys = list(keys)
    agg = {"max": F.max, "min": F.min, "sum": F.sum}
    fold = {
        "max": lambda a, b: F.greatest(a, b),
        "min": lambda a, b: F.least(a, b),
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    }
    tagged = df.withColumns({"_segment": segment, **{f"_v_{n}": v for n, (_, v) in columns.items()}})
    totals = tagged.groupBy(*keys, "_segment").agg(
        *[agg[how](f"_v_{n}").alias(f"_t_{n}") for n, (how, _) in columns.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_segment", *[agg[how](f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (how, _) in columns.items()]
    )
    inside = (
        Window.partitionBy(*keys, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scanned = tagged.withColumns({f"_s_{n}": agg[how](f"_v_{n}").over(inside) for n, (how, _) in columns.items()})
    joined = scanned.join(carried, [*keys, "_segment"])
    out = joined.withColumns({n: fold[how](F.col(f"_s_{n}"), F.col(f"_c_{n}")) for n, (how, _) in columns.items()})
    return out.drop("_segment", *[f"_{p}_{n}" for n in columns for p in "vsc"])
