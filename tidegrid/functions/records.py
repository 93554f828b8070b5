"""Counting CSV records where quoted cells may hold line breaks.

Whether a line break ends a record depends on every quote before it, back to the start of the
file.  What a line does to that question is a function of two states (outside or inside a
quoted cell), so lines, and blocks of lines, compose: each block of a file is scanned on its
own, and one row per block is composed per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Where a scan may stand: at the start of a cell, inside a plain one, inside a quoted one, behind a quote in a quoted one.
_START, _PLAIN, _QUOTED, _CLOSING = range(4)


def _over_text(state: Column, text: Column) -> Column:
    """State after text without quotes."""
    moved = F.when(F.endswith(text, F.lit(",")), _START).otherwise(_PLAIN)
    return F.when((text == "") | (state == _QUOTED), state).otherwise(moved)


def _over_quote(state: Column) -> Column:
    return (
        F.when(state == _START, _QUOTED).when(state == _QUOTED, _CLOSING).when(state == _CLOSING, _QUOTED).otherwise(_PLAIN)
    )


def stays_open(line: Column, inside: bool) -> Column:
    """Is the end of the line inside a quoted cell, if its start is ``inside`` one?

    A quote opens a cell only at its start, two of them in a quoted cell are one, and text
    behind a closing quote is plain.
    """
    pieces = F.split(line, '"', -1)
    start = _over_text(F.lit(_QUOTED if inside else _START), F.element_at(pieces, 1))
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    end = F.aggregate(rest, start, lambda state, text: _over_text(_over_quote(state), text))
    # Lines without a quote, nearly all, need no fold.
    return F.when(F.contains(line, F.lit('"')), end == _QUOTED).otherwise(F.lit(inside))


def count_records(lines: DataFrame, file: str, block: str, row: str, line: str = "value", out: str = "records") -> DataFrame:
    """Records per file from ``lines`` in (block, row) order; blank lines are records, too.

    A record that the file ends inside of counts.  Null lines count as empty ones.
    """
    text = F.coalesce(F.col(line), F.lit(""))
    steps = lines.select(file, block, row, stays_open(text, False).alias("_a"), stays_open(text, True).alias("_b"))
    # A line either forgets what was before it, or keeps it, or turns it round.
    fixed, turns = F.col("_a") == F.col("_b"), F.col("_a") & ~F.col("_b")
    order = Window.partitionBy(file, block).orderBy(row)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    odd = (F.sum(turns.cast("int")).over(so_far) % 2).cast("boolean")
    known = steps.withColumn("_odd", odd)
    known = known.withColumn("_at", F.last(F.when(fixed, F.col("_a") != F.col("_odd")), ignorenulls=True).over(so_far))

    def open_after(before: bool) -> Column:
        return F.coalesce("_at", F.lit(before)) != F.col("_odd")

    blocks = known.groupBy(file, block).agg(
        *[F.count_if(~open_after(v)).alias(f"_n{int(v)}") for v in (False, True)],
        *[F.max_by(open_after(v), row).alias(f"_o{int(v)}") for v in (False, True)],
    )
    part = F.struct(F.col(block).alias("at"), F.col("_n0").alias("n0"), F.col("_n1").alias("n1"), F.col("_o0").alias("o0"), F.col("_o1").alias("o1"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("inside"))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(
            (acc["n"] + F.when(acc["inside"], b["n1"]).otherwise(b["n0"])).alias("n"),
            F.when(acc["inside"], b["o1"]).otherwise(b["o0"]).alias("inside"),
        )

    total = blocks.groupBy(file).agg(F.array_sort(F.collect_list(part)).alias("_blocks"))
    return total.select(file, F.aggregate("_blocks", zero, step, lambda acc: acc["n"] + acc["inside"].cast("long")).alias(out))
