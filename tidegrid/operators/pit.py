"""Point-in-time audit: which minute had which source, and which five-minute bar is whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import ms_to_iso
from tidegrid.functions.segments import cut, running, with_row_index
from tidegrid.params import MINUTE_MS, SegmentParams

# Dataset names.
KLINES = "um_klines_1m"
PRICE_DATASETS = ("premium_index_klines", "mark_price_klines", "index_price_klines")
FUNDING = "funding_rate_history"
FLAGS = {
    "has_um_klines": KLINES,
    "has_premium_index": "premium_index_klines",
    "has_mark_price": "mark_price_klines",
    "has_index_price": "index_price_klines",
}
FIVE_MINUTES_MS = 5 * MINUTE_MS


def _known_gap(gaps_ms: Sequence[int]) -> Column:
    return F.col("ts_ms").isin(*gaps_ms) if gaps_ms else F.lit(False)


def _presence(times: DataFrame, **more: str) -> DataFrame:
    """``times(dataset_id, symbol, ts_ms)`` to one row per (symbol, minute) with a flag for
    each source: one shuffle, keyed by minute, instead of one join per source."""
    return times.groupBy("symbol", "ts_ms").agg(
        *[F.coalesce(F.bool_or(F.col("dataset_id") == d), F.lit(False)).alias(flag) for flag, d in {**FLAGS, **more}.items()]
    )


def availability(times: DataFrame, funding_times: DataFrame, gaps_ms: Sequence[int] = ()) -> DataFrame:
    """Flags per minute of the kline grid.

    Funding is available from its first time on.  Its times stand among those of the grid as
    marks, and a running maximum carries the mark on, so no row meets another of its symbol
    but those of its segment.
    """
    marks = funding_times.select(F.lit(FUNDING).alias("dataset_id"), "symbol", "ts_ms")
    seen = times.filter(F.col("dataset_id").isin(*FLAGS.values())).select("dataset_id", "symbol", "ts_ms").unionByName(marks)
    present = _presence(seen, has_funding=FUNDING)
    segment = F.floor(F.col("ts_ms") / F.lit(MINUTE_MS * SegmentParams().rows))
    carried = running(present, ["symbol"], "ts_ms", segment, {"_funded": ("max", F.col("has_funding").cast("int"))})
    grid = carried.filter("has_um_klines")
    whole = F.col("has_um_klines") & F.col("has_premium_index") & F.col("has_mark_price") & F.col("has_index_price")
    gap = _known_gap(gaps_ms)
    return grid.select(
        "ts_ms",
        ms_to_iso("ts_ms").alias("timestamp_utc"),
        "symbol",
        *FLAGS,
        whole.alias("has_all_price_state"),
        (F.col("_funded") == 1).alias("funding_available_after_timestamp"),
        gap.alias("known_gap_timestamp"),
        (~whole | gap).alias("no_signal_required"),
        F.when(gap, "known_gap_no_fill_no_signal").otherwise(F.lit("")).alias("notes"),
    )


def five_minute_dependency(flags: DataFrame) -> DataFrame:
    """Per five-minute bar: minutes available from each source; whole only with five of each."""
    counts = {
        "available_1m_rows_um_klines": "has_um_klines",
        "available_1m_rows_premium": "has_premium_index",
        "available_1m_rows_mark": "has_mark_price",
        "available_1m_rows_index": "has_index_price",
    }
    bucket = F.col("ts_ms") - F.col("ts_ms") % F.lit(FIVE_MINUTES_MS)
    bars = flags.groupBy("symbol", bucket.alias("bar_5m_ms")).agg(
        *[F.count_if(F.col(flag)).alias(name) for name, flag in counts.items()]
    )
    whole = F.least(*counts) == 5
    return bars.select(
        "bar_5m_ms",
        ms_to_iso("bar_5m_ms").alias("bar_5m_timestamp_utc"),
        "symbol",
        F.lit(5).alias("required_1m_rows"),
        *counts,
        whole.alias("complete_for_price_state_features"),
        (~whole).alias("no_signal_required"),
        F.when(whole, "complete").otherwise("no_signal_required_due_incomplete_1m_source").alias("notes"),
    )


def price_alignment(times: DataFrame, gaps_ms: Sequence[int] = ()) -> DataFrame:
    """Per price source and symbol: minutes missing against the klines, minutes the klines do
    not have, and failures, which leave out known gaps."""
    flags = _presence(times.filter(F.col("dataset_id").isin(*FLAGS.values())))
    has_grid, gap = F.col("has_um_klines"), _known_gap(gaps_ms)
    sources = [
        F.struct(F.lit(d).alias("dataset_id"), F.col(flag).alias("has_source"))
        for flag, d in FLAGS.items()
        if d != KLINES
    ]
    long = flags.select("symbol", "ts_ms", "has_um_klines", F.inline(F.array(*sources)))
    missing, extra = has_grid & ~F.col("has_source"), ~has_grid & F.col("has_source")
    return long.groupBy("dataset_id", "symbol").agg(
        F.count_if(has_grid).alias("rows_checked"),
        F.count_if(missing).alias("missing_vs_grid"),
        F.count_if(missing & gap).alias("expected_missing"),
        F.count_if(extra).alias("unexpected_extra"),
        (F.count_if(missing & ~gap) + F.count_if(extra)).alias("failures"),
    )


def alignment_errors(times: DataFrame, gaps_ms: Sequence[int] = ()) -> DataFrame:
    """The minutes behind the failures of ``price_alignment``."""
    flags = _presence(times.filter(F.col("dataset_id").isin(*FLAGS.values())))
    sources = [
        F.struct(F.lit(d).alias("dataset_id"), F.col(flag).alias("has_source"))
        for flag, d in FLAGS.items()
        if d != KLINES
    ]
    long = flags.select("symbol", "ts_ms", "has_um_klines", F.inline(F.array(*sources)))
    kind = F.when(
        F.col("has_um_klines") & ~F.col("has_source") & ~_known_gap(gaps_ms), "UNEXPECTED_MISSING_PRICE_STATE"
    ).when(~F.col("has_um_klines") & F.col("has_source"), "PRICE_STATE_EXTRA_TIMESTAMP")
    return (
        long.withColumn("error_type", kind)
        .filter(F.col("error_type").isNotNull())
        .select(
            F.lit("PIT_PRICE_ALIGNMENT").alias("check_id"),
            "dataset_id",
            "symbol",
            ms_to_iso("ts_ms").alias("timestamp_utc"),
            "error_type",
        )
    )


# ---- row checks -----------------------------------------------------------------------------

# Check and error names, in order.
_CHECKS = (
    ("PIT_SYMBOL", "SYMBOL_MISMATCH", "_symbol_bad"),
    ("PIT_COMPLETED_1M_BAR", "CLOSE_TIME_FAIL", "_close_bad"),
    ("PIT_SOURCE_TIMESTAMP", "OPEN_ALIGNMENT_FAIL", "_align_bad"),
    ("PIT_DUPLICATE", "DUPLICATE_TIMESTAMP", "_copy_bad"),
    ("PIT_MONOTONIC", "NON_MONOTONIC", "_order_bad"),
)


def row_checks(
    rows: DataFrame, physical: Sequence[str], bucket: Column, segments: SegmentParams = SegmentParams()
) -> DataFrame:
    """One row per stored row with the array ``failed`` of failed checks.

    ``rows(dataset_id, symbol, row_symbol, open_ms, close_ms, parsed)``: ``symbol`` is the
    folder's, ``row_symbol`` what the row says; funding rows have no ``close_ms``.  A row can
    fail several checks, each counts.  Where a column ``bad_file`` is true, the row stands for a
    file that lacks columns: one failure, and no row that was checked.
    """
    series = ["dataset_id", "symbol"]
    funding = F.col("dataset_id") == FUNDING
    bad_file = F.coalesce(F.col("bad_file"), F.lit(False)) if "bad_file" in rows.columns else F.lit(False)

    def failure(check: str, error: str) -> Column:
        return F.struct(F.lit(check).alias("check_id"), F.lit(error).alias("error_type"))

    unparsed = rows.filter(~F.col("parsed")).select(
        *series,
        "open_ms",
        F.array(
            F.when(bad_file & funding, failure("PIT_SCHEMA_FUNDING", "SCHEMA_FAIL"))
            .when(bad_file, failure("PIT_SCHEMA_BAR", "SCHEMA_FAIL"))
            .when(funding, failure("PIT_FUNDING_TIMESTAMP", "FUNDING_PARSE_FAIL"))
            .otherwise(failure("PIT_SOURCE_TIMESTAMP", "TIMESTAMP_PARSE_FAIL"))
        ).alias("failed"),
    )
    good = with_row_index(rows.filter("parsed"), series, list(physical), bucket, out="_at")
    # First position of every time: an aggregate, so that a time with very many copies
    # collapses before the shuffle.
    firsts = good.groupBy(*series, "open_ms").agg(F.min("_at").alias("_first"))
    seg = cut(good.join(firsts, [*series, "open_ms"]), series, "_at", segments.rows, before=1, idx="_at")
    prev = F.lag("open_ms").over(seg.window())
    marks = {
        "_symbol_bad": F.col("row_symbol") != F.col("symbol"),
        "_close_bad": ~funding & (F.col("close_ms") != F.col("open_ms") + F.lit(MINUTE_MS - 1)),
        "_align_bad": ~funding & (F.col("open_ms") % MINUTE_MS != 0),
        "_copy_bad": F.col("_at") > F.col("_first"),
        "_order_bad": F.col("open_ms") <= prev,
    }
    failed = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(F.col(m), F.lit(False)), F.struct(F.lit(c).alias("check_id"), F.lit(e).alias("error_type")))
                for c, e, m in _CHECKS
            ]
        )
    )
    checked = seg.with_columns(marks).with_columns({"failed": failed}).owned()
    return checked.select(*series, "open_ms", "failed").unionByName(unparsed)


def row_errors(checked: DataFrame) -> DataFrame:
    return checked.select("dataset_id", "symbol", ms_to_iso("open_ms").alias("timestamp_utc"), F.inline("failed"))


def source_summary(checked: DataFrame) -> DataFrame:
    """Rows, failures and extent per dataset and symbol; a file that could not be read is a failure, not a row."""
    read = ~F.exists("failed", lambda f: f["error_type"] == "SCHEMA_FAIL")
    return checked.groupBy("dataset_id", "symbol").agg(
        F.count_if(read).alias("rows_checked"),
        F.sum(F.size("failed")).alias("failures"),
        F.min("open_ms").alias("min_ms"),
        F.max("open_ms").alias("max_ms"),
    )


def check_summary(
    checked: DataFrame,
    times: DataFrame,
    flags: DataFrame,
    bars: DataFrame,
    gaps_ms: Sequence[int] = (),
    expected_gaps: bool = False,
) -> DataFrame:
    """PASS or FAIL per check, dataset and symbol.

    With ``expected_gaps`` the audit also demands that the known gaps are there: every known
    gap is flagged and at least one five-minute bar is incomplete.
    """
    source = source_summary(checked)
    good = F.col("failures") == 0

    def rows(df: DataFrame, check: str, dataset: Column, rows_checked: Column, failures: Column, passed: Column) -> DataFrame:
        return df.select(
            F.lit(check).alias("check_id"),
            dataset.alias("dataset_id"),
            "symbol",
            F.when(passed, "PASS").otherwise("FAIL").alias("status"),
            rows_checked.cast("long").alias("rows_checked"),
            failures.cast("long").alias("failures"),
        )

    is_bar, dataset = F.col("dataset_id") != FUNDING, F.col("dataset_id")
    n, bad = F.col("rows_checked"), F.col("failures")
    out = rows(source.filter(is_bar), "PIT_SOURCE_TIMESTAMP", dataset, n, bad, good)
    out = out.unionByName(rows(source.filter(is_bar), "PIT_COMPLETED_1M_BAR", dataset, n, bad, good))
    out = out.unionByName(rows(source.filter(~is_bar), "PIT_FUNDING_TIMESTAMP", dataset, n, bad, good))
    out = out.unionByName(
        rows(source.filter(~is_bar), "PIT_NO_FINAL_FUNDING_BEFORE_TS", dataset, n, F.lit(0), F.lit(True))
    )
    aligned = price_alignment(times, gaps_ms)
    out = out.unionByName(rows(aligned, "PIT_PRICE_ALIGNMENT", dataset, n, bad, good))

    wanted = F.lit(len(gaps_ms) if expected_gaps else 0)
    per_symbol = flags.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("known_gap_timestamp").alias("gap_flags"),
        F.count_if("no_signal_required").alias("no_signal"),
    )
    short = wanted - F.col("gap_flags")
    flagged = F.col("gap_flags") == wanted if expected_gaps else F.lit(True)
    price = F.lit("price_state")
    out = out.unionByName(
        rows(per_symbol, "PIT_KNOWN_GAP_FLAGS", price, wanted, F.when(flagged, F.lit(0)).otherwise(short), flagged)
    )
    enough = F.col("no_signal") >= wanted
    out = out.unionByName(
        rows(per_symbol, "PIT_AVAILABILITY_TABLE", price, F.col("rows"), (~enough).cast("int"), enough)
    )
    per_bar = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("no_signal_required").alias("no_signal")
    )
    seen = F.col("no_signal") >= 1 if expected_gaps else F.lit(True)
    return out.unionByName(rows(per_bar, "PIT_5M_DEPENDENCY", price, F.col("rows"), (~seen).cast("int"), seen))
