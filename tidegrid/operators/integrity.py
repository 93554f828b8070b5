"""Integrity of stored files, repair of known gaps, and the manifest that records both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import month_start_ms
from tidegrid.operators.quality import monotonic
from tidegrid.params import MINUTE_MS, SegmentParams

MANIFEST_COLUMNS = (
    "dataset_id",
    "symbol",
    "source_type",
    "source_url",
    "local_path",
    "start_timestamp_utc",
    "end_timestamp_utc",
    "row_count",
    "expected_interval",
    "schema_version",
    "observed_schema_fields",
    "status",
    "notes",
)


def integrity_status(rows: Column, duplicates: Column, in_order: Column, missing: Column) -> Column:
    ok = (rows > 0) & (duplicates == 0) & in_order & (missing == 0)
    return F.when(ok, "OK").otherwise("INTEGRITY_FAIL")


def file_integrity(
    rows: DataFrame,
    by: Sequence[str],
    ts: str,
    interval_ms: int | Column,
    physical: Sequence[str],
    bucket: Column,
    schemas: DataFrame | None = None,
    segments: SegmentParams = SegmentParams(),
) -> DataFrame:
    """Rows, expected, missing and duplicate rows and strict order of each file.

    ``by`` names the file (path and, if wanted, dataset and symbol).  ``schemas`` may hold
    ``(by..., schema_ok, observed_schema_fields)``; files with another header are reported as
    SCHEMA_FAIL with no counts, files that are listed but empty as INTEGRITY_FAIL.
    """
    by = list(by)
    interval = F.lit(interval_ms) if isinstance(interval_ms, int) else interval_ms
    copies = rows.groupBy(*by, ts).agg(F.count(F.lit(1)).alias("_copies"), F.first(interval).alias("_interval"))
    counts = copies.groupBy(*by).agg(
        F.sum("_copies").alias("row_count"),
        F.count(F.lit(1)).alias("_distinct"),
        F.min(ts).alias("start_ms"),
        F.max(ts).alias("end_ms"),
        F.first("_interval").alias("_interval"),
    )
    order = monotonic(rows, by, ts, physical, bucket, strict=True, segments=segments)
    stats = counts.join(order, by).withColumn(
        "expected_rows", F.floor((F.col("end_ms") - F.col("start_ms")) / F.col("_interval")) + 1
    )
    stats = stats.withColumn("missing_rows", F.greatest(F.col("expected_rows") - F.col("_distinct"), F.lit(0)))
    stats = stats.withColumn("duplicate_rows", F.col("row_count") - F.col("_distinct")).drop("_distinct", "_interval")
    status = integrity_status(
        F.col("row_count"), F.col("duplicate_rows"), F.col("timestamp_monotonic"), F.col("missing_rows")
    )
    if schemas is None:
        return stats.withColumn("status", status)
    zero = F.lit(0).cast("long")
    bad = ~F.col("schema_ok")
    full = schemas.join(stats, by, "left")
    return full.select(
        *by,
        *[F.when(bad, zero).otherwise(F.coalesce(c, zero)).alias(c) for c in ("row_count", "expected_rows", "missing_rows", "duplicate_rows")],
        *[F.when(~bad, F.col(c)).alias(c) for c in ("start_ms", "end_ms")],
        # An empty file is in order, one that cannot be read is not.
        F.when(bad, F.lit(False)).otherwise(F.coalesce("timestamp_monotonic", F.lit(True))).alias("timestamp_monotonic"),
        F.when(bad, "SCHEMA_FAIL").when(F.col("row_count").isNull(), "INTEGRITY_FAIL").otherwise(status).alias("status"),
        F.when(bad, F.concat(F.lit("observed_fields="), "observed_schema_fields")).otherwise(F.lit("")).alias("notes"),
    )


def manifest_rollup(manifest: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: files, errors, files that are not OK, and the overall status."""
    a = manifest.agg(
        F.count(F.lit(1)).alias("manifest_rows"),
        F.count_if(F.coalesce(F.col("status") != "OK", F.lit(True))).alias("non_ok_manifest_rows"),
        F.lit(0).cast("long").alias("error_rows"),
    )
    b = errors.agg(
        F.lit(0).cast("long").alias("manifest_rows"),
        F.lit(0).cast("long").alias("non_ok_manifest_rows"),
        F.count(F.lit(1)).alias("error_rows"),
    )
    total = a.unionByName(b).agg(*[F.sum(c).alias(c) for c in a.columns])
    clean = (F.col("non_ok_manifest_rows") == 0) & (F.col("error_rows") == 0)
    return total.withColumn("status", F.when(clean, "PASS").otherwise("PARTIAL_OR_FAILED"))


# ---- gap repair ---------------------------------------------------------------------------


def _last_returned(recovered: DataFrame, targets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per wanted time the last returned row, as ``_row``."""
    rest = [c for c in recovered.columns if c not in key]
    order = F.col("payload_order") if "payload_order" in rest else F.struct(*rest)
    wanted = recovered.join(targets.select(*key).distinct(), list(key), "left_semi")
    return wanted.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))


def gap_targets(
    series: DataFrame,
    recovered: DataFrame,
    targets: DataFrame,
    by: Sequence[str],
    ts: str,
    bad_schema: DataFrame | None = None,
    usable: str | None = None,
) -> DataFrame:
    """Per wanted time: ALREADY_PRESENT, SCHEMA_FAIL, NOT_RETURNED, VALIDATION_FAIL or RECOVERED.

    ``bad_schema`` lists the series whose recovery payload has rows of another width; nothing
    of such a payload is used.  ``usable`` names a boolean column of ``recovered``: where it is
    not true, the row came back but could not be normalised, which is VALIDATION_FAIL.  Only
    the wanted times are looked up.
    """
    key = [*by, ts]
    wanted = targets.select(*key).distinct()
    present = series.join(wanted, key, "left_semi").select(*key).distinct().withColumn("_present", F.lit(True))
    ok = F.coalesce(F.col(f"_row.{usable}"), F.lit(False)) if usable else F.lit(True)
    returned = _last_returned(recovered, wanted, key).select(*key, ok.alias("_returned"))
    out = wanted.join(present, key, "left").join(returned, key, "left")
    if bad_schema is None:
        out = out.withColumn("_bad", F.lit(None).cast("boolean"))
    else:
        out = out.join(bad_schema.select(*by).distinct().withColumn("_bad", F.lit(True)), list(by), "left")
    return out.select(
        *key,
        F.when(F.col("_present"), "ALREADY_PRESENT")
        .when(F.col("_bad"), "SCHEMA_FAIL")
        .when(F.col("_returned").isNull(), "NOT_RETURNED")
        .when(F.col("_returned"), "RECOVERED")
        .otherwise("VALIDATION_FAIL")
        .alias("target_status"),
    )


def apply_gap_fill(
    series: DataFrame,
    recovered: DataFrame,
    targets: DataFrame,
    by: Sequence[str],
    ts: str,
    bad_schema: DataFrame | None = None,
    usable: str | None = None,
    period: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(repaired series, report).  Exactly the wanted missing times are inserted; stored rows
    are never overwritten, and of several recovered rows for one time the last one counts.

    A file is written by ``period``, the month of the time if not given.  One that holds a
    time twice is not written: what would go into it is VALIDATION_FAIL, while the other months of
    the series are filled.
    """
    key = [*by, ts]
    month = month_start_ms(ts) if period is None else period
    copies = series.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twice = copies.select(*by, month.alias("_period"), F.lit(True).alias("_twice")).distinct()
    report = gap_targets(series, recovered, targets, by, ts, bad_schema, usable).withColumn("_period", month)
    report = report.join(twice, [*by, "_period"], "left")
    refused = F.col("_twice").isNotNull() & (F.col("target_status") == "RECOVERED")
    report = report.withColumn("target_status", F.when(refused, "VALIDATION_FAIL").otherwise(F.col("target_status"))).drop("_twice", "_period")
    rest = [c for c in series.columns if c not in key]
    one = _last_returned(recovered, report.filter(F.col("target_status") == "RECOVERED"), key).select(*key, *[F.col(f"_row.{c}") for c in rest])
    repaired = series.unionByName(one.select(*series.columns))
    report = report.withColumns(
        {
            "recovered": F.col("target_status").isin("RECOVERED", "ALREADY_PRESENT"),
            "inserted": F.col("target_status") == "RECOVERED",
        }
    )
    return repaired, report


def gap_rollup(report: DataFrame, integrity: DataFrame, error_count: int = 0) -> DataFrame:
    """One row: inserted and unresolved targets, and PASS or PARTIAL."""
    a = report.agg(
        F.count_if("inserted").alias("inserted"),
        F.count_if(~F.col("inserted") & (F.col("target_status") != "ALREADY_PRESENT")).alias("unresolved"),
        F.lit(0).cast("long").alias("_not_ok"),
    )
    b = integrity.agg(
        F.lit(0).cast("long").alias("inserted"),
        F.lit(0).cast("long").alias("unresolved"),
        F.count_if(F.col("status") != "OK").alias("_not_ok"),
    )
    total = a.unionByName(b).agg(*[F.sum(c).alias(c) for c in a.columns])
    clean = (F.col("unresolved") == 0) & (F.col("_not_ok") == 0) & F.lit(error_count == 0)
    return total.select(
        "inserted",
        "unresolved",
        F.lit(error_count).cast("long").alias("request_errors"),
        F.when(clean, "PASS").otherwise("PARTIAL").alias("status"),
    )


def add_note(existing: Column, suffix: Column) -> Column:
    """Append a note once."""
    joined = F.trim(F.concat(F.coalesce(existing, F.lit("")), F.lit(" | "), suffix), F.lit(" |"))
    return F.when(F.contains(F.coalesce(existing, F.lit("")), suffix), existing).otherwise(joined)


def refresh_manifest(manifest: DataFrame, touched: DataFrame) -> DataFrame:
    """Replace the measured columns of the files in ``touched``.

    ``touched(dataset_id, symbol, local_path, start_timestamp_utc, end_timestamp_utc,
    row_count, status, source_url, inserted_count)``.  Lineage columns change only where rows
    were inserted.
    """
    key = ["dataset_id", "symbol", "local_path"]
    new = touched.select(*key, F.struct(*[c for c in touched.columns if c not in key]).alias("_new"))
    joined = manifest.join(new, key, "left")
    hit = F.col("_new").isNotNull()
    inserted = hit & (F.col("_new.inserted_count") > 0)
    suffix = F.when(inserted, "gap_resolution=inserted_exact_rest_rows").otherwise("gap_resolution=no_insert")
    changes = {
        **{
            c: F.when(hit, F.col(f"_new.{c}").cast(manifest.schema[c].dataType)).otherwise(F.col(c))
            for c in ("start_timestamp_utc", "end_timestamp_utc", "row_count", "status")
        },
        "source_type": F.when(inserted, "archive_rest_gap_resolved").otherwise(F.col("source_type")),
        "source_url": F.when(inserted, F.col("_new.source_url")).otherwise(F.col("source_url")),
        "notes": F.when(hit, add_note(F.col("notes"), suffix)).otherwise(F.col("notes")),
    }
    return joined.withColumns(changes).select(*manifest.columns)


# ---- availability of sources -----------------------------------------------------------------


def probe_passes() -> Column:
    """One probed (dataset, symbol): archives at both ends (the oldest month may lack for
    funding) or all probed windows, with rows of the expected width."""
    latest = F.col("archive_latest") | F.col("rest_latest")
    old_enough = F.col("archive_2021") | (F.col("dataset_id") == "funding_rate_history")
    archives = F.col("archive_2024") & latest & old_enough
    windows = F.col("rest_2021") & F.col("rest_2024") & F.col("rest_latest")
    return (archives | windows) & (F.col("sample_rows") > 0) & F.col("schema_ok")


def dataset_tiers(probes: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """TIER 1 where every wanted symbol passes, else UNKNOWN."""
    passed = F.coalesce(probe_passes(), F.lit(False))
    wanted = F.col("symbol").isin(*symbols)
    return probes.groupBy("dataset_id").agg(
        F.when(F.count_distinct(F.when(passed & wanted, F.col("symbol"))) == len(set(symbols)), "TIER 1")
        .otherwise("UNKNOWN")
        .alias("tier")
    )


# Datasets whose history the source limits, and those too heavy to approve.
LIMITED_HISTORY = ("open_interest_statistics", "taker_buy_sell_volume", "basis")
HEAVY_HISTORY = ("um_agg_trades", "um_trades")


def history_class() -> tuple[Column, Column]:
    """(approved, tier) from the number of recent and old sample rows."""
    recent, old = F.col("recent_rows") > 0, F.col("old_rows") > 0
    reachable = old | (F.col("archive_2021") == "YES")
    dataset = F.col("dataset_id")
    pair = lambda a, b: F.struct(F.lit(a).alias("approved"), F.lit(b).alias("tier"))
    verdict = (
        F.when(dataset.isin(*LIMITED_HISTORY) & old, pair("YES", "TIER 1"))
        .when(dataset.isin(*LIMITED_HISTORY) & recent, pair("NO", "TIER 2"))
        .when(dataset.isin(*LIMITED_HISTORY, *HEAVY_HISTORY), pair("UNKNOWN", "UNKNOWN"))
        .when(reachable & recent, pair("YES", "TIER 1"))
        .otherwise(pair("UNKNOWN", "UNKNOWN"))
    )
    return verdict["approved"], verdict["tier"]


def month_validation(rows: DataFrame, by: Sequence[str], ts: str, physical: Sequence[str], bucket: Column) -> DataFrame:
    """``file_integrity`` on the one-minute grid."""
    return file_integrity(rows, by, ts, MINUTE_MS, physical, bucket)
