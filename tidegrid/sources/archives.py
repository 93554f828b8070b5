"""Readers for landed exchange archives: CSV (plain or gz) and JSON payloads.

Folders may carry ``exchange=``, ``symbol=`` and ``timeframe=`` levels, which Spark discovers
as partition columns; what is missing there is given as an argument.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.scalars import iso_to_ms, ms_to_iso
from tidegrid.params import HOUR_MS
from tidegrid.session import cut_lineage
from tidegrid.sources.schemas import (
    FUNDING_FIELDS,
    KLINE_FIELDS,
    METRICS_FIELDS,
    TIER1,
    TIER1_FUNDING,
    TIER1_KLINES,
    strings,
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the place they are stored at: (file, block, row), in reading order."""
    return spark.read.text(path).select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )


PHYSICAL = ("file_path", "block_start", "row_id")


def physical_bucket() -> Column:
    """Rows of one input split; use it where stored order is numbered."""
    return F.struct("file_path", "block_start")


def _fields(spark: SparkSession, path: str, header: str, width: int) -> DataFrame:
    """Split lines without the header, where there is one, and without short rows."""
    rows = _lines(spark, path).withColumn("_f", F.split("value", ","))
    return rows.filter((F.size("_f") >= width) & (F.trim(F.col("_f")[0]) != header)).drop("value")


def _tag(df: DataFrame, **values: str | None) -> dict[str, Column]:
    """Key columns: the argument if given, else the partition column."""
    return {k: (F.lit(v) if v is not None else F.col(k)).cast("string") for k, v in values.items()}


def read_klines(
    spark: SparkSession, path: str, exchange: str | None = None, symbol: str | None = None, timeframe: str | None = None
) -> DataFrame:
    """Kline CSV of twelve fields, with or without header, to ``bars``."""
    raw = _fields(spark, path, KLINE_FIELDS[0], len(KLINE_FIELDS))
    at = {name: F.col("_f")[i] for i, name in enumerate(KLINE_FIELDS)}
    return raw.select(
        at["open_time"].cast("long").alias("ts_open_ms"),
        at["close_time"].cast("long").alias("ts_close_ms"),
        *[at[c].cast("double").alias(c) for c in ("open", "high", "low", "close")],
        at["volume"].cast("double").alias("volume_base"),
        at["quote_volume"].cast("double").alias("volume_quote"),
        at["count"].cast("long").alias("trades"),
        at["taker_buy_volume"].cast("double").alias("taker_buy_base"),
        at["taker_buy_quote_volume"].cast("double").alias("taker_buy_quote"),
        *[c.alias(k) for k, c in _tag(raw, exchange=exchange, symbol=symbol, timeframe=timeframe).items()],
        *PHYSICAL,
    )


def read_funding(
    spark: SparkSession, path: str, exchange: str | None = None, symbol: str | None = None
) -> DataFrame:
    """Settled funding; the interval is whole hours, the predicted rate is unknown."""
    raw = _fields(spark, path, FUNDING_FIELDS[0], len(FUNDING_FIELDS))
    ts, hours, rate = (F.col("_f")[i] for i in range(3))
    return raw.select(
        ts.cast("long").alias("ts_settle_ms"),
        rate.cast("double").alias("funding_rate"),
        (hours.cast("double").cast("long") * F.lit(HOUR_MS)).alias("funding_interval_ms"),
        F.lit(None).cast("double").alias("predicted_funding_rate"),
        *[c.alias(k) for k, c in _tag(raw, exchange=exchange, symbol=symbol).items()],
        *PHYSICAL,
    )


def read_oi_metrics(spark: SparkSession, path: str, exchange: str | None = None, symbol: str | None = None) -> DataFrame:
    """Open interest and crowding ratios; blank cells and NaN are missing."""
    raw = _fields(spark, path, METRICS_FIELDS[0], len(METRICS_FIELDS))
    at = {name: F.col("_f")[i] for i, name in enumerate(METRICS_FIELDS)}

    def number(name: str) -> Column:
        value = F.nullif(F.trim(at[name]), F.lit("")).cast("double")
        return F.when(~F.isnan(value), value)

    names = {
        "oi_base": "sum_open_interest",
        "oi_value_quote": "sum_open_interest_value",
        "long_short_account_ratio": "count_long_short_ratio",
        "top_trader_account_ratio": "count_toptrader_long_short_ratio",
        "top_trader_position_ratio": "sum_toptrader_long_short_ratio",
        "taker_long_short_vol_ratio": "sum_taker_long_short_vol_ratio",
    }
    return raw.select(
        iso_to_ms(F.trim(at["create_time"])).alias("ts_ms"),
        *[number(src).alias(out) for out, src in names.items()],
        *[c.alias(k) for k, c in _tag(raw, exchange=exchange).items()],
        (F.lit(symbol) if symbol is not None else F.trim(at["symbol"])).alias("symbol"),
        *PHYSICAL,
    )


def read_price_klines(
    spark: SparkSession,
    path: str,
    kind: str,
    exchange: str | None = None,
    symbol: str | None = None,
    timeframe: str | None = None,
) -> DataFrame:
    """Mark or index klines: only the times and the close are kept."""
    if kind not in ("mark", "index"):
        raise ValueError("kind is mark or index")
    raw = _fields(spark, path, KLINE_FIELDS[0], 7)
    f = F.col("_f")
    return raw.select(
        f[0].cast("long").alias("ts_open_ms"),
        f[6].cast("long").alias("ts_close_ms"),
        f[4].cast("double").alias(f"{kind}_close"),
        *[c.alias(k) for k, c in _tag(raw, exchange=exchange, symbol=symbol, timeframe=timeframe).items()],
        *PHYSICAL,
    )


# ---- normalized tier-1 tables ------------------------------------------------------------


def _tier1(dataset: str, at: dict[str, Column], symbol: Column, source: Column, stamped: str) -> list[Column]:
    """Expressions of a tier-1 row from named raw values."""
    tail = [symbol.alias("symbol"), source.alias("source"), F.lit(stamped).alias("ingested_at_utc")]
    if dataset == "funding_rate_history":
        return [
            ms_to_iso(at["time"].cast("long")).alias("timestamp_utc"),
            at["rate"].alias("funding_rate"),
            at["mark"].alias("mark_price_at_funding"),
            *tail,
        ]
    head = [
        ms_to_iso(at["open_time"].cast("long")).alias("timestamp_open_utc"),
        ms_to_iso(at["close_time"].cast("long")).alias("timestamp_close_utc"),
        *[at[c].alias(c) for c in ("open", "high", "low", "close")],
    ]
    if dataset == "um_klines_1m":
        head += [
            at["volume"].alias("volume_base"),
            at["quote_volume"].alias("volume_quote"),
            at["count"].alias("trade_count"),
            at["taker_buy_volume"].alias("taker_buy_base"),
            at["taker_buy_quote_volume"].alias("taker_buy_quote"),
        ]
    return head + tail


def normalize_archive(
    spark: SparkSession, path: str, dataset: str, stamped: str, symbol: str | None = None
) -> DataFrame:
    """Archive CSV with a header to the tier-1 layout; the file is the lineage."""
    names = FUNDING_FIELDS if dataset == "funding_rate_history" else KLINE_FIELDS
    raw = spark.read.schema(strings(names)).option("header", True).option("enforceSchema", False).csv(path)
    if dataset == "funding_rate_history":
        at = {"time": F.col("calc_time"), "rate": F.col("last_funding_rate"), "mark": F.lit("")}
    else:
        at = {n: F.col(n) for n in names}
    who = F.lit(symbol) if symbol is not None else F.col("symbol").cast("string")
    out = raw.select(*_tier1(dataset, at, who, F.col("_metadata.file_path"), stamped))
    return out.select(*TIER1[dataset])


def normalize_rest(payloads: DataFrame, dataset: str, stamped: str) -> tuple[DataFrame, DataFrame]:
    """Landed payloads ``(symbol, source, body)`` to (tier-1 rows, quarantined rows).

    Kline payloads are arrays of arrays, and a row must have twelve fields; funding payloads
    are arrays of objects.
    """
    if dataset == "funding_rate_history":
        item = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
    else:
        item = T.ArrayType(T.ArrayType(T.StringType()))
    rows = payloads.select("symbol", "source", F.posexplode(F.from_json("body", item)).alias("payload_order", "_row"))
    r = F.col("_row")
    if dataset == "funding_rate_history":
        good = r["fundingTime"].isNotNull() & r["fundingRate"].isNotNull()
        at = {"time": r["fundingTime"], "rate": r["fundingRate"], "mark": F.coalesce(r["markPrice"], F.lit(""))}
    else:
        good = F.size(r) == len(KLINE_FIELDS)
        at = {n: F.get(r, i) for i, n in enumerate(KLINE_FIELDS)}
    good = F.coalesce(good, F.lit(False))
    kept = rows.filter(good).select(*_tier1(dataset, at, F.col("symbol"), F.col("source"), stamped))
    bad = rows.filter(~good).select("symbol", "source", "payload_order", F.to_json("_row").alias("row"))
    return kept.select(*TIER1[dataset]), bad


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark the line at the very beginning of each file; a task reads the lines of a file one after another."""
    block = None
    for batch in batches:
        marks = np.zeros(batch.num_rows, bool)
        for i, here in enumerate(zip(batch.column("file_path").to_pylist(), batch.column("block_start").to_pylist(), strict=True)):
            if here != block:
                block, marks[i] = here, here[1] == 0
        yield batch.append_column("first", pa.array(marks))


def scan_lines(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """All lines that are not blank, with where they are stored and whether they are the first of their file; each file is read once.

    The result is a table, since the layout of a file is needed by tasks that read later blocks of it.
    """
    lines = _lines(spark, path).filter(F.col("value") != "")
    lines = lines.select("value", *PHYSICAL, *([F.col(folder).cast("string").alias("folder_symbol")] if folder else []))
    schema = T.StructType([*lines.schema.fields, T.StructField("first", T.BooleanType())])
    return cut_lineage(lines.mapInArrow(_first_lines, schema))


def _headers(scanned: DataFrame) -> DataFrame:
    return scanned.filter("first").select("file_path", F.col("value").alias("header"))


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """First line of each file."""
    return _headers(scan_lines(spark, path))


def _schema_ok(wanted: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.lit(list(wanted)), F.split("header", ","))) == 0


def schema_report(spark: SparkSession, path: str, dataset: str, exact: bool = True) -> DataFrame:
    """Per file: is the header the expected one?  ``exact`` asks for the same columns in the
    same order, otherwise all expected columns must be there."""
    wanted = TIER1[dataset]
    ok = (F.col("header") == ",".join(wanted)) if exact else _schema_ok(wanted)
    return file_headers(spark, path).select(
        "file_path", ok.alias("schema_ok"), F.col("header").alias("observed_schema_fields")
    )


@dataclass(frozen=True)
class Tier1:
    """Rows of the files that have all columns, by column name; and the files that lack one, with their header."""

    dataset: str
    rows: DataFrame
    bad_files: DataFrame


def scan_tier1(spark: SparkSession, path: str, dataset: str, folder: str = "symbol") -> Tier1:
    """Tier-1 files, each read once; ``folder`` is the level that names the symbol.

    Only the first line of a file is its header: a line that repeats it is a row, which the audit
    will not be able to parse.  Cells that a short line lacks are null.  A gz file is read by one task.
    """
    wanted = TIER1[dataset]
    scanned = scan_lines(spark, path, folder)
    headers = _headers(scanned).withColumn("_ok", _schema_ok(wanted))
    names = headers.filter("_ok").select("file_path", F.split("header", ",").alias("_names"))
    joined = scanned.filter(~F.col("first")).join(names, "file_path")
    # split() keeps blank cells at the end, so positions hold.
    cells = F.split("value", ",", -1)
    picked = [F.try_element_at(cells, F.array_position("_names", n).cast("int")).alias(n) for n in wanted]
    bad = scanned.filter("first").join(headers.filter(~F.col("_ok")).select("file_path"), "file_path")
    return Tier1(
        dataset,
        joined.select(*picked, "folder_symbol", *PHYSICAL),
        bad.select("file_path", "folder_symbol", F.col("value").alias("header"), "block_start", "row_id"),
    )


def read_tier1(spark: SparkSession, path: str, dataset: str, folder: str = "symbol") -> DataFrame:
    """The rows of ``scan_tier1``."""
    return scan_tier1(spark, path, dataset, folder).rows


def audit_rows(tier1: DataFrame | Tier1, dataset: str | None = None) -> DataFrame:
    """Tier-1 rows in the layout of the point-in-time audit.

    Of a whole scan, each file that lacks a column is a row, too, with ``bad_file`` set.
    """
    rows, dataset = (tier1.rows, tier1.dataset) if isinstance(tier1, Tier1) else (tier1, dataset)
    if dataset == "funding_rate_history":
        open_ms, close_ms = iso_to_ms("timestamp_utc"), F.lit(None).cast("long")
        mark = F.nullif(F.col("mark_price_at_funding"), F.lit(""))
        numbers = F.col("funding_rate").try_cast("double").isNotNull()
        # A missing cell is no blank one.
        numbers = numbers & F.col("mark_price_at_funding").isNotNull() & (mark.isNull() | mark.try_cast("double").isNotNull())
        parsed = open_ms.isNotNull() & numbers
    else:
        open_ms, close_ms = iso_to_ms("timestamp_open_utc"), iso_to_ms("timestamp_close_utc")
        parsed = open_ms.isNotNull() & close_ms.isNotNull()
    out = rows.select(
        F.lit(dataset).alias("dataset_id"),
        F.col("folder_symbol").alias("symbol"),
        F.col("symbol").alias("row_symbol"),
        open_ms.alias("open_ms"),
        close_ms.alias("close_ms"),
        F.coalesce(parsed, F.lit(False)).alias("parsed"),
        F.lit(False).alias("bad_file"),
        *PHYSICAL,
    )
    if not isinstance(tier1, Tier1):
        return out
    none = F.lit(None)
    return out.unionByName(
        tier1.bad_files.select(
            F.lit(dataset).alias("dataset_id"),
            F.col("folder_symbol").alias("symbol"),
            none.cast("string").alias("row_symbol"),
            none.cast("long").alias("open_ms"),
            none.cast("long").alias("close_ms"),
            F.lit(False).alias("parsed"),
            F.lit(True).alias("bad_file"),
            *PHYSICAL,
        )
    )


# ---- strategy feeds ---------------------------------------------------------------------------

_FEEDS = {
    # kind: (header start, least fields, time fields, number fields, number fields that may be blank)
    "funding": ("timestamp_utc", 6, {"ts_ms": 0}, {"funding_rate": 2}, {"mark_price_at_funding": 3}),
    "premium": ("timestamp_open_utc", 9, {"ts_open_ms": 0, "ts_close_ms": 1}, {"open": 3, "high": 4, "low": 5, "close": 6}, {}),
}


def read_custom_feed(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows, bad rows, per-feed report).

    A bad row keeps its reason and its first 180 characters; any bad row makes its feed
    invalid.  A feed is a file.
    """
    start, least, times, numbers, optional = _FEEDS[kind]
    lines = _lines(spark, path).filter((F.col("value") != "") & ~F.col("value").startswith(start))
    cells = F.split("value", ",", -1)
    typed = {n: iso_to_ms(F.get("_cells", i)) for n, i in times.items()}
    typed |= {n: F.get("_cells", i).try_cast("double") for n, i in numbers.items()}
    typed |= {
        n: F.when(F.get("_cells", i) == "", F.lit(0.0)).otherwise(F.get("_cells", i).try_cast("double"))
        for n, i in optional.items()
    }
    rows = lines.withColumn("_cells", cells).withColumns(typed)
    unread = F.lit(False)
    for n in typed:
        unread = unread | F.col(n).isNull()
    reason = F.when(F.size("_cells") < least, "column_count").when(unread, "parse_error")
    rows = rows.withColumn("reason", reason).withColumn("source_symbol", F.get("_cells", 1 if kind == "funding" else 2))
    good = rows.filter(F.col("reason").isNull()).select("source_symbol", *typed, *PHYSICAL)
    bad = rows.filter(F.col("reason").isNotNull()).select("file_path", "reason", F.substring("value", 1, 180).alias("line_snippet"))
    report = rows.groupBy("file_path").agg(
        F.count_if(F.col("reason").isNull()).alias("good_rows"),
        F.count_if(F.col("reason").isNotNull()).alias("parse_error_count"),
        (F.count_if(F.col("reason").isNotNull()) == 0).alias("valid"),
    )
    return good, bad, report


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and SHA-256 of each file.  A file passes through one task whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("local_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
