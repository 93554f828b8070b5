"""Tables at rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalars import ms_to_iso
from tidegrid.operators.joins import dedupe_keep_first
from tidegrid.params import SERIES_KEYS


def read_series(spark: SparkSession, root: str, kind: str, with_position: bool = False) -> DataFrame:
    """All series of a kind.  Filters on the key columns prune folders, filters on times and
    the chosen columns reach the Parquet scan."""
    df = spark.read.parquet(f"{root}/{kind}")
    if with_position:
        df = df.select(
            "*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index")
        )
    return df


def write_table(df: DataFrame, root: str, kind: str, keys: Sequence[str] = SERIES_KEYS) -> None:
    """Replace exactly the series that ``df`` holds; other series stay.

    The commit protocol makes a rewrite atomic per job: readers see the old files or the new
    ones.  Rows of a series are spread over several files by time, so a hot series is neither
    written nor read by one task.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(f"{root}/{kind}")
    )


def clip_window(df: DataFrame, ts: str, start_ms: int, end_ms: int) -> DataFrame:
    """Rows with start <= ts <= end; reaches the scan as a pushed filter."""
    return df.filter(F.col(ts).between(start_ms, end_ms))


def write_report_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """CSV with a fixed column order and a header.  Booleans are written in capitals."""
    columns = [
        F.upper(F.col(f).cast("string")).alias(f) if df.schema[f].dataType.typeName() == "boolean" else F.col(f)
        for f in fields
    ]
    df.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def funding_export(funding: DataFrame, order: Sequence[str]) -> DataFrame:
    """Settled funding, one row per time, as text for a strategy feed."""
    first = dedupe_keep_first(funding, ["exchange", "symbol", "ts_settle_ms"], order)
    return first.select(
        ms_to_iso("ts_settle_ms").alias("timestamp_utc"), "symbol", F.col("funding_rate").cast("string").alias("funding_rate")
    )


def export_funding_csv(funding: DataFrame, path: str, order: Sequence[str]) -> None:
    rows = funding_export(funding, order)
    rows.repartitionByRange("symbol", "timestamp_utc").sortWithinPartitions("symbol", "timestamp_utc").write.mode(
        "overwrite"
    ).option("header", True).csv(path)
