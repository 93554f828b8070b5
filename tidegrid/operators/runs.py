"""Exports of finished runs: metrics, evidence, verdict draft, registry."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.records import count_records
from tidegrid.functions.scalars import run_id_from_folder, split_window
from tidegrid.session import cut_lineage
from tidegrid.sources.versions import update_table

# ---- fixed values ---------------------------------------------------------------------------

PRIMARY_FILES = ("trades.csv", "orders.csv", "logs.txt", "statistics.txt", "statistics.json")
SECONDARY_FILES = ("overview.png", "equity_curve.png", "report.pdf")

METRIC_ALIASES = {
    "total_trades": ["total trades", "totaltrades", "total_orders", "total trades count"],
    "net_return": ["net profit", "total net profit", "netprofit", "net_return"],
    "sharpe": ["sharpe ratio", "sharpe"],
    "max_drawdown": ["drawdown", "max drawdown", "maxdrawdown"],
    "win_rate": ["win rate", "winrate"],
    "profit_factor": ["profit factor", "profitfactor"],
    "avg_trade_net": ["average trade", "avg trade", "average win", "expectancy", "avg_trade"],
}

# Where a text has a new line, and what is blank around one.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

LABEL_LINE = r"^([A-Za-z][A-Za-z0-9 _\-/%()]+?)[:\t]\s*(.+)$"

REGISTRY_COLUMNS = (
    "hypothesis_id",
    "strategy_id",
    "backtest_id",
    "date",
    "symbols",
    "timeframe",
    "is_start",
    "is_end",
    "oos_start",
    "oos_end",
    "total_trades",
    "net_return",
    "sharpe",
    "max_drawdown",
    "win_rate",
    "profit_factor",
    "avg_trade_net",
    "avg_trade_prefee",
    "mc_p5_final_equity",
    "mc_p95_max_drawdown",
    "mc_prob_loss",
    "evidence_confidence",
    "verdict",
    "reason",
    "artifacts_path",
)

# ---- reading ---------------------------------------------------------------------------------

_LEAVES = T.ArrayType(
    T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType()), T.StructField("pos", T.IntegerType())])
)


def _leaves(text: str | None) -> list[tuple[str, str, int]]:
    """Leaves of a JSON document in document order; a text that is no JSON has none."""
    try:
        stack = [("", json.loads(text))]
    except (TypeError, ValueError):
        return []
    found: dict[str, str] = {}
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            stack += [(f"{path}.{k}" if path else str(k), v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(node)))]
        else:
            found[path.lower()] = str(node)
    return [(p, v, i) for i, (p, v) in enumerate(found.items())]


@F.pandas_udf(_LEAVES)
def json_leaves(text: pd.Series) -> pd.Series:
    return text.map(_leaves)


def flatten_run_json(documents: DataFrame, keys: tuple[str, ...] = ("run_id",), text: str = "text") -> DataFrame:
    """One row per leaf: lower-cased dotted path, value as text, place in the document.

    Nesting is unbounded, which no schema can express, hence the one Python helper.
    """
    return documents.select(*keys, F.inline(json_leaves(F.col(text))))


def parse_run_text(documents: DataFrame, keys: tuple[str, ...] = ("run_id",), text: str = "text") -> DataFrame:
    """``Label: value`` or tab-separated lines to lower-cased label, value and place."""
    lines = documents.select(*keys, F.posexplode(F.split(F.col(text), LINE_ENDS)).alias("pos", "_line"))
    bare = lambda c: F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")
    line = bare(F.col("_line"))
    hit = lines.withColumn("_line", line).filter(F.col("_line").rlike(LABEL_LINE))
    return hit.select(
        *keys,
        F.lower(F.trim(F.regexp_extract("_line", LABEL_LINE, 1))).alias("path"),
        bare(F.regexp_extract("_line", LABEL_LINE, 2)).alias("value"),
        "pos",
    )


def run_folder() -> tuple[Column, Column]:
    """(run folder, file name) from the path of the file that is read."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return F.element_at(parts, -2), F.element_at(parts, -1)


def read_run_texts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Whole texts of one kind of file (``statistics.json``), one row per run."""
    raw = spark.read.option("wholetext", True).text(f"{path}/*/{name}")
    folder, _ = run_folder()
    return raw.select(folder.alias("run_id"), F.col("value").alias("text"))


def trade_counts(spark: SparkSession, path: str, name: str = "trades.csv") -> DataFrame:
    """Trades per run: CSV records of its file below the header, blank ones included.

    Line breaks in quoted cells end no record.  An empty file has no count.  Large files are
    read in blocks.
    """
    raw = spark.read.text(f"{path}/*/{name}")
    lines = raw.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    records = count_records(lines, "file_path", "block_start", "row_id")
    run = F.element_at(F.split("file_path", "/"), -2)
    return records.groupBy(run.alias("run_id")).agg(F.sum(F.col("records") - 1).alias("trades"))


def run_files(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, file_name) of every file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("run_id"), F.element_at(parts, -1).alias("file_name"))


# ---- metrics and verdict -----------------------------------------------------------------------


def resolve_metrics(leaves: DataFrame, aliases: dict[str, list[str]] = METRIC_ALIASES) -> DataFrame:
    """``leaves(run_id, source_rank, path, value, pos)`` to (run_id, metric, value).

    For each metric the lowest source rank wins, in it the first alias contained in any path,
    and of its paths the first in the document.
    """
    options = [
        F.when(
            F.contains(F.col("path"), F.lit(alias)) & (F.col("value") != ""),
            F.struct(F.lit(metric).alias("metric"), F.lit(i).alias("alias_rank")),
        )
        for metric, names in aliases.items()
        for i, alias in enumerate(names)
    ]
    hits = leaves.select("run_id", "source_rank", "pos", "value", F.inline(F.array_compact(F.array(*options))))
    order = F.struct("source_rank", "alias_rank", "pos")
    return hits.groupBy("run_id", "metric").agg(F.min_by("value", order).alias("value"))


def metrics_wide(metrics: DataFrame, names: tuple[str, ...] = tuple(METRIC_ALIASES)) -> DataFrame:
    return metrics.groupBy("run_id").agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def evidence(files: DataFrame) -> DataFrame:
    """Per run: evidence files present and missing, and the confidence they give."""
    known = F.lit(list(PRIMARY_FILES + SECONDARY_FILES))
    name = F.col("file_name")
    found = files.groupBy("run_id").agg(
        F.bool_or(name.isin(*PRIMARY_FILES)).alias("_primary"),
        F.bool_or(name.isin(*SECONDARY_FILES)).alias("_secondary"),
        F.collect_set(F.when(name.isin(*PRIMARY_FILES, *SECONDARY_FILES), name)).alias("_known"),
    )
    return found.select(
        "run_id",
        F.array_sort("_known").alias("present_files"),
        F.array_sort(F.array_except(known, F.col("_known"))).alias("missing_files"),
        confidence(F.col("_primary"), F.col("_secondary")).alias("evidence_confidence"),
    )


def confidence(primary: Column, secondary: Column) -> Column:
    return F.when(primary, "OK").when(secondary, "LOW_CONFIDENCE").otherwise("NO_EVIDENCE")


def numeric_text(text: Column) -> Column:
    """Digits, dots and minus signs of a text as a whole number; null if that is no number."""
    digits = F.regexp_replace(text, r"[^0-9.\-]", "")
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(digits.try_cast("double").cast("long"))


def draft_verdict(conf: Column, trades: Column, ready: str = "READY_FOR_REVIEW") -> tuple[Column, Column]:
    """(verdict, reason) from the evidence and the number of trades."""
    n = trades.cast("string")
    pair = lambda v, r: F.struct(F.lit(v).alias("verdict"), r.alias("reason"))
    text = lambda s: F.lit(s)
    out = (
        F.when(conf == "NO_EVIDENCE", pair("INCONCLUSIVE_DRAFT", text("no artifacts present")))
        .when(conf == "LOW_CONFIDENCE", pair("INCONCLUSIVE_DRAFT", text("screenshots only; no machine-readable artifacts")))
        .when(trades < 30, pair("FAIL_DRAFT", F.concat(text("trade count "), n, text(" below swing minimum 30"))))
        .when(trades < 300, pair("INCONCLUSIVE_DRAFT", F.concat(text("trade count "), n, text(" below intraday minimum 300"))))
        .otherwise(pair(ready, text("primary artifacts present; criteria 1-6 to be evaluated in review")))
    )
    return out["verdict"], out["reason"]


def run_report(files: DataFrame, leaves: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per run: files, confidence, metrics, verdict draft.

    The number of trades comes from the trade list, else from the metric.
    """
    wide = metrics_wide(resolve_metrics(leaves))
    joined = evidence(files).join(wide, "run_id", "left").join(counts, "run_id", "left")
    n = F.coalesce("trades", numeric_text(F.col("total_trades")))
    verdict, reason = draft_verdict(F.col("evidence_confidence"), n)
    return (
        joined.withColumn("total_trades", F.coalesce("total_trades", F.col("trades").cast("string")))
        .withColumns({"verdict": verdict, "reason": reason})
        .drop("trades")
    )


def registry_rows(
    report: DataFrame, runs: DataFrame
) -> DataFrame:
    """Registry rows from reports and ``runs(run_id, hypothesis_id, strategy_id, date,
    symbols, timeframe, is_window, oos_window, artifacts_path)``; what is unknown stays empty."""
    is_start, is_end = split_window(F.col("is_window"))
    oos_start, oos_end = split_window(F.col("oos_window"))
    both = report.join(runs, "run_id").withColumns(
        {
            "backtest_id": run_id_from_folder(F.col("run_id"), F.col("hypothesis_id")),
            "is_start": is_start,
            "is_end": is_end,
            "oos_start": oos_start,
            "oos_end": oos_end,
        }
    )
    return both.select(
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in both.columns else F.lit("").alias(c)
            for c in REGISTRY_COLUMNS
        ]
    )


def upsert_experiments(registry: DataFrame, new: DataFrame, key: str = "backtest_id") -> DataFrame:
    """Rows of ``new`` replace those with the same key, others are appended.  Never write the
    result over its own input; ``upsert_registry`` makes a new version of it."""
    return registry.join(new.select(key).distinct(), key, "left_anti").select(*registry.columns).unionByName(
        new.select(*registry.columns)
    )


def upsert_registry(spark: SparkSession, root: str, new: DataFrame) -> int:
    """Upsert registry rows into the versioned table at ``root``; several writers may do so at once.

    Columns that an old registry lacks are empty, those it has beyond ``REGISTRY_COLUMNS`` go.
    Two new rows of one backtest are refused, since neither is the later one.
    """
    rows = new.select(*REGISTRY_COLUMNS)
    once = rows.groupBy("backtest_id").agg(
        *[F.first(c).alias(c) for c in REGISTRY_COLUMNS if c != "backtest_id"], F.count(F.lit(1)).alias("_n")
    )
    repeated = F.raise_error(F.concat(F.lit("two new rows of "), F.coalesce("backtest_id", F.lit("null"))))
    checked = once.withColumn("backtest_id", F.when(F.col("_n") == 1, F.col("backtest_id")).otherwise(repeated))
    rows = cut_lineage(checked.select(*REGISTRY_COLUMNS))

    def change(old: DataFrame | None) -> DataFrame:
        if old is None:
            return rows
        whole = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in old.columns else F.lit("").alias(c) for c in REGISTRY_COLUMNS]
        return upsert_experiments(old.select(*whole), rows)

    return update_table(spark, root, change)
