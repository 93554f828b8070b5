"""One query per operator over the driver's tables.  All of them read whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalars import (
    event_id,
    horizon_bars,
    iso_to_ms,
    month_bounds,
    month_start_ms,
    ms_to_date,
    ms_to_iso,
    ms_to_ntz,
    ntz_to_ms,
    short_event,
)
from tidegrid.functions.segments import cut, ensure_index
from tidegrid.operators import events as ev
from tidegrid.operators import features as ft
from tidegrid.operators import integrity, joins, ledger, montecarlo, outcomes, pit, quality, regimes, runs, selection
from tidegrid.operators import signals as sg
from tidegrid.operators import stability, trades
from tidegrid.operators.leaderboard import build_leaderboard, canonical_order
from tidegrid.params import (
    DAY_MS,
    EVENT_TYPES,
    FUNDING_INTERVAL_MS,
    HOUR_MS,
    MINUTE_MS,
    SERIES_KEYS,
    SelectionParams,
    StabilityParams,
    StudyParams,
)
from tidegrid.plans.event_study import Study, run_study, shock_outcomes
from tidegrid.session import cut_lineage, shared_folder
from tidegrid.sources import archives as ar
from tidegrid.sources import ticks as tk
from tidegrid.sources.schemas import KLINE_FIELDS
from tidegrid.sources.tables import clip_window, export_funding_csv, funding_export, read_series, write_report_csv, write_table
from tidegrid.sources.versions import read_version
from tidegrid.streaming import streams as st

STABILITY = StabilityParams()
SELECTION = SelectionParams()
PAIR = ("click", "view")
# Both symbols of a pair rarely pass on random bars; the paired query takes a wider limit, so that some do.
WIDE_P = 0.5
# The series that holds repeated times where repairs are shown.
FLAWED = "view"
GAPS_MS = (1704103200000, 1704189600000)
CLIP = (1704412800000, 1705276800000)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Digits of columns that need other ones than the rest: large sums, and tiny rates.
DIGITS = {
    **dict.fromkeys(("volume_base", "volume_quote", "taker_buy_base", "taker_buy_quote"), 4),
    **dict.fromkeys(("funding_rate", "funding_rate_ffill"), 12),
}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, without negative zero; widen integers."""

    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("double", "float"):
            return (F.round(c, DIGITS.get(name, digits)) + F.lit(0.0)).alias(name)
        if kind in ("byte", "short", "integer"):
            return c.cast("long").alias(name)
        return c

    return df.select(*[one(f.name, f.dataType.typeName()) for f in df.schema.fields])


# ---- inputs ---------------------------------------------------------------------------------


def market(spark: SparkSession, sf: str, tfs: tuple[str, ...] = ("1h",), stored: bool = False):
    """Ticks and bars.  ``stored`` writes the bars with their positions as a table first, as
    a pipeline would: the joins and frames after it read them several times."""
    ticks = tk.read_ticks(spark, sf)
    bars = tk.bars_from_ticks(ticks, tfs)
    if stored:
        bars = cut_lineage(ensure_index(bars, SERIES_KEYS, StudyParams().segments.rows))
    return ticks, bars


def _joined(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    return joins.join_state(
        bars,
        tk.funding_from_ticks(ticks),
        tk.oi_from_ticks(ticks),
        tk.mark_from_bars(bars),
        tk.index_from_bars(bars),
    )


def joined(spark: SparkSession, sf: str, tfs: tuple[str, ...] = ("1h",)) -> DataFrame:
    return _joined(*market(spark, sf, tfs, stored=True))


def dense_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Five-minute bars of a series that is longer than the widest frame."""
    ticks = tk.read_dense_ticks(spark, sf)
    bars = tk.bars_from_ticks(ticks, ("5m",))
    return cut_lineage(_joined(ticks, cut_lineage(ensure_index(bars, SERIES_KEYS, StudyParams().segments.rows))))


def dense_study(spark: SparkSession, sf: str) -> Study:
    return run_study(dense_joined(spark, sf), StudyParams())


def study(spark: SparkSession, sf: str, tfs: tuple[str, ...] = ("1h",)) -> Study:
    """Bars, joined bars and outcomes are tables of a pipeline; each is written once."""
    return run_study(cut_lineage(joined(spark, sf, tfs)), StudyParams())


def stored_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes as a table: cells are formed in several passes over them."""
    return cut_lineage(study(spark, sf).strong_outcomes)


def minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Raw minute rows: several per minute, stored in the order of their id."""
    ticks = tk.read_ticks(spark, sf)
    minute = F.floor(F.col("ts_ms") / F.lit(MINUTE_MS)) * F.lit(MINUTE_MS)
    return ticks.select("exchange", "symbol", F.lit("1m").alias("timeframe"), minute.alias("ts_open_ms"), "event_id", "k", "value")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(dataset_id, symbol, ts_ms): which source has which minute."""
    m = minutes(spark, sf)
    has = F.array_compact(
        F.array(
            F.when(F.col("k") % 10 != 0, F.lit("um_klines_1m")),
            F.when(F.col("k") % 7 != 0, F.lit("premium_index_klines")),
            F.when(F.col("k") % 11 != 0, F.lit("mark_price_klines")),
            F.when(F.col("k") % 13 != 0, F.lit("index_price_klines")),
        )
    )
    return m.select(F.explode(has).alias("dataset_id"), "symbol", F.col("ts_open_ms").alias("ts_ms")).distinct()


def funding_times(spark: SparkSession, sf: str) -> DataFrame:
    return tk.funding_from_ticks(tk.read_ticks(spark, sf)).select(
        "symbol", (F.col("ts_settle_ms") + F.lit(FUNDING_INTERVAL_MS)).alias("ts_ms")
    )


def tick_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Every event a trade: strategy by type, percent results from value and k."""
    t = tk.read_ticks(spark, sf)
    pre = (F.col("value") - 45.0) / 50.0
    return t.select(
        F.col("symbol").alias("strategy_id"),
        F.col("event_id").alias("trade_seq"),
        "ts_ms",
        ms_to_date("ts_ms").alias("date"),
        F.when(F.col("ts_ms") < 1705276800000, "IS").otherwise("OOS").alias("sample"),
        pre.alias("pre_fee_pct"),
        (pre - 0.08).alias("post_fee_pct"),
        "k",
        "value",
    )


def limit_orders(bars: DataFrame) -> DataFrame:
    """A limit order at each bar: long below an even close, short above an odd one."""
    even = F.col("trades") % 2 == 0
    return bars.withColumns(
        {
            "side": F.when(even, 1).otherwise(-1),
            "limit_price": F.when(even, F.col("close") - 10.0).otherwise(F.col("close") + 10.0),
        }
    )


def breakout_signals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    _, bars = market(spark, sf, stored=True)
    found = sg.compression_breakout_signal(bars, 12, 9.85)
    return found.withColumn("strategy_id", F.lit("breakout")), bars


def trade_table(spark: SparkSession, sf: str) -> DataFrame:
    found, bars = breakout_signals(spark, sf)
    return ledger.trade_ledger(found, bars, hold_bars=6, stop_frac=0.02)


def momentum_signals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two strategies, one with and one against each move of a percent; most bars have one."""
    _, bars = market(spark, sf, stored=True)
    seg = cut(bars, SERIES_KEYS, "ts_open_ms", StudyParams().segments.rows, before=1)
    move = seg.with_columns({"_move": F.col("close") / F.lag("close").over(seg.window()) - 1.0}).owned()
    side = F.when(F.col("_move") >= 0.01, 1).when(F.col("_move") <= -0.01, -1).otherwise(0)
    each = F.array(*[F.struct(F.lit(n).alias("strategy_id"), (side * k).alias("direction")) for n, k in (("follow", 1), ("fade", -1))])
    return move.select(*SERIES_KEYS, "ts_open_ms", F.inline(each)), bars


# ---- scans and their shapes ----------------------------------------------------------------------


@query
def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of two timeframes from the events, in one pass."""
    _, b = market(spark, sf, ("1h", "5m"))
    return tidy(b.drop("mean_px"))


@query
def funding_settlements(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(tk.funding_from_ticks(tk.read_ticks(spark, sf)), 12)


@query
def open_interest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(tk.oi_from_ticks(tk.read_ticks(spark, sf)), 8)


@query
def mark_index_closes(spark: SparkSession, sf: str) -> DataFrame:
    _, b = market(spark, sf)
    out = joins.join_closes(b.select(*SERIES_KEYS, "ts_open_ms"), tk.mark_from_bars(b), tk.index_from_bars(b))
    return tidy(out)


@query
def series_inventory(spark: SparkSession, sf: str) -> DataFrame:
    ticks, b = market(spark, sf, ("1h", "5m"))
    oi = tk.oi_from_ticks(ticks).select("exchange", "symbol", F.lit("5m").alias("timeframe"), F.col("ts_ms").alias("ts_open_ms"))
    return quality.series_inventory({"bars": b.select(*SERIES_KEYS, "ts_open_ms"), "oi": oi})


@query
def funding_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    f = tk.funding_from_ticks(tk.read_ticks(spark, sf))
    out = funding_export(f, ["ts_settle_ms"])
    return tidy(out.withColumn("funding_rate", F.col("funding_rate").cast("double")), 12)


@query
def funding_csv_file(spark: SparkSession, sf: str) -> DataFrame:
    """The exported feed, read back from its CSV files; repeated settlements keep the first."""
    f = tk.funding_from_ticks(tk.read_ticks(spark, sf)).withColumn("pos", F.lit(0))
    again = f.filter(F.col("funding_rate") > 0).withColumns({"funding_rate": F.lit(9.0), "pos": F.lit(1)})
    path = f"{shared_folder(spark)}/funding-{uuid.uuid4().hex}"
    export_funding_csv(f.unionByName(again), path, ["pos"])
    # Without a schema of its own the reader takes the names from the header.
    back = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return tidy(back.withColumn("funding_rate", F.col("funding_rate").cast("double")), 12)


@query
def nested_json_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """One document per order: objects in lists in objects, lists in lists, nulls, booleans, empty ones."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    line = F.struct(
        F.col("l_linenumber").alias("no"),
        F.struct(
            F.col("l_partkey").alias("Part"),
            F.when(F.col("l_partkey") % 3 > 0, F.col("l_returnflag")).alias("Flag"),
            (F.col("l_suppkey") % 2 == 0).alias("Even"),
        ).alias("Cell"),
        F.array(F.array(F.col("l_partkey"), F.col("l_suppkey")), F.array(F.col("l_suppkey"))).alias("Pairs"),
    )
    # An order has few lines.
    docs = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("Lines"))
    body = F.struct(
        F.struct(F.col("l_orderkey").alias("Key"), "Lines").alias("Order"), F.array().cast("array<string>").alias("None"), F.lit("x").alias("Last.Name")
    )
    text = F.when(F.col("l_orderkey") % 50 == 0, F.lit("{broken")).otherwise(F.to_json(body, {"ignoreNullFields": "false"}))
    leaves = runs.flatten_run_json(docs.select("l_orderkey", text.alias("text")), ("l_orderkey",))
    return leaves.withColumn("pos", F.col("pos").cast("long"))


@query
def json_leaves(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return runs.flatten_run_json(e.select("event_id", "props"), ("event_id",), "props").drop("pos")


@query
def label_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``Label: value`` lines of whole documents, whose sentence ends are turned to colons."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    d = d.select("doc_id", F.replace("text", F.lit(". "), F.lit(": ")).alias("text"))
    return runs.parse_run_text(d, ("doc_id",)).withColumn("pos", F.col("pos").cast("long"))


# ---- raw archives ------------------------------------------------------------------------------------
# The bars of the events are written in the layout of an archive and read back by its reader.


def _landed(df: DataFrame, *levels: str, header: bool = False, compression: str | None = None, as_text: bool = True) -> str:
    """Write files below folders named by ``levels``; the place of the archive."""
    path = f"{shared_folder(df.sparkSession)}/archive-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*levels) if levels else df.write
    if compression:
        writer = writer.option("compression", compression)
    if as_text:
        writer.text(path)
    else:
        writer.option("header", header).option("emptyValue", "").csv(path)
    return path


def _line(*cols: Column | str) -> Column:
    """A CSV line; missing cells are blank."""
    return F.concat_ws(",", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]).alias("value")


def _kline_line() -> Column:
    names = ["ts_open_ms", "open", "high", "low", "close", "volume_base", "ts_close_ms", "volume_quote", "trades", "taker_buy_base", "taker_buy_quote"]
    return _line(*names, F.lit("0"))


@query
def archive_klines(spark: SparkSession, sf: str) -> DataFrame:
    """Kline files per symbol and timeframe; bars with an odd number of trades also leave a
    line that is cut off, which the reader drops."""
    _, b = market(spark, sf)
    cut_off = b.filter(F.col("trades") % 2 == 1).select("symbol", "timeframe", F.col("ts_open_ms").cast("string").alias("value"))
    path = _landed(b.select("symbol", "timeframe", _kline_line()).unionByName(cut_off), "symbol", "timeframe")
    return tidy(ar.read_klines(spark, path, exchange=tk.EXCHANGE).drop(*ar.PHYSICAL))


@query
def archive_funding(spark: SparkSession, sf: str) -> DataFrame:
    f = tk.funding_from_ticks(tk.read_ticks(spark, sf))
    path = _landed(f.select("symbol", _line("ts_settle_ms", F.lit("8.0"), "funding_rate")), "symbol")
    return tidy(ar.read_funding(spark, path, exchange=tk.EXCHANGE).drop(*ar.PHYSICAL, "predicted_funding_rate"), 12)


@query
def archive_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Open interest files; a mean of whole hundreds leaves a blank cell."""
    oi = tk.oi_from_ticks(tk.read_ticks(spark, sf))
    when = F.date_format(ms_to_ntz("ts_ms"), "yyyy-MM-dd HH:mm:ss")
    base = F.when(F.col("oi_base") % 5 != 0, F.col("oi_base"))
    line = _line(when, "symbol", base, "oi_value_quote", F.lit("1.5"), "top_trader_position_ratio", "long_short_account_ratio", "taker_long_short_vol_ratio")
    path = _landed(oi.select(line))
    return tidy(ar.read_oi_metrics(spark, path, exchange=tk.EXCHANGE).drop(*ar.PHYSICAL), 8)


@query
def archive_mark_klines(spark: SparkSession, sf: str) -> DataFrame:
    _, b = market(spark, sf)
    path = _landed(b.select("symbol", "timeframe", _kline_line()), "symbol", "timeframe")
    return tidy(ar.read_price_klines(spark, path, "mark", exchange=tk.EXCHANGE).drop(*ar.PHYSICAL))


@query
def normalized_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Tier-1 rows from archive files with a header."""
    _, b = market(spark, sf)
    names = dict(zip(["ts_open_ms", "open", "high", "low", "close", "volume_base", "ts_close_ms", "volume_quote", "trades", "taker_buy_base", "taker_buy_quote"], KLINE_FIELDS, strict=False))
    raw = b.select("symbol", *[F.col(c).alias(n) for c, n in names.items()], F.lit(0).alias("ignore"))
    path = _landed(raw, "symbol", header=True, as_text=False)
    out = ar.normalize_archive(spark, path, "um_klines_1m", "now").drop("source")
    numbers = ["open", "high", "low", "close", "volume_base", "volume_quote", "taker_buy_base", "taker_buy_quote"]
    return tidy(out.withColumns({**{c: F.col(c).cast("double") for c in numbers}, "trade_count": F.col("trade_count").cast("long")}))


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON payload per symbol and day; bars with more than four trades lack a field."""
    _, b = market(spark, sf)
    cells = [F.col(c).cast("string") for c in ("ts_open_ms", "open", "high", "low", "close", "volume_base", "ts_close_ms", "volume_quote", "trades", "taker_buy_base", "taker_buy_quote")]
    row = F.when(F.col("trades") > 4, F.array(*cells)).otherwise(F.array(*cells, F.lit("0")))
    day = F.floor(F.col("ts_open_ms") / F.lit(DAY_MS))
    return b.groupBy("symbol", day.alias("day")).agg(F.to_json(F.collect_list(row)).alias("body")).select(
        "symbol", F.col("day").cast("string").alias("source"), "body"
    )


@query
def normalized_payloads(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = ar.normalize_rest(_payloads(spark, sf), "mark_price_klines", "now")
    return tidy(good.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close")}))


@query
def quarantined_payload_rows(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = ar.normalize_rest(_payloads(spark, sf), "mark_price_klines", "now")
    return bad.groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("rows"))


@query
def tier1_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Zipped tier-1 files per symbol, read by column name and checked row by row.

    The header stands in a file again for k = 5, and each symbol has a second file without closes.
    """
    m = minutes(spark, sf)
    k = F.col("k")
    cells = {
        "timestamp_open_utc": F.when(k == 4, F.lit("?")).otherwise(ms_to_iso("ts_open_ms")),
        "timestamp_close_utc": ms_to_iso(F.col("ts_open_ms") + F.when(k == 3, F.lit(60000)).otherwise(F.lit(59999))),
        "symbol": F.when(k == 2, F.lit("other")).otherwise(F.col("symbol")),
        **{c: F.col("value").cast("string") for c in ("open", "high", "low", "close")},
        "source": F.lit("s"),
        "ingested_at_utc": F.lit("now"),
    }
    row = m.select(F.col("symbol").alias("folder_symbol"), "event_id", *[F.when(k == 5, F.lit(n)).otherwise(c).alias(n) for n, c in cells.items()])
    # One file per symbol, in the order of the events.
    stored = row.repartition("folder_symbol").sortWithinPartitions("folder_symbol", "event_id").drop("event_id")
    path = _landed(stored, "folder_symbol", header=True, compression="gzip", as_text=False)
    lacking = row.drop("event_id", "close").groupBy("folder_symbol").agg(*[F.max(c).alias(c) for c in cells if c != "close"])
    lacking.repartition("folder_symbol").write.partitionBy("folder_symbol").mode("append").option("compression", "gzip").option("header", True).csv(path)
    read = ar.scan_tier1(spark, path, "mark_price_klines", folder="folder_symbol")
    checked = pit.row_checks(ar.audit_rows(read), list(ar.PHYSICAL), ar.physical_bucket())
    return pit.row_errors(checked).groupBy("dataset_id", "symbol", "check_id", "error_type").agg(F.count(F.lit(1)).alias("errors"))


@query
def schema_check(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of tier-1 files of two datasets, checked against the layout of one."""
    f = tk.funding_from_ticks(tk.read_ticks(spark, sf))
    rows = f.select(
        "symbol", ms_to_iso("ts_settle_ms").alias("timestamp_utc"), F.col("symbol").alias("symbol_name"), "funding_rate",
        F.lit("").alias("mark_price_at_funding"), F.lit("s").alias("source"), F.lit("n").alias("ingested_at_utc"),
    )
    path = _landed(rows.withColumnRenamed("symbol", "folder"), "folder", header=True, as_text=False)
    report = ar.schema_report(spark, path, "funding_rate_history")
    return report.groupBy("schema_ok", "observed_schema_fields").agg((F.count(F.lit(1)) > 0).alias("found"))


@query
def custom_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a funding feed with bad lines: a short one for k = 0, no number for k = 1."""
    t = tk.read_ticks(spark, sf)
    k = F.col("k")
    rate = F.when(k == 1, F.lit("x")).otherwise((F.col("value") / 1000.0).cast("string"))
    line = F.when(k == 0, _line("symbol", "ts_ms")).otherwise(_line(ms_to_iso("ts_ms"), "symbol", rate, F.when(k % 2 == 0, k), F.lit("s"), F.lit("i")))
    path = _landed(t.select(line.alias("value")))
    good, bad, _ = ar.read_custom_feed(spark, path, "funding")
    counted = good.groupBy(F.col("source_symbol").alias("feed")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("funding_rate").alias("rate"), F.sum("mark_price_at_funding").alias("mark")
    )
    errors = bad.groupBy(F.concat(F.lit("bad:"), "reason").alias("feed")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("double").alias("mark")
    )
    return tidy(counted.unionByName(errors))


@query
def checksummed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and hash of each file of an archive; a symbol's lines are one file, in the order of time."""
    _, b = market(spark, sf)
    lines = b.repartition("symbol").sortWithinPartitions("symbol", "ts_open_ms").select("symbol", _line("ts_open_ms", "trades"))
    files = ar.file_checksums(spark, _landed(lines, "symbol")).filter(F.col("local_path").endswith(".txt"))
    return files.select(F.regexp_extract("local_path", "symbol=([^/]+)/", 1).alias("symbol"), "bytes", "sha256")


@query
def report_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A report written with a fixed column order and read back."""
    flags = pit.availability(sources(spark, sf), funding_times(spark, sf), GAPS_MS)
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    write_report_csv(flags, path, ["timestamp_utc", "symbol", "has_all_price_state", "no_signal_required", "notes"])
    back = spark.read.schema("timestamp_utc string, symbol string, has_all_price_state string, no_signal_required string, notes string")
    return back.option("header", True).csv(path).withColumn("notes", F.coalesce("notes", F.lit("")))


@query
def stored_series(spark: SparkSession, sf: str) -> DataFrame:
    """Two writes of a table, the second of one symbol only; then a pruned, clipped read."""
    _, b = market(spark, sf)
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    write_table(b.select(*SERIES_KEYS, "ts_open_ms", "close"), root, "bars")
    write_table(b.filter(F.col("symbol") == PAIR[0]).select(*SERIES_KEYS, "ts_open_ms", (F.col("close") * 2).alias("close")), root, "bars")
    return tidy(clip_window(read_series(spark, root, "bars"), "ts_open_ms", *CLIP))


# ---- dedup, projections, filters ---------------------------------------------------------------------


@query
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    m = minutes(spark, sf)
    return tidy(joins.dedupe_keep_first(m, [*SERIES_KEYS, "ts_open_ms"], ["event_id"]))


@query
def bar_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """Range, taker imbalance and basis of each bar."""
    j = joined(spark, sf)
    return tidy(
        j.select(
            *SERIES_KEYS,
            "ts_open_ms",
            ft.range_pct().alias("range_pct"),
            ft.taker_imbalance().alias("taker_imbalance"),
            ft.basis_bp().alias("basis_bp"),
        )
    )


@query
def funding_window_flags(spark: SparkSession, sf: str) -> DataFrame:
    j = joined(spark, sf, ("5m", "1h"))
    flags = j.withColumns(ft.funding_window_flags())
    names = ["pre_funding_30m", "post_funding_30m", "funding_settle_bar"]
    return tidy(flags.select(*SERIES_KEYS, "ts_open_ms", "funding_minutes_to_next", *names))


@query
def window_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Months of the clipped rows with their bounds."""
    m = clip_window(minutes(spark, sf), "ts_open_ms", *CLIP)
    first, last = month_bounds("month_ms", *CLIP)
    months = m.groupBy("symbol", month_start_ms("ts_open_ms").alias("month_ms")).agg(F.count(F.lit(1)).alias("rows"))
    return months.withColumns({"first_ms": first, "last_ms": last, "month_utc": ms_to_iso("month_ms")})


@query
def trade_fees(spark: SparkSession, sf: str) -> DataFrame:
    """Fee and slippage of each order line, taker and maker."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    p = StudyParams().friction
    return tidy(
        x.select(
            "l_orderkey",
            "l_linenumber",
            trades.leg_fee(price, F.col("l_quantity"), p.taker_fee_side).alias("taker_fee"),
            trades.leg_fee(price, F.col("l_quantity"), p.maker_fee_side).alias("maker_fee"),
            trades.leg_slippage(price).alias("slippage"),
        ),
        12,
    )


@query
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Ids, times and names of each event."""
    t = tk.read_ticks(spark, sf)
    kind = F.concat(F.lit("EV_"), F.upper("symbol"))
    return t.select(
        "event_id",
        F.lit("1h").alias("timeframe"),
        "symbol",
        "ts_ms",
        F.when(F.col("k") % 5 == 0, F.lit("h+x")).otherwise(F.concat(F.lit("h+"), F.col("k").cast("string"))).alias("horizon"),
        kind.alias("kind"),
    ).select(
        "event_id",
        ms_to_iso("ts_ms").alias("iso"),
        iso_to_ms(ms_to_iso("ts_ms")).alias("back_ms"),
        horizon_bars("horizon").cast("long").alias("horizon_bars"),
        short_event("kind").alias("short_name"),
        event_id("symbol", "timeframe", F.col("kind"), "ts_ms").alias("hash_id"),
    )


# ---- joins ---------------------------------------------------------------------------------------------


@query
def asof_funding(spark: SparkSession, sf: str) -> DataFrame:
    ticks, b = market(spark, sf, ("1h", "5m"))
    # Every third settlement is missing, so some rates are too old.
    f = tk.funding_from_ticks(ticks).filter((F.col("ts_settle_ms") / F.lit(FUNDING_INTERVAL_MS)).cast("long") % 3 != 0)
    out = joins.asof_funding(b.select(*SERIES_KEYS, "ts_open_ms"), f)
    return tidy(out, 12)


@query
def asof_open_interest(spark: SparkSession, sf: str) -> DataFrame:
    ticks, b = market(spark, sf, ("1h", "5m"))
    return tidy(joins.asof_oi(b.select(*SERIES_KEYS, "ts_open_ms"), tk.oi_from_ticks(ticks), ttl_ms=15 * MINUTE_MS))


@query
def asof_crowding(spark: SparkSession, sf: str) -> DataFrame:
    ticks, b = market(spark, sf)
    return tidy(joins.asof_crowding(b.select(*SERIES_KEYS, "ts_open_ms"), tk.oi_from_ticks(ticks)))


@query
def bars_joined(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(joined(spark, sf).drop("mean_px", "bar_idx"), 8)


@query
def known_gap_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Bars that hold the time of a gap; the gaps are the events with k = 7."""
    ticks, b = market(spark, sf)
    gaps = ticks.filter(F.col("k") == 7).select("exchange", "symbol", F.col("ts_ms").alias("gap_ms"))
    return joins.mask_known_gaps(b.select(*SERIES_KEYS, "ts_open_ms"), gaps, F.lit(HOUR_MS), by=("exchange", "symbol"))


# ---- features, regimes, events, outcomes -----------------------------------------------------------------


@query
def features(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(ft.build_features(cut_lineage(joined(spark, sf)), timeframes=("1h",)))


@query
def feature_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ft.non_null_counts(study(spark, sf).features)


@query
def regime_labels(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(regimes.build_regimes(ft.build_features(cut_lineage(joined(spark, sf)), timeframes=("1h",))))


@query
def latest_regime(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(regimes.latest_regime(study(spark, sf).regimes))


@query
def detected_events(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(study(spark, sf).events, 8)


@query
def features_5m(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(ft.build_features(dense_joined(spark, sf), timeframes=("5m",)))


@query
def regime_labels_5m(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(dense_study(spark, sf).regimes)


@query
def detected_events_5m(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(dense_study(spark, sf).events, 8)


@query
def event_outcomes_5m(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(dense_study(spark, sf).outcomes)


@query
def event_leaderboard_5m(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(canonical_order(build_leaderboard(cut_lineage(dense_study(spark, sf).strong_outcomes))))


@query
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ev.event_counts(study(spark, sf).events, EVENT_TYPES)


@query
def event_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(study(spark, sf).outcomes)


@query
def event_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(canonical_order(build_leaderboard(stored_outcomes(spark, sf))))


@query
def shock_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: bars to z-score to first cross to outcomes to cells."""
    _, b = market(spark, sf, stored=True)
    return tidy(build_leaderboard(cut_lineage(shock_outcomes(b))))


@query
def forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    _, b = market(spark, sf, stored=True)
    return tidy(outcomes.forward_universe(b).drop("bar_idx"))


# ---- stability and selection -------------------------------------------------------------------------------


@query
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(stability.walk_forward(stored_outcomes(spark, sf), STABILITY))


def _tested(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Walk-forward and permutation rows of the same cells."""
    _, b = market(spark, sf, stored=True)
    cells = cut_lineage(stability.walk_forward(stored_outcomes(spark, sf), STABILITY))
    return cells, cut_lineage(stability.permutation_test(cells, outcomes.forward_universe(b), STABILITY))


@query
def permutation_setup(spark: SparkSession, sf: str) -> DataFrame:
    """What goes into the permutation test, and how many permutations were at least as extreme."""
    _, pm = _tested(spark, sf)
    return tidy(
        pm.select(
            *SERIES_KEYS, "event_type", "horizon", "n_complete", "n_perms", "n_universe", "obs_mean", "obs_net", "obs_net_maker",
            (F.col("verdict") == "INSUFFICIENT_N").alias("insufficient"),
            (F.round(F.col("p_value") * (F.col("n_perms") + 1)).cast("long") - 1).alias("n_extreme"),
        )
    )


@query
def permutation_test(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_tested(spark, sf)[1])


@query
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stability.stable_counts(*_tested(spark, sf))


@query
def research_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = selection.research_candidates(*_tested(spark, sf), SELECTION)
    return tidy(selection.ranked_candidates(found))


@query
def cross_symbol_candidates(spark: SparkSession, sf: str) -> DataFrame:
    wide = StabilityParams(p_pass=WIDE_P, p_pass_maker=WIDE_P)
    return tidy(selection.cross_symbol(selection.research_candidates(*_tested(spark, sf), SELECTION, wide), *PAIR))


@query
def pareto_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(selection.pareto(build_leaderboard(stored_outcomes(spark, sf)), *PAIR, SELECTION))


@query
def pareto_decision(spark: SparkSession, sf: str) -> DataFrame:
    return selection.pareto_decision(selection.pareto(build_leaderboard(stored_outcomes(spark, sf)), *PAIR, SELECTION))


@query
def top_cells_by_net(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(selection.top_by_net(build_leaderboard(stored_outcomes(spark, sf)), 30, SELECTION))


@query
def top_cells_by_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(selection.top_by_sharpe(build_leaderboard(stored_outcomes(spark, sf)), 12, SELECTION))


@query
def top_cells_by_maker_net(spark: SparkSession, sf: str) -> DataFrame:
    wf = stability.walk_forward(stored_outcomes(spark, sf), STABILITY)
    cols = [*SERIES_KEYS, "event_type", "horizon", "n_complete", "full_net", "full_net_maker", "verdict"]
    return tidy(selection.top_by_maker_net(wf, 20, SELECTION).select(*cols))


@query
def top_cells_by_p_value(spark: SparkSession, sf: str) -> DataFrame:
    cols = [*SERIES_KEYS, "event_type", "horizon", "n_complete", "p_value", "verdict"]
    return tidy(selection.top_by_p_value(_tested(spark, sf)[1], 20, SELECTION).select(*cols))


# ---- quality and audits -------------------------------------------------------------------------------------


@query
def series_quality(spark: SparkSession, sf: str) -> DataFrame:
    bucket = F.floor(F.col("event_id") / F.lit(32_768))
    return quality.series_quality(minutes(spark, sf), 30, ["event_id"], bucket)


@query
def funding_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.funding_quality(tk.funding_from_ticks(tk.read_ticks(spark, sf)), 30)


@query
def open_interest_quality(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(quality.oi_quality(tk.oi_from_ticks(tk.read_ticks(spark, sf))))


@query
def gap_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.gap_stats(minutes(spark, sf), ["exchange", "symbol"], "ts_open_ms", MINUTE_MS)


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """One "file" per symbol and day."""
    m = minutes(spark, sf)
    day = F.floor(F.col("ts_open_ms") / F.lit(DAY_MS)) * F.lit(DAY_MS)
    return m.withColumns({"dataset_id": F.lit("um_klines_1m"), "local_path": F.concat("symbol", F.lit("/"), day.cast("string"))})


def _integrity(spark: SparkSession, sf: str) -> DataFrame:
    bucket = F.floor(F.col("event_id") / F.lit(32_768))
    return integrity.file_integrity(
        _files(spark, sf), ["dataset_id", "symbol", "local_path"], "ts_open_ms", MINUTE_MS, ["event_id"], bucket
    )


@query
def file_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return _integrity(spark, sf)


@query
def manifest_rollup(spark: SparkSession, sf: str) -> DataFrame:
    errors = minutes(spark, sf).filter(F.col("k") == 99)
    return integrity.manifest_rollup(_integrity(spark, sf), errors)


@query
def refreshed_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest of all files, refreshed for those of even days."""
    files = _files(spark, sf)
    manifest = files.groupBy("dataset_id", "symbol", "local_path").agg(
        F.lit("").alias("start_timestamp_utc"),
        F.lit("").alias("end_timestamp_utc"),
        F.lit(0).cast("long").alias("row_count"),
        F.lit("archive").alias("source_type"),
        F.lit("a").alias("source_url"),
        F.lit("PENDING").alias("status"),
        F.lit("x").alias("notes"),
    )
    even = files.filter(F.floor(F.col("ts_open_ms") / F.lit(DAY_MS)) % 2 == 0)
    touched = even.groupBy("dataset_id", "symbol", "local_path").agg(
        ms_to_iso(F.min("ts_open_ms")).alias("start_timestamp_utc"),
        ms_to_iso(F.max("ts_open_ms")).alias("end_timestamp_utc"),
        F.count(F.lit(1)).alias("row_count"),
        F.lit("OK").alias("status"),
        F.lit("b").alias("source_url"),
        F.count_if(F.col("k") == 0).alias("inserted_count"),
    )
    return integrity.refresh_manifest(manifest, touched)


def _gap_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Series without repeated times, but for one whose month holds some; a part of what was returned is not usable."""
    m = minutes(spark, sf).select("symbol", "ts_open_ms", "value", "k", "event_id")
    stored = m.filter(F.col("k") % 10 != 0)
    flawed = F.col("symbol") == FLAWED
    clean = joins.dedupe_keep_first(stored.filter(~flawed), ["symbol", "ts_open_ms"], ["event_id"])
    series = clean.unionByName(stored.filter(flawed)).unionByName(stored.filter(flawed & (F.col("k") == 1)))
    recovered = m.filter(F.col("k") % 20 == 0).withColumn("usable", F.col("k") % 40 != 0)
    targets = m.filter(F.col("k") % 5 == 0).select("symbol", "ts_open_ms")
    return (
        series.select("symbol", "ts_open_ms", "value"),
        recovered.select("symbol", "ts_open_ms", "value", "usable", F.col("event_id").alias("payload_order")),
        targets,
    )


@query
def gap_fill_report(spark: SparkSession, sf: str) -> DataFrame:
    _, report = integrity.apply_gap_fill(*_gap_parts(spark, sf), ["symbol"], "ts_open_ms", usable="usable")
    return report


@query
def gap_filled_series(spark: SparkSession, sf: str) -> DataFrame:
    repaired, _ = integrity.apply_gap_fill(*_gap_parts(spark, sf), ["symbol"], "ts_open_ms", usable="usable")
    return tidy(repaired)


@query
def availability_flags(spark: SparkSession, sf: str) -> DataFrame:
    return pit.availability(sources(spark, sf), funding_times(spark, sf), GAPS_MS)


@query
def five_minute_dependency(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(pit.five_minute_dependency(pit.availability(sources(spark, sf), funding_times(spark, sf), GAPS_MS)))


@query
def price_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return pit.price_alignment(sources(spark, sf), GAPS_MS)


@query
def alignment_errors(spark: SparkSession, sf: str) -> DataFrame:
    return pit.alignment_errors(sources(spark, sf), GAPS_MS)


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    """Minute rows with flaws: another symbol, a late close, an open off the grid, no time."""
    m = minutes(spark, sf)
    k = F.col("k")
    opened = F.col("ts_open_ms") + F.when(k == 1, F.lit(17)).otherwise(F.lit(0))
    rows = m.select(
        F.lit("um_klines_1m").alias("dataset_id"),
        "symbol",
        F.when(k == 2, F.lit("other")).otherwise(F.col("symbol")).alias("row_symbol"),
        F.when(~k.isin(4, 6), opened).alias("open_ms"),
        (opened + F.when(k == 3, F.lit(60000)).otherwise(F.lit(59999))).alias("close_ms"),
        (~k.isin(4, 6)).alias("parsed"),
        (k == 6).alias("bad_file"),
        "event_id",
    )
    return pit.row_checks(rows, ["event_id"], F.floor(F.col("event_id") / F.lit(32_768)))


@query
def row_check_errors(spark: SparkSession, sf: str) -> DataFrame:
    errors = pit.row_errors(_audit(spark, sf))
    return errors.groupBy("dataset_id", "symbol", "timestamp_utc", "check_id", "error_type").agg(F.count(F.lit(1)).alias("errors"))


@query
def source_check_summary(spark: SparkSession, sf: str) -> DataFrame:
    return pit.source_summary(_audit(spark, sf))


@query
def check_summary(spark: SparkSession, sf: str) -> DataFrame:
    flags = pit.availability(sources(spark, sf), funding_times(spark, sf), GAPS_MS)
    return pit.check_summary(_audit(spark, sf), sources(spark, sf), flags, pit.five_minute_dependency(flags), GAPS_MS)


@query
def dataset_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Probe results from the documents: dataset by source, symbol by language."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    n, i = F.col("n_chars"), F.col("doc_id")
    probes = d.groupBy(F.col("source").alias("dataset_id"), F.col("lang").alias("symbol")).agg(
        F.bool_or(i % 3 == 0).alias("archive_2021"),
        F.bool_or(i % 5 == 0).alias("archive_2024"),
        F.bool_or(i % 7 == 0).alias("archive_latest"),
        F.bool_or(n % 11 == 0).alias("rest_2021"),
        F.bool_or(n % 13 == 0).alias("rest_2024"),
        F.bool_or(n % 17 == 0).alias("rest_latest"),
        F.count(F.lit(1)).alias("sample_rows"),
        F.bool_and(n > 0).alias("schema_ok"),
    )
    return integrity.dataset_tiers(probes, ["en", "de"])


@query
def history_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Class of each (dataset, user): recent and old rows from the events."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", ntz_to_ms("ts").alias("ts_ms"))
    names = [*integrity.LIMITED_HISTORY, *integrity.HEAVY_HISTORY, "um_klines_1m"]
    probes = e.groupBy("user_id").agg(
        F.count_if(F.col("ts_ms") >= 1706000000000).alias("recent_rows"),
        F.count_if(F.col("ts_ms") < 1704500000000).alias("old_rows"),
        F.when(F.bool_or(F.col("ts_ms") < 1704300000000), "YES").otherwise("NO").alias("archive_2021"),
    )
    probes = probes.withColumn("dataset_id", F.element_at(F.lit(names), (F.col("user_id") % len(names) + 1).cast("int")))
    approved, tier = integrity.history_class()
    return probes.select("dataset_id", "user_id", approved.alias("approved"), tier.alias("tier"))


# ---- signals and trades -----------------------------------------------------------------------------------------


@query
def lead_lag_signal(spark: SparkSession, sf: str) -> DataFrame:
    _, b = market(spark, sf)
    return tidy(sg.lead_lag_signal(b, *PAIR))


@query
def compression_breakout_signal(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = breakout_signals(spark, sf)
    return tidy(found.drop("strategy_id", "bar_idx"))


@query
def settlement_displacement_signal(spark: SparkSession, sf: str) -> DataFrame:
    _, b = market(spark, sf, ("5m",))
    return tidy(sg.settlement_displacement_signal(b))


@query
def close_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Four-hour bars from hourly closes, labelled by their end."""
    _, b = market(spark, sf)
    obs = b.select("exchange", "symbol", (F.col("ts_open_ms") + F.lit(HOUR_MS)).alias("ts_ms"), F.col("close").alias("value"))
    return tidy(sg.close_bars(obs, 4 * HOUR_MS, 4))


def _premium(spark: SparkSession, sf: str) -> DataFrame:
    ticks, b = market(spark, sf)
    end = F.col("ts_open_ms") + F.lit(HOUR_MS)
    premium = b.select("exchange", "symbol", end.alias("ts_ms"), (F.col("close") / F.col("mean_px") - 1.0).alias("value"))
    price = b.select("exchange", "symbol", (F.ceil(end / F.lit(4 * HOUR_MS)) * F.lit(4 * HOUR_MS)).alias("bar_end_ms")).distinct()
    gaps = spark.range(len(GAPS_MS)).select(F.element_at(F.lit(list(GAPS_MS)), (F.col("id") + 1).cast("int")).alias("gap_ms"))
    return sg.funding_premium_signal(
        price, premium, tk.funding_from_ticks(ticks), gaps, width_ms=4 * HOUR_MS, needed=4, funding_min=1e-4, premium_min=5e-3
    )


@query
def funding_premium_signal(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_premium(spark, sf), 12)


@query
def funding_zscore_signal(spark: SparkSession, sf: str) -> DataFrame:
    f = tk.funding_from_ticks(tk.read_ticks(spark, sf))
    return tidy(sg.funding_zscore_signal(f, 1.5, history=20))


@query
def signal_funnel(spark: SparkSession, sf: str) -> DataFrame:
    reasons = ("missing_premium", "known_gap", "incomplete_premium", "missing_funding", "no_condition")
    return sg.signal_funnel(_premium(spark, sf), "bar_end_ms", reasons)


@query
def maker_fills(spark: SparkSession, sf: str) -> DataFrame:
    _, b = market(spark, sf, stored=True)
    seg = cut(ensure_index(limit_orders(b), SERIES_KEYS, 32_768), SERIES_KEYS, "ts_open_ms", 32_768, after=1)
    out = seg.with_columns({"action": trades.maker_fill(seg)}).owned()
    return tidy(out.select(*SERIES_KEYS, "ts_open_ms", "side", "limit_price", "action"))


@query
def trade_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(trade_table(spark, sf).drop("signal_idx", "exit_idx"))


@query
def momentum_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Thousands of signals, so that every reason to skip one and every exit occurs."""
    found, bars = momentum_signals(spark, sf)
    return tidy(ledger.trade_ledger(found, bars, hold_bars=12, stop_frac=0.06).drop("signal_idx", "exit_idx"))


@query
def ledger_returns(spark: SparkSession, sf: str) -> DataFrame:
    taken = ledger.taken_trades(trade_table(spark, sf)).withColumn("quantity", F.lit(2.0))
    p = StudyParams().friction
    plain = trades.add_trade_returns(taken).withColumnRenamed("post_fee_pct", "post_fee_estimate_pct").drop("pre_fee_pct")
    exact = trades.add_exact_fees(plain, p.maker_fee_side, p.taker_fee_side)
    cols = ["pre_fee_pct", "post_fee_pct", "post_fee_estimate_pct", "full_friction_pct"]
    return tidy(exact.select("symbol", "signal_ts", *cols))


@query
def leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    return trades.leakage_audit(ledger.taken_trades(trade_table(spark, sf)))


@query
def daily_trade_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = tick_trades(spark, sf)
    per_trade = t.select("strategy_id", "date", F.col("pre_fee_pct").alias("pre_fee"), F.col("post_fee_pct").alias("post_fee"))
    equity = t.select("strategy_id", "date", F.col("trade_seq").alias("seq"), (F.col("value") + 100.0).alias("equity"))
    return tidy(trades.daily_summary(per_trade, equity), 9)


@query
def running_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    """Peak, drawdown and a latched stop over the closes of each series."""
    _, b = market(spark, sf)
    equity = b.select("exchange", "symbol", "ts_open_ms", F.col("close").alias("equity"))
    segment = F.floor(F.col("ts_open_ms") / F.lit(7 * DAY_MS))
    return tidy(trades.latched_stop(equity, ["exchange", "symbol"], "ts_open_ms", segment, stop=0.08))


@query
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(trades.run_totals(_small_trades(spark, sf)))


def _small_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Results scaled down so that compounding many of them stays in range."""
    return tick_trades(spark, sf).withColumns(
        {"pre_fee_pct": F.col("pre_fee_pct") / 100.0, "post_fee_pct": F.col("post_fee_pct") / 100.0}
    )


@query
def falsification_criteria(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(trades.falsification(_small_trades(spark, sf), pre_fee_floor=0.001))


def _mc_trades(spark: SparkSession, sf: str) -> DataFrame:
    """Daily results per strategy: a path a simulation can draw from at any scale."""
    t = tick_trades(spark, sf)
    return t.groupBy("strategy_id", F.datediff("date", F.lit("2024-01-01").cast("date")).cast("long").alias("trade_seq")).agg(
        F.avg("post_fee_pct").alias("pnl_pct")
    )


@query
def monte_carlo_paths(spark: SparkSession, sf: str) -> DataFrame:
    r = montecarlo.trade_returns(_mc_trades(spark, sf))
    modes = [montecarlo.simulate_equity(r, mode=m).withColumn("mode", F.lit(m)) for m in ("bootstrap", "shuffle")]
    return tidy(modes[0].unionByName(modes[1]))


@query
def monte_carlo_verdict(spark: SparkSession, sf: str) -> DataFrame:
    r = montecarlo.trade_returns(_mc_trades(spark, sf))
    counts = r.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("trades"))
    return tidy(montecarlo.monte_carlo_summary(montecarlo.simulate_equity(r), counts, min_trades=20))


@query
def path_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of given paths: a path per (strategy, day), from the ticks of that day."""
    t = tick_trades(spark, sf)
    paths = t.groupBy("strategy_id", F.col("date").alias("sim")).agg(
        (F.lit(200.0) + F.sum("post_fee_pct")).alias("final_equity"), F.max("value").alias("max_drawdown_pct")
    )
    counts = t.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("trades"))
    return tidy(montecarlo.monte_carlo_summary(paths, counts))


# ---- run exports ----------------------------------------------------------------------------------------------


def _run_files(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    names = [*runs.PRIMARY_FILES, *runs.SECONDARY_FILES, "notes.md"]
    pick = F.element_at(F.lit(names), (F.pmod(F.col("conv_id") + F.col("turn") * 5, F.lit(len(names))) + 1).cast("int"))
    return c.select(F.col("conv_id").cast("string").alias("run_id"), pick.alias("file_name")).distinct()


@query
def run_evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = runs.evidence(_run_files(spark, sf))
    return e.select(
        "run_id",
        F.concat_ws(",", "present_files").alias("present_files"),
        F.concat_ws(",", "missing_files").alias("missing_files"),
        "evidence_confidence",
    )


def _run_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of two sources per order: one leaf for each line."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    label = F.element_at(
        F.lit(["statistics.sharpe ratio", "total trades", "drawdown", "stats.win rate", "netprofit", "other"]),
        (F.pmod(F.col("l_partkey"), F.lit(6)) + 1).cast("int"),
    )
    return x.select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        (F.col("l_suppkey") % 2).alias("source_rank"),
        label.alias("path"),
        F.concat(F.lit("$"), F.floor(F.col("l_quantity") * 10).cast("string")).alias("value"),
        (F.col("l_linenumber") * 10**12 + F.col("l_partkey") * 10**5 + F.floor(F.col("l_quantity") * 10)).alias("pos"),
    )


@query
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return runs.resolve_metrics(_run_leaves(spark, sf))


@query
def run_reports(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("run_id"), "l_linenumber", "l_partkey")
    names = [*runs.PRIMARY_FILES, *runs.SECONDARY_FILES]
    files = x.select("run_id", F.element_at(F.lit(names), (F.pmod("l_partkey", F.lit(8)) + 1).cast("int")).alias("file_name"))
    counts = x.filter(F.col("l_linenumber") > 4).groupBy("run_id").agg((F.count(F.lit(1)) * 40).alias("trades"))
    report = runs.run_report(files, _run_leaves(spark, sf), counts)
    return report.select(
        "run_id", F.concat_ws(",", "present_files").alias("present_files"), "evidence_confidence", "total_trades", "sharpe",
        "max_drawdown", "win_rate", "net_return", "verdict", "reason",
    )


@query
def trade_file_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The orders as trade files of 25 runs, one CSV record each: quoted cells with line breaks, quotes in and
    behind quoted cells, quotes inside plain ones, and blank records."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    cells = [
        F.format_string('%d,%s,"%s,\nnext ""line""\n"', key, state, "o_orderpriority"),
        F.lit(""),
        F.format_string('%d,a"b,%s"', key, state),
        F.format_string('"%d"x"y,"",%s', key, state),
        F.format_string('%d,"\n\n",""""', key),
        F.format_string("%d,%s,plain", key, state),
    ]
    row = F.element_at(F.array(*cells), (F.pmod(key, F.lit(len(cells))) + 1).cast("int"))
    run = F.concat(F.lit("BT"), F.lpad(F.pmod("o_custkey", F.lit(25)).cast("string"), 4, "0"))
    rows = o.select(run.alias("run"), key.alias("pos"), row.alias("line"))
    heads = rows.select("run").distinct().select("run", F.lit(-1).cast("long").alias("pos"), F.lit('id,state,"note"').alias("line"))
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    filed = rows.unionByName(heads).repartition("run").sortWithinPartitions("run", "pos").select("run", "line")
    filed.write.partitionBy("run").text(path)
    counts = runs.trade_counts(spark, path, "*.txt")
    verdict, _ = runs.draft_verdict(F.lit("OK"), F.col("trades"))
    return counts.select(F.replace("run_id", F.lit("run="), F.lit("")).alias("run_id"), "trades", verdict.alias("verdict"))


@query
def run_trade_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each customer as the trades of a run, with the draft verdict."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    n = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("trades"))
    verdict, reason = runs.draft_verdict(F.lit("OK"), F.col("trades") * 10)
    return n.select("o_custkey", "trades", verdict.alias("verdict"), reason.alias("reason"))


@query
def experiments_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Registry of all orders; those of the lines with quantity above 45 are replaced."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    old = o.select(F.col("o_orderkey").cast("string").alias("backtest_id"), F.col("o_orderstatus").alias("verdict"))
    new = x.filter(F.col("l_quantity") > 45).groupBy((F.col("l_orderkey") + 7).cast("string").alias("backtest_id")).agg(
        F.lit("NEW").alias("verdict")
    )
    return runs.upsert_experiments(old, new)


def _supplier_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A run per supplier with all columns of the registry; a line of an order is a leaf of its supplier's run."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    n = spark.read.parquet(f"{sf}/nation.parquet")
    four = F.lpad(F.col("s_suppkey").cast("string"), F.greatest(F.length(F.col("s_suppkey").cast("string")), F.lit(4)), F.lit("0"))
    # Numbers of five digits and every tenth run have folders that name no run.
    folder = F.when((F.length(four) == 4) & (F.col("s_suppkey") % 10 != 7), F.concat(F.lit("BT"), four, F.lit("_export")))
    run = F.coalesce(folder, F.concat(F.lit("raw"), four))
    who = s.select("s_suppkey", "s_nationkey", "s_acctbal", run.alias("run_id"), F.concat(F.lit("H"), four).alias("hypothesis_id"))
    metric = [f"Stats.{a[0]}".lower() for a in runs.METRIC_ALIASES.values()]
    lines = x.join(who, F.col("l_suppkey") == F.col("s_suppkey"))
    leaves = lines.select(
        "run_id",
        (F.col("l_linenumber") % 2).alias("source_rank"),
        F.element_at(F.lit(metric), (F.pmod("l_partkey", F.lit(len(metric))) + 1).cast("int")).alias("path"),
        F.floor(F.col("l_quantity") * 100).cast("string").alias("value"),
        (F.col("l_orderkey") * 10**7 + F.col("l_linenumber") * 10**6 + F.floor(F.col("l_quantity") * 100)).alias("pos"),
    )
    names = [*runs.PRIMARY_FILES, *runs.SECONDARY_FILES]
    last = (F.pmod(F.col("s_suppkey") + F.col("s_nationkey"), F.lit(len(names))) + 1).cast("int")
    files = who.select("run_id", F.element_at(F.lit(names), last).alias("file_name"))
    counts = lines.filter(F.col("s_suppkey") % 4 != 1).groupBy("run_id").agg(F.count_if(F.col("l_quantity") > 25).alias("trades"))
    day = F.to_date(F.date_add(F.lit("2024-01-01").cast("date"), F.col("s_nationkey"))).cast("string")
    info = who.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "run_id",
        "hypothesis_id",
        F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("strategy_id"),
        day.alias("date"),
        F.col("n_name").alias("symbols"),
        F.when(F.col("s_suppkey") % 2 == 0, "5m").alias("timeframe"),
        F.concat(F.lit(" "), day, F.lit(" : "), day, F.lit(":x")).alias("is_window"),
        F.when(F.col("s_acctbal") > 0, F.concat(day, F.lit(":"))).otherwise("none").alias("oos_window"),
        F.concat(F.lit("runs/"), F.col("run_id")).alias("artifacts_path"),
    )
    return runs.registry_rows(runs.run_report(files, leaves, counts), info)


@query
def registry_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _supplier_reports(spark, sf)


@query
def experiments_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Three commits to a versioned registry of 25 columns: runs of two suppliers in three as an older draft, half of all
    runs, and a run of the first half again with another verdict."""
    rows = cut_lineage(_supplier_reports(spark, sf))
    number = F.regexp_replace("hypothesis_id", "^H", "").cast("long")
    root = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    draft = rows.filter(number % 3 != 0).withColumns({"verdict": F.lit("OLD"), "reason": F.lit("")})
    runs.upsert_registry(spark, root, draft)
    runs.upsert_registry(spark, root, rows.filter(number % 2 == 0))
    runs.upsert_registry(spark, root, rows.filter(number % 6 == 2).withColumn("verdict", F.lit("REVIEWED")))
    return read_version(spark, root)


# ---- streams ---------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select(
        F.lit(tk.EXCHANGE).alias("exchange"),
        F.col("event_type").alias("symbol"),
        "event_id",
        ntz_to_ms("ts").alias("ts_ms"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


@query
def stream_close_bars(spark: SparkSession, sf: str) -> DataFrame:
    s = _stream(spark, sf)
    return tidy(st.run_to_end(spark, s, "ts_ms", lambda x: st.stream_close_bars(x, minutes=60, needed=3)))


@query
def stream_daily_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = _stream(spark, sf).select(
        F.col("symbol").alias("strategy_id"),
        F.col("ts_ms").alias("exit_ms"),
        ((F.col("value") - 45.0) / 50.0).alias("pre_fee"),
        ((F.col("value") - 45.0) / 50.0 - 0.08).alias("post_fee"),
    )
    return tidy(st.run_to_end(spark, s, "exit_ms", st.stream_daily_summary), 9)


@query
def stream_latest_funding(spark: SparkSession, sf: str) -> DataFrame:
    """Events with k below 5 are settlements, the others bars."""
    s = _stream(spark, sf)
    rate = F.when(F.col("k") < 5, (F.col("value") - 50.0) / 20000.0)
    mixed = s.select("exchange", "symbol", "ts_ms", rate.alias("funding_rate"))
    out = st.with_state_store(spark, lambda: st.run_available(spark, st.stream_latest_funding(mixed)))
    return tidy(out, 9)


@query
def stream_funding_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Every event a settlement; repeats of a time are ignored."""
    s = _stream(spark, sf).select("exchange", "symbol", F.col("ts_ms").alias("ts_settle_ms"), F.col("value").alias("funding_rate"))
    out = st.with_state_store(spark, lambda: st.run_available(spark, st.stream_funding_signal(s, history=90, z_min=1.5)))
    return tidy(out)


@query
def stream_first_cross(spark: SparkSession, sf: str) -> DataFrame:
    s = _stream(spark, sf).select("exchange", "symbol", "ts_ms", (F.col("value") > 60).alias("cond"))
    return st.with_state_store(spark, lambda: st.run_available(spark, st.stream_first_cross(s)))


@query
def stream_stop_latch(spark: SparkSession, sf: str) -> DataFrame:
    s = _stream(spark, sf).select(F.col("symbol").alias("strategy_id"), F.col("event_id").alias("seq"), (F.col("value") + 1000.0).alias("equity"))
    out = st.with_state_store(spark, lambda: st.run_available(spark, st.stream_stop_latch(s, stop=0.08)))
    return tidy(out)


@query
def stream_match_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Even events are price bars, those with k below 50 premium bars of the same minute."""
    s = _stream(spark, sf)
    minute = F.floor(F.col("ts_ms") / F.lit(MINUTE_MS)) * F.lit(MINUTE_MS)
    price = s.filter(F.col("event_id") % 2 == 0).select("exchange", "symbol", minute.alias("bar_end_ms"), "event_id")
    premium = _stream(spark, sf).filter(F.col("k") < 50).select(
        "exchange", "symbol", minute.alias("bar_end_ms"), F.col("value").alias("premium_delta"), (F.col("k") > 3).alias("complete")
    )
    return tidy(st.run_available(spark, st.stream_match_bars(price, premium)))


@query
def stream_drop_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Hours with an event: the first one of each hour stays."""
    s = _stream(spark, sf)
    hour = F.floor(F.col("ts_ms") / F.lit(HOUR_MS)) * F.lit(HOUR_MS)
    once = st.stream_drop_repeats(s.select("exchange", "symbol", hour.alias("ts_settle_ms")))
    return st.with_state_store(spark, lambda: st.run_available(spark, once))
