"""Readers, audits, repairs, run exports."""

from __future__ import annotations

import csv
import gzip
import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.scalars import iso_to_ms, month_bounds, months_between, ms_to_iso, run_id_from_folder, split_window
from tidegrid.operators import integrity, pit, quality, runs
from tidegrid.params import MINUTE_MS, SegmentParams
from tidegrid.sources import archives as ar
from tidegrid.sources import tables, versions
from tidegrid.sources.schemas import TIER1, TIER1_FUNDING, TIER1_KLINES

KLINE = "{t},1,3,0.5,2,10,{c},20,7,4,8,0"
T0 = 1_704_067_200_000


def kline(i, step=MINUTE_MS):
    return KLINE.format(t=T0 + i * step, c=T0 + (i + 1) * step - 1)


def test_klines_with_and_without_header(spark, tmp_path):
    for sym, head in (("A", ["open_time,open,high,low,close,volume,close_time,q,n,b,bq,i"]), ("B", [])):
        d = tmp_path / "k" / f"symbol={sym}" / "timeframe=1m"
        d.mkdir(parents=True)
        (d / "a.csv").write_text("\n".join([*head, kline(0), "1,2,3", kline(1)]) + "\n")
    got = ar.read_klines(spark, str(tmp_path / "k"), exchange="x").toPandas().sort_values(["symbol", "ts_open_ms"])
    assert got.symbol.tolist() == ["A", "A", "B", "B"] and got.ts_open_ms.tolist()[:2] == [T0, T0 + MINUTE_MS]
    row = got.iloc[0]
    assert (row.close, row.volume_base, row.volume_quote, row.trades, row.taker_buy_base, row.taker_buy_quote) == (2, 10, 20, 7, 4, 8)
    mark = ar.read_price_klines(spark, str(tmp_path / "k"), "mark", exchange="x").first()
    assert mark.mark_close == 2.0 and mark.ts_close_ms == mark.ts_open_ms + 59_999


def test_funding_and_metrics(spark, tmp_path):
    f = tmp_path / "f.csv"
    f.write_text("calc_time,funding_interval_hours,last_funding_rate\n1000,8.0,0.0001\n2000,4,-0.2\n")
    got = ar.read_funding(spark, str(f), "x", "A").toPandas().sort_values("ts_settle_ms")
    assert got.funding_interval_ms.tolist() == [28_800_000, 14_400_000] and got.predicted_funding_rate.isna().all()
    m = tmp_path / "m.csv"
    m.write_text(
        "create_time,symbol,sum_open_interest,sum_open_interest_value,count_toptrader_long_short_ratio,sum_toptrader_long_short_ratio,count_long_short_ratio,sum_taker_long_short_vol_ratio\n"
        "2024-01-01 00:05:00,A,1,2,3,4,5,6\n2024-01-01 00:10:00,A, ,2,NaN,4,5,\n"
    )
    got = ar.read_oi_metrics(spark, str(m), "x").toPandas().sort_values("ts_ms")
    assert got.ts_ms.tolist() == [T0 + 300_000, T0 + 600_000]
    a, b = got.iloc[0], got.iloc[1]
    assert (a.oi_base, a.long_short_account_ratio, a.top_trader_account_ratio, a.top_trader_position_ratio) == (1, 5, 3, 4)
    assert b[["oi_base", "top_trader_account_ratio", "taker_long_short_vol_ratio"]].isna().all()


def test_normalized_archives_and_payloads(spark, tmp_path):
    d = tmp_path / "a" / "symbol=A"
    d.mkdir(parents=True)
    (d / "x.csv").write_text("open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore\n" + kline(0) + "\n")
    got = ar.normalize_archive(spark, str(tmp_path / "a"), "um_klines_1m", "now")
    assert tuple(got.columns) == TIER1_KLINES
    r = got.first()
    assert (r.timestamp_open_utc, r.timestamp_close_utc, r.symbol, r.trade_count) == ("2024-01-01T00:00:00.000Z", "2024-01-01T00:00:59.999Z", "A", "7")
    assert r.source.endswith("x.csv")
    body = json.dumps([json.loads(f"[{kline(0)}]"), [1, 2, 3], json.loads(f"[{kline(1)}]")])
    payload = spark.createDataFrame([("A", "u", body)], "symbol string, source string, body string")
    good, bad = ar.normalize_rest(payload, "mark_price_klines", "now")
    assert good.count() == 2 and bad.count() == 1
    body = json.dumps([{"fundingTime": 1000, "fundingRate": "0.1"}, {"fundingTime": 2000, "fundingRate": "0.2", "markPrice": "5"}])
    good, bad = ar.normalize_rest(spark.createDataFrame([("A", "u", body)], "symbol string, source string, body string"), "funding_rate_history", "now")
    assert [r.mark_price_at_funding for r in good.orderBy("timestamp_utc").collect()] == ["", "5"] and bad.count() == 0


def _tier1(root, dataset, sym, rows, name="p", header=None):
    d = root / dataset / f"symbol={sym}"
    d.mkdir(parents=True, exist_ok=True)
    with gzip.open(d / f"{name}.csv.gz", "wt") as f:
        f.write("\n".join([",".join(header or TIER1[dataset]), *rows]) + "\n")


def _price(i, sym="A", close=59_999, shift=0):
    from datetime import UTC, datetime

    iso = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    t = T0 + i * MINUTE_MS + shift
    return f"{iso(t)},{iso(t + close)},{sym},1,1,1,1,s,now"


def test_audit_of_files(spark, tmp_path):
    d = "mark_price_klines"
    _tier1(tmp_path, d, "A", [_price(0), _price(1), _price(1), _price(3, sym="B"), _price(2), _price(4, close=60_000), _price(5, shift=7), "x,y,A,1,1,1,1,s,now"])
    _tier1(tmp_path, d, "A", ["1,2"], "q", header=["foo", "bar"])
    path = str(tmp_path / d)
    report = {r.file_path[-8:]: r.schema_ok for r in ar.schema_report(spark, path, d).collect()}
    assert report == {"p.csv.gz": True, "q.csv.gz": False}
    rows = ar.audit_rows(ar.scan_tier1(spark, path, d))
    whole = pit.row_checks(rows, list(ar.PHYSICAL), ar.physical_bucket(), SegmentParams(rows=2))
    assert [(r.check_id, r.error_type, r.timestamp_utc) for r in pit.row_errors(whole).filter("error_type = 'SCHEMA_FAIL'").collect()] == [("PIT_SCHEMA_BAR", "SCHEMA_FAIL", None)]
    s = pit.source_summary(whole).first()
    assert (s.rows_checked, s.failures, s.min_ms) == (8, 8, T0)
    rows = ar.audit_rows(ar.read_tier1(spark, path, d), d)
    checked = pit.row_checks(rows, list(ar.PHYSICAL), ar.physical_bucket(), SegmentParams(rows=2))
    errors = sorted(r.error_type for r in pit.row_errors(checked).collect())
    assert errors == sorted(["DUPLICATE_TIMESTAMP", "NON_MONOTONIC", "SYMBOL_MISMATCH", "NON_MONOTONIC", "CLOSE_TIME_FAIL", "OPEN_ALIGNMENT_FAIL", "TIMESTAMP_PARSE_FAIL"])
    s = pit.source_summary(checked).first()
    assert (s.rows_checked, s.failures, s.min_ms) == (8, 7, T0)


def test_header_lines_and_blocks(spark, tmp_path):
    """A header that stands there again is a row; of a file in several blocks the first line is the header of all."""
    d = "mark_price_klines"
    folder = tmp_path / "symbol=A"
    folder.mkdir()
    head = ",".join(TIER1["mark_price_klines"])
    (folder / "p.csv").write_text("\n".join([head, *[_price(i) for i in range(300)], head, "", _price(300), "short"]) + "\n")
    (folder / "empty.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scan = ar.scan_tier1(spark, str(tmp_path), d)
        checked = pit.row_checks(ar.audit_rows(scan), list(ar.PHYSICAL), ar.physical_bucket())
        s = pit.source_summary(checked).first()
        assert (s.rows_checked, s.failures) == (303, 2) and scan.rows.select("block_start").distinct().count() > 3
        assert {r.error_type for r in pit.row_errors(checked).collect()} == {"TIMESTAMP_PARSE_FAIL"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_audit_of_funding(spark, tmp_path):
    _tier1(tmp_path, "funding_rate_history", "B", ["1,2"], "q", header=["foo", "bar"])
    rows = ["2024-01-01T00:00:00.000Z,A,0.1,,s,now", "2024-01-01T08:00:00.000Z,A,oops,,s,now", "2024-01-01T16:00:00.000Z,A,0.1,7,s,now"]
    _tier1(tmp_path, "funding_rate_history", "A", rows)
    t = ar.read_tier1(spark, str(tmp_path / "funding_rate_history"), "funding_rate_history")
    checked = pit.row_checks(ar.audit_rows(t, "funding_rate_history"), list(ar.PHYSICAL), ar.physical_bucket())
    assert [r.error_type for r in pit.row_errors(checked).collect()] == ["FUNDING_PARSE_FAIL"]
    scan = ar.scan_tier1(spark, str(tmp_path / "funding_rate_history"), "funding_rate_history")
    found = pit.row_errors(pit.row_checks(ar.audit_rows(scan), list(ar.PHYSICAL), ar.physical_bucket()))
    assert {(r.symbol, r.check_id) for r in found.collect()} == {("A", "PIT_FUNDING_TIMESTAMP"), ("B", "PIT_SCHEMA_FUNDING")}
    assert len(TIER1_FUNDING) == 6


def test_availability(spark):
    names = ["um_klines_1m", *pit.PRICE_DATASETS]
    rows = [(d, "A", m * MINUTE_MS) for d in names for m in range(10) if not (d == "mark_price_klines" and m == 7)]
    rows.append(("index_price_klines", "A", 99 * MINUTE_MS))
    times = spark.createDataFrame(rows, "dataset_id string, symbol string, ts_ms long")
    funding = spark.createDataFrame([("A", 2 * MINUTE_MS)], "symbol string, ts_ms long")
    gaps = (7 * MINUTE_MS,)
    flags = pit.availability(times, funding, gaps).toPandas().sort_values("ts_ms")
    assert flags.no_signal_required.tolist() == [i == 7 for i in range(10)]
    assert flags.funding_available_after_timestamp.tolist() == [i >= 2 for i in range(10)]
    bars = pit.five_minute_dependency(pit.availability(times, funding, gaps)).toPandas().sort_values("bar_5m_ms")
    assert bars.complete_for_price_state_features.tolist() == [True, False]
    a = {r.dataset_id: r for r in pit.price_alignment(times, gaps).collect()}
    assert a["mark_price_klines"].failures == 0 and a["mark_price_klines"].expected_missing == 1
    assert a["index_price_klines"].unexpected_extra == 1
    assert [r.error_type for r in pit.alignment_errors(times, gaps).collect()] == ["PRICE_STATE_EXTRA_TIMESTAMP"]
    assert {r.error_type for r in pit.alignment_errors(times).collect()} == {"PRICE_STATE_EXTRA_TIMESTAMP", "UNEXPECTED_MISSING_PRICE_STATE"}


def test_file_integrity(spark):
    data = {"ok": [0, 1, 2], "dup": [0, 1, 1], "order": [0, 2, 1], "gap": [0, 3], "bad": []}
    rows = [(f, i, m * MINUTE_MS) for f, ms in data.items() for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "f string, pos long, ts long")
    schemas = spark.createDataFrame([(f, f != "bad", "a,b") for f in [*data, "empty"]], "f string, schema_ok boolean, observed_schema_fields string")
    got = integrity.file_integrity(df, ["f"], "ts", MINUTE_MS, ["pos"], F.floor(F.col("pos") / 2), schemas, SegmentParams(rows=2)).toPandas().set_index("f")
    assert got.status.to_dict() == {"ok": "OK", "dup": "INTEGRITY_FAIL", "order": "INTEGRITY_FAIL", "gap": "INTEGRITY_FAIL", "bad": "SCHEMA_FAIL", "empty": "INTEGRITY_FAIL"}
    assert got.loc["gap", "missing_rows"] == 2 and got.loc["dup", "duplicate_rows"] == 1 and not got.loc["order", "timestamp_monotonic"]
    assert got.loc["bad", "notes"] == "observed_fields=a,b" and got.loc["empty", "timestamp_monotonic"]
    loose = quality.monotonic(df, ["f"], "ts", ["pos"], F.floor(F.col("pos") / 2), strict=False, segments=SegmentParams(rows=1)).toPandas().set_index("f")
    assert loose.timestamp_monotonic.to_dict() == {"ok": True, "dup": True, "order": False, "gap": True}
    roll = integrity.manifest_rollup(got.reset_index()[["f", "status"]].pipe(spark.createDataFrame), spark.createDataFrame([], "x int")).first()
    assert (roll.manifest_rows, roll.non_ok_manifest_rows, roll.status) == (6, 5, "PARTIAL_OR_FAILED")


def test_series_quality(spark):
    times = [0, 2, 1, 1, 3]
    df = spark.createDataFrame([("x", "A", "1h", t * 3_600_000, i) for i, t in enumerate(times)], "exchange string, symbol string, timeframe string, ts_open_ms long, pos long")
    bucket = F.floor(F.col("pos") / 2)
    q = quality.series_quality(df, 1, ["pos"], bucket, SegmentParams(asof_bucket_ms=3_600_000)).first()
    # Stored 0 2 1 1 3 against sorted 0 1 1 2 3: positions 1 and 3 differ.
    assert (q.expected_bars, q.received_bars, q.deduped_bars, q.missing_bars, q.duplicate_bars, q.out_of_order_rows, q.status) == (24, 5, 4, 20, 1, 2, "red")
    assert quality.series_quality(df, 1, ["pos"], bucket, window=(0, 3_600_000)).first().received_bars == 3


def test_gap_stats_and_open_interest(spark):
    df = spark.createDataFrame([("A", t * MINUTE_MS) for t in [0, 1, 1, 5, 6]], "k string, t long")
    g = quality.gap_stats(df, ["k"], "t", MINUTE_MS, SegmentParams(asof_bucket_ms=2 * MINUTE_MS)).first()
    assert (g.expected, g.missing, g.duplicates) == (7, 3, 1)
    oi = spark.createDataFrame([("x", "A", 0), ("x", "A", 600_000), ("x", "B", 5)], "exchange string, symbol string, ts_ms long")
    got = {r.symbol: r.oi_gap_max_minutes for r in quality.oi_quality(oi).collect()}
    assert got == {"A": 10.0, "B": None}


def test_gap_fill(spark):
    series = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0)], "s string, t long, v double")
    back = spark.createDataFrame([("A", 2, 9.0), ("A", 3, 3.0), ("A", 7, 7.0), ("B", 3, 1.0)], "s string, t long, v double")
    want = spark.createDataFrame([("A", 2), ("A", 3), ("A", 4), ("B", 3)], "s string, t long")
    bad = spark.createDataFrame([("B",)], "s string")
    fixed, report = integrity.apply_gap_fill(series, back, want, ["s"], "t", bad)
    assert sorted((r.t, r.v) for r in fixed.collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert {(r.s, r.t): r.target_status for r in report.collect()} == {("A", 2): "ALREADY_PRESENT", ("A", 3): "RECOVERED", ("A", 4): "NOT_RETURNED", ("B", 3): "SCHEMA_FAIL"}
    fixed, twice = integrity.apply_gap_fill(series.unionAll(series.limit(1)), back, want, ["s"], "t", bad)
    assert {r.t: (r.target_status, r.inserted) for r in twice.filter("s = 'A'").collect()}[3] == ("VALIDATION_FAIL", False)
    assert sorted(r.t for r in fixed.collect()) == [1, 1, 2]
    month = 31 * 86_400_000  # a flawed month does not hold up the next one
    later = spark.createDataFrame([("A", month + 3, 5.0, 1, True), ("A", month + 4, 6.0, 1, True), ("A", month + 4, 7.0, 2, False), ("A", 3, 3.0, 1, True)], "s string, t long, v double, payload_order long, ok boolean")
    fixed, split = integrity.apply_gap_fill(series.unionAll(series.limit(1)), later, later.select("s", "t"), ["s"], "t", usable="ok")
    assert {r.t - month: r.target_status for r in split.collect()} == {3 - month: "VALIDATION_FAIL", 3: "RECOVERED", 4: "VALIDATION_FAIL"}
    assert sorted((r.t, r.v) for r in fixed.collect()) == [(1, 1.0), (1, 1.0), (2, 2.0), (month + 3, 5.0)]
    ok = spark.createDataFrame([("OK",)], "status string")
    r = integrity.gap_rollup(report, ok).first()
    assert (r.inserted, r.unresolved, r.status) == (1, 2, "PARTIAL")


def test_feeds(spark, tmp_path):
    f = tmp_path / "f.csv"
    f.write_text("timestamp_utc,symbol,funding_rate,m,s,i\n2024-01-01T00:00:00Z,A,0.1,,s,i\n2024-01-01T08:00:00Z,A,x,1,s,i\n1,2\n" + "z" * 300 + "\n")
    good, bad, report = ar.read_custom_feed(spark, str(f), "funding")
    assert good.count() == 1 and good.first().mark_price_at_funding == 0.0
    got = bad.collect()
    assert sorted(r.reason for r in got) == ["column_count", "column_count", "parse_error"] and max(len(r.line_snippet) for r in got) == 180
    r = report.first()
    assert (r.good_rows, r.parse_error_count, r.valid) == (1, 3, False)
    p = tmp_path / "p.csv"
    p.write_text("timestamp_open_utc,b,c,d,e,f,g,h,i\n" + _price(0) + "\n")
    good, bad, report = ar.read_custom_feed(spark, str(p), "premium")
    assert report.first().valid and good.first().ts_close_ms == T0 + 59_999


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("x", "A", "1h", 1), ("x", "B", "1h", 2)], "exchange string, symbol string, timeframe string, ts_open_ms long")
    tables.write_table(df, str(tmp_path), "bars")
    tables.write_table(df.filter("symbol = 'A'").withColumn("ts_open_ms", F.lit(5).cast("long")), str(tmp_path), "bars")
    got = tables.read_series(spark, str(tmp_path), "bars", with_position=True)
    assert sorted((r.symbol, r.ts_open_ms) for r in got.collect()) == [("A", 5), ("B", 2)]
    clipped = tables.clip_window(tables.read_series(spark, str(tmp_path), "bars"), "ts_open_ms", 3, 9)
    assert clipped.count() == 1
    plan = clipped._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts_open_ms), GreaterThanOrEqual(ts_open_ms,3)" in plan
    tables.write_report_csv(df.withColumn("ok", F.lit(True)), str(tmp_path / "r"), ["symbol", "ok"])
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().ok == "TRUE"
    f = spark.createDataFrame([("x", "A", 1000, 0.5, 1), ("x", "A", 1000, 0.7, 0), ("x", "A", 0, 0.1, 2)], "exchange string, symbol string, ts_settle_ms long, funding_rate double, pos long")
    tables.export_funding_csv(f, str(tmp_path / "f"), ["pos"])
    got = spark.read.option("header", True).csv(str(tmp_path / "f")).collect()
    assert sorted((r.timestamp_utc, r.funding_rate) for r in got) == [("1970-01-01T00:00:00.000Z", "0.1"), ("1970-01-01T00:00:01.000Z", "0.7")]


def test_checksums(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello")
    r = ar.file_checksums(spark, str(tmp_path)).first()
    assert (r.bytes, r.sha256) == (5, hashlib.sha256(b"hello").hexdigest())


# ---- run exports ----------------------------------------------------------------------------------


def test_runs(spark, tmp_path):
    stats = {"Total": {"Sharpe Ratio": 1.5, "list": [{"Net Profit": "10%"}], "none": None}, "Drawdown": "5%"}
    a, b, c = (tmp_path / n for n in ("BT0001_x", "BT0002_x", "BT0003_x"))
    for d in (a, b, c):
        d.mkdir()
    (a / "statistics.json").write_text(json.dumps(stats))
    (a / "statistics.txt").write_text("Sharpe Ratio: 9.9\nWin Rate\t55%\nTotal Trades: $1,234\nnot a label line\n")
    (b / "overview.png").write_bytes(b"png")
    (c / "trades.csv").write_text("h\n1\n2\n")
    path = str(tmp_path)
    flat = runs.flatten_run_json(runs.read_run_texts(spark, path, "statistics.json"))
    assert {r.path: r.value for r in flat.collect()} == {"total.sharpe ratio": "1.5", "total.list[0].net profit": "10%", "total.none": "None", "drawdown": "5%"}
    text = runs.parse_run_text(runs.read_run_texts(spark, path, "statistics.txt"))
    assert {r.path: r.value for r in text.collect()} == {"sharpe ratio": "9.9", "win rate": "55%", "total trades": "$1,234"}
    leaves = flat.withColumn("source_rank", F.lit(0)).unionByName(text.withColumn("source_rank", F.lit(1)))
    report = runs.run_report(runs.run_files(spark, path), leaves, runs.trade_counts(spark, path))
    got = {r.run_id: r for r in report.collect()}
    assert got["BT0001_x"].sharpe == "1.5" and got["BT0001_x"].win_rate == "55%" and got["BT0001_x"].verdict == "READY_FOR_REVIEW"
    assert got["BT0002_x"].evidence_confidence == "LOW_CONFIDENCE" and got["BT0002_x"].verdict == "INCONCLUSIVE_DRAFT"
    assert got["BT0003_x"].total_trades == "2" and got["BT0003_x"].reason == "trade count 2 below swing minimum 30"
    info = spark.createDataFrame([(k, "H1", "S1", "2024-01-01:2024-02-01", "") for k in got], "run_id string, hypothesis_id string, strategy_id string, is_window string, oos_window string")
    rows = runs.registry_rows(report, info)
    assert tuple(rows.columns) == runs.REGISTRY_COLUMNS
    old = rows.limit(0).unionByName(rows.filter("backtest_id = 'BT0001'").withColumn("verdict", F.lit("OLD"))).unionByName(
        rows.filter("backtest_id = 'BT0001'").withColumn("backtest_id", F.lit("BT9")))
    up = {r.backtest_id: r for r in runs.upsert_experiments(old, rows).collect()}
    assert sorted(up) == ["BT0001", "BT0002", "BT0003", "BT9"] and up["BT0001"].verdict == "READY_FOR_REVIEW"
    assert (up["BT0001"].is_start, up["BT0001"].is_end, up["BT0001"].oos_start) == ("2024-01-01", "2024-02-01", "")


def _registered(spark, *ids, verdict="v"):
    rows = [tuple({"backtest_id": i, "verdict": verdict}.get(c, "") for c in runs.REGISTRY_COLUMNS) for i in ids]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in runs.REGISTRY_COLUMNS))


def test_versions_do_not_lose_rows(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "registry")
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, root)
    assert versions.commit_version(_registered(spark, "BT1"), root, 0) == 1
    with pytest.raises(versions.VersionConflict):
        versions.commit_version(_registered(spark, "BT2"), root, 0)
    # A second writer commits after the first has read its base: the first one starts again.
    plain, calls = versions.commit_version, []

    def late(df, where, base):
        calls.append(base)
        if len(calls) == 1:
            plain(_registered(spark, "BT1", "BT3", verdict="other"), where, base)
        return plain(df, where, base)

    monkeypatch.setattr(versions, "commit_version", late)
    assert runs.upsert_registry(spark, root, _registered(spark, "BT2", "BT3", verdict="mine")) == 3 and calls == [1, 2]
    got = {r.backtest_id: r.verdict for r in versions.read_version(spark, root).collect()}
    assert got == {"BT1": "other", "BT2": "mine", "BT3": "mine"}
    assert [r.verdict for r in versions.read_version(spark, root, 1).collect()] == ["v"]
    with pytest.raises(Exception, match="two new rows of BT9"):
        runs.upsert_registry(spark, root, _registered(spark, "BT9", "BT9"))
    assert versions.newest_version(spark, root) == 3
    # Lost between making the file and filling it: said, not passed over.
    (tmp_path / "registry" / "_versions" / "0000000004").write_text("")
    with pytest.raises(TimeoutError):
        versions.read_version(spark, root, wait=0.2)


def test_versions_of_writers_at_once(spark, tmp_path):
    root = str(tmp_path / "registry")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: runs.upsert_registry(spark, root, _registered(spark, f"BT{i}")), range(4)))
    assert sorted(r.backtest_id for r in versions.read_version(spark, root).collect()) == ["BT0", "BT1", "BT2", "BT3"]
    assert versions.newest_version(spark, root) == 4


@pytest.mark.parametrize("block", ["64", "100", "128m"])
def test_trade_counts(spark, tmp_path, block):
    """As the csv module counts, over blocks that end inside quoted cells."""
    rng = np.random.default_rng(int(block.rstrip("m")))
    pieces = ['"', '""', ",", "\n", "\r\n", "a", "bc", '"x,\ny"', ',"', '",']
    texts = ["h\n", "h", "\n\n1\n", 'h\n"open\nto the end', 'h\n"a""\n""b"\n1,x"y\n\n'] + ["".join(rng.choice(pieces, 150)) for _ in range(25)]
    want = {}
    for i, text in enumerate([*texts, ""]):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}" / "trades.csv").write_bytes(text.encode())
        with open(tmp_path / f"r{i}" / "trades.csv") as f:
            records = sum(1 for _ in csv.reader(f))
        if records:
            want[f"r{i}"] = records - 1
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert {r.run_id: r.trades for r in runs.trade_counts(spark, str(tmp_path)).collect()} == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_label_lines_at_all_line_ends(spark):
    ends = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    text = "".join(f"\u00a0Label {chr(97 + i)}:\u3000{i}\u2003{e}" for i, e in enumerate(ends))
    df = spark.createDataFrame([("r", text), ("none", None), ("empty", "")], "run_id string, text string")
    got = {(r.run_id, r.path, r.value, r.pos) for r in runs.parse_run_text(df).collect()}
    assert got == {("r", f"label {chr(97 + i)}", str(i), i) for i in range(len(ends))}


@pytest.mark.parametrize(("conf", "n", "want"), [("NO_EVIDENCE", 5, "INCONCLUSIVE_DRAFT"), ("OK", 29, "FAIL_DRAFT"), ("OK", 299, "INCONCLUSIVE_DRAFT"), ("OK", None, "READY_FOR_REVIEW")])
def test_draft_verdict(spark, conf, n, want):
    df = spark.createDataFrame([(conf, n)], "c string, n long")
    v, _ = runs.draft_verdict(F.col("c"), F.col("n"))
    assert df.select(v.alias("v")).first().v == want


def test_times_and_names(spark):
    df = spark.createDataFrame([(1_709_164_800_123, "BT0007_a", "foo", "a:b:c")], "ms long, f string, g string, w string")
    first, last = month_bounds("ms", 0, 1_709_200_000_000)
    a, b = split_window(F.col("w"))
    r = df.select(
        ms_to_iso("ms").alias("iso"), iso_to_ms(ms_to_iso("ms")).alias("back"), iso_to_ms(F.lit("2024-02-29T01:00:00+01:00")).alias("zone"),
        iso_to_ms(F.lit("nonsense")).alias("bad"), first.alias("first"), last.alias("last"), F.size(months_between(0, 1_709_164_800_123)).alias("n"),
        run_id_from_folder(F.col("f"), F.lit("H0003")).alias("i"), run_id_from_folder(F.col("g"), F.lit("H0003")).alias("j"), a.alias("a"), b.alias("b"),
    ).first()
    assert (r.iso, r.back, r.zone, r.bad) == ("2024-02-29T00:00:00.123Z", 1_709_164_800_123, 1_709_164_800_000, None)
    assert (r["first"], r["last"], r.n) == (1_706_745_600_000, 1_709_199_999_999, 650)
    assert (r.i, r.j, r.a, r.b) == ("BT0007", "BT0003", "a", "b:c")


def test_history_class(spark):
    rows = [("basis", 1, 1, "NO"), ("basis", 1, 0, "NO"), ("basis", 0, 0, "YES"), ("um_trades", 1, 1, "YES"), ("k", 1, 0, "YES"), ("k", 1, 0, "NO"), ("k", 0, 1, "NO")]
    df = spark.createDataFrame(rows, "dataset_id string, recent_rows int, old_rows int, archive_2021 string")
    a, t = integrity.history_class()
    got = [(r.a, r.t) for r in df.select(a.alias("a"), t.alias("t")).collect()]
    assert got == [("YES", "TIER 1"), ("NO", "TIER 2"), ("UNKNOWN", "UNKNOWN"), ("UNKNOWN", "UNKNOWN"), ("YES", "TIER 1"), ("UNKNOWN", "UNKNOWN"), ("UNKNOWN", "UNKNOWN")]


def test_manifest_refresh(spark):
    cols = ["dataset_id", "symbol", "local_path", "start_timestamp_utc", "end_timestamp_utc", "row_count", "status", "source_type", "source_url", "notes"]
    m = spark.createDataFrame([("d", "A", p, "", "", "0", "BAD", "archive", "u", n) for p, n in (("p", "n"), ("q", ""), ("r", "n | gap_resolution=no_insert"))], cols)
    t = spark.createDataFrame([("d", "A", "p", "s", "e", 5, "OK", "v", 2), ("d", "A", "r", "s", "e", 5, "OK", "v", 0)], "dataset_id string, symbol string, local_path string, start_timestamp_utc string, end_timestamp_utc string, row_count long, status string, source_url string, inserted_count long")
    got = {r.local_path: r for r in integrity.refresh_manifest(m, t).collect()}
    assert (got["p"].row_count, got["p"].source_url, got["p"].notes) == ("5", "v", "n | gap_resolution=inserted_exact_rest_rows")
    assert (got["q"].status, got["r"].source_url, got["r"].notes) == ("BAD", "u", "n | gap_resolution=no_insert")
