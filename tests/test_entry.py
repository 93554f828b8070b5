"""The driver contract, and a comparison with SQL on the smallest tables."""

from __future__ import annotations

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# A spread over the modules; the driver compares all of them.
COMPARED = [
    "asof_funding",
    "bars",
    "check_summary",
    "compression_breakout_signal",
    "detected_events",
    "event_leaderboard",
    "file_integrity",
    "funding_premium_signal",
    "label_lines",
    "momentum_ledger",
    "monte_carlo_paths",
    "monte_carlo_verdict",
    "regime_labels",
    "run_reports",
    "series_quality",
    "stream_latest_funding",
    "trade_ledger",
    "walk_forward",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def norm(rows, columns):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([one(r[i]) for i in at] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", COMPARED)
def test_same_as_sql(spark, sf, duck, name):
    df = driver.queries()[name](spark, sf)
    got = norm([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == norm(cursor.fetchall(), names)


def test_entry(spark):
    assert driver.entry(spark).count() >= 1


def test_contract():
    q, o = driver.queries(), driver.oracle_sql()
    assert set(o) <= set(q)
    own = {name for name in q if not re.match(r"op\d+_|pipeline$", name)}
    assert own == own & set(o)


def test_no_unsafe_calls():
    root = os.path.join(os.path.dirname(driver.__file__), "tidegrid")
    for folder, below, files in os.walk(root):
        below[:] = [d for d in below if d != "llm"]  # has bounds of its own
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                for word in ("localCheckpoint", ".collect()", "crossJoin", "broadcast(", ".toPandas()", ".rdd"):
                    assert word not in text, (f, word)
