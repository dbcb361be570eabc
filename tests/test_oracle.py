"""Queries against their SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from barlab import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ALL = queries.oracle_sql()
#: A cross section by default; TEST_ALL=1 for every query.
SOME = ("resample_ohlcv", "multi_tf_bars", "upsert_bars", "write_bars", "sma", "session_vwap", "up_down_streak", "wilder_atr", "affine_scan", "barrier_resolve", "finalize_r", "param_sweep",
        "pattern_stats", "hot_score", "streak_runs", "drawdown_series", "merge_timeframes", "apply_verdicts", "recency_multiplier", "news_as_of_signals", "relevance_filter", "top_symbols",
        "detect_daily_windows", "detect_regime", "adx", "zigzag", "price_in_zone", "trade_lifecycle", "relative_strength", "as_of_regime", "breakout_study", "stream_ticks_to_bars",
        "track_trades", "param_grid", "param_best", "horizontal_levels", "level_search", "swing_window", "stream_setup_day", "extend_series", "merge_tracked_and_fresh")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value if isinstance(value, (int, str, bool, type(None))) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ALL) if os.environ.get("TEST_ALL") else SOME)
def test_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(ALL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert mine == theirs


def test_every_sql_has_a_query():
    assert set(ALL) <= set(queries.queries())
