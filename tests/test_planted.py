"""Intraday patterns on planted ticks: days of a low price with gaps, drives, loud bars and fades, against the same SQL as the test tables."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from barlab import queries
from tests.test_oracle import plain


def _value(step: int, quantity: int) -> float:
    """The value whose cents give the tick's price step (modulo 41) and its quantity (modulo 500)."""
    cents = next(c for c in range(quantity - 1, 20500, 500) if c % 41 == step + 20)
    return cents / 100


def _ticks(symbol: str, days: int, rng: np.random.Generator) -> list[tuple]:
    start = dt.datetime(2024, 1, 1)
    out = [(symbol, start + dt.timedelta(seconds=i), _value(-20, 10)) for i in range(470)]  # down to a price where a step is a large gap
    px = 600
    for day in range(1, days):
        drift, quiet = rng.integers(-2, 3), rng.random() < 0.3
        for bar in range(78):
            loud = rng.random() < 0.03
            for tick in range(3):
                pull = -np.sign(px - 600) * (abs(px - 600) > 150) * 3
                step = int(np.clip(round(rng.normal(drift * (bar < 24) + pull, 1.0 if quiet else 4.0)), -20, 20))
                if bar == 0 and tick == 0:
                    step = int(rng.choice([-20, -15, -8, 8, 15, 20]))
                elif bar < 12 and day % 3 == 0:
                    step = int(np.clip(step + 2 * (1 if day % 2 else -1), -20, 20))
                px += step
                out.append((symbol, start + dt.timedelta(days=day, minutes=570 + 5 * bar + tick), _value(step, 480 if loud else int(rng.integers(1, 30)))))
    return out


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    rng = np.random.default_rng(7)
    rows = [row for symbol in ("a", "b", "c") for row in _ticks(symbol, 40, rng)]
    events = pd.DataFrame(rows, columns=["event_type", "ts", "value"])
    events.insert(0, "event_id", np.arange(len(events), dtype=np.int64))
    events["ts"] = events["ts"].astype("datetime64[us]")
    folder = tmp_path_factory.mktemp("planted")
    events.to_parquet(folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["detect_intraday", "power_hour", "spencer", "session_patterns", "fashionably_late"])
def test_planted_patterns_match_sql(spark, planted, name):
    df = queries.queries()[name](spark, planted)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{planted}/events.parquet')")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert mine == theirs
    found = {row[columns.index("pattern")] for row in mine}
    if name == "detect_intraday":
        wanted = {f"{p}_{s}" for p in ("gap_fade", "gap_reversal", "volume_climax", "opening_drive", "vwap_trend", "rsi_divergence", "midday_reversal", "trend_pullback", "mean_reversion", "vwap_reversion") for s in ("long", "short")}
        assert wanted == found
    assert found


def _days(symbol: int, plan: list[tuple[int, int, int, int]], start: dt.datetime) -> list[tuple]:
    """Eight lines a day: plan has (days, drift a tick, swing a tick, quantity); a line's price gives the step (modulo 401, less 200)."""
    out, day = [], start
    for days, drift, swing, quantity in plan:
        for _ in range(days):
            for line in range(8):
                step = max(-200, min(200, drift + swing * (-1) ** line))
                out.append((len(out), symbol, 1, line, float(quantity), (step + 200) / 100, day))
            day += dt.timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def planted_days(tmp_path_factory):
    start = dt.datetime(2000, 1, 1)
    fall = (50, -198, 2, 10)  # to prices at which a day can move by some per cent
    plans = {
        # a long rise, then loud days that fall still, above and below the mean
        1: ("STANDARD", [fall, (180, 12, 40, 10), (20, 0, 190, 30), (25, 1, 1, 5), (20, 0, 190, 30), (25, -1, 1, 5), (40, 0, 20, 10)]),
        2: ("PROMO", [fall, (60, 40, 10, 10), (120, 10, 30, 10), (60, -15, 30, 20), (30, 0, 190, 10), (24, -2, 2, 4), (30, 8, 9, 12)]),
    }
    rows = [row for symbol, (_, plan) in plans.items() for row in _days(symbol, plan, start)]
    lines = pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"])
    lines["l_linenumber"] = lines["l_linenumber"].astype("int32")
    lines["l_shipdate"] = lines["l_shipdate"].astype("datetime64[us]")
    folder = tmp_path_factory.mktemp("planted-days")
    lines.to_parquet(folder / "lineitem.parquet")
    pd.DataFrame([(k, name) for k, (name, _) in plans.items()], columns=["p_partkey", "p_type"]).assign(p_brand="Brand#11").to_parquet(folder / "part.parquet")
    return str(folder)


def _matches(spark, folder: str, name: str, tables: tuple[str, ...]) -> set[str]:
    """Holds a query against its SQL and gives the patterns it found."""
    df = queries.queries()[name](spark, folder)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert mine == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    return {row[columns.index("pattern")] for row in mine}


def test_planted_days_match_sql(spark, planted_days):
    found = _matches(spark, planted_days, "detect_daily", ("lineitem", "part"))
    assert found >= {"vol_compression_breakout_long", "vol_compression_breakout_short", "ts_momentum_long", "rs_persistence_long"}


@pytest.fixture(scope="module")
def planted_quarters(tmp_path_factory):
    """Moves of ten 15-minute bars on volume that dries up half way, both ways."""
    start, rows, px = dt.datetime(2024, 1, 1), [], 600
    rows += [("a", start + dt.timedelta(seconds=i), _value(-20, 10)) for i in range(470)]
    at = start + dt.timedelta(days=1)
    for wave in range(24):
        for bar in range(24):
            step = (3 if wave % 2 else -3) if bar >= 8 else (1 if bar % 2 else -1)
            quantity = 20 if bar >= 19 else 200
            rows += [("a", at + dt.timedelta(minutes=15 * bar + tick), _value(step, quantity)) for tick in range(3)]
        at += dt.timedelta(minutes=15 * 24)
    events = pd.DataFrame(rows, columns=["event_type", "ts", "value"])
    events.insert(0, "event_id", np.arange(len(events), dtype=np.int64))
    events["ts"] = events["ts"].astype("datetime64[us]")
    folder = tmp_path_factory.mktemp("planted-quarters")
    events.to_parquet(folder / "events.parquet")
    return str(folder)


def test_planted_quarters_match_sql(spark, planted_quarters):
    assert _matches(spark, planted_quarters, "detect_swing", ("events",)) >= {"vp_divergence_long", "vp_divergence_short"}


def _waves(heights: list[int], last_close: int, volume: int) -> list[tuple]:
    """Bars that touch 10,000 before each bounce of 8 bars and dip below it after, and one loud bar at the end."""
    rows = []
    for height in heights:
        rows.append((10_000 + height // 2, 10_000, 10_000 + height // 4, 100))
        rows += [(10_000 + height, 10_050, 10_060, 100)] * 7 + [(9_980, 9_950, 9_960, 100)]
    rows.append((10_040, last_close - 20, last_close, volume))
    start = dt.datetime(2024, 1, 2, 9, 30)
    return [("x", "5min", start + dt.timedelta(minutes=5 * i), c, h, low, c, v, 100.0) for i, (h, low, c, v) in enumerate(rows)]


@pytest.mark.parametrize(("heights", "close", "volume", "fires"), [([100, 400, 400, 90], 9_960, 300, True), ([100, 400, 400, 110], 9_960, 300, False), ([100, 400, 400, 90], 10_010, 300, False), ([100, 400, 400, 90], 9_960, 100, False), ([400, 300, 200, 90], 9_960, 300, False)])
def test_tidal_wave_fires_on_planted_bounces(spark, heights, close, volume, fires):
    from barlab.operators.chart_patterns import tidal_wave

    bars = spark.createDataFrame(_waves(heights, close, volume), "symbol string, tf string, ts timestamp_ntz, o long, h long, l long, c long, v long, atr double")
    levels = spark.createDataFrame([("x", "5min", 10_000.0, 4, "support"), ("x", "5min", 10_400.0, 4, "both"), ("x", "5min", 9_000.0, 9, "resistance")], "symbol string, tf string, price double, touches long, type string")
    rows = tidal_wave(bars, levels).collect()
    assert len(rows) == fires
    if fires:
        (row,) = rows
        mean = sum(heights) / 4
        assert (row["bounces"], row["entry"], row["stop"], row["t2"]) == (4, 9_990.0, 10_120.0, 9_990.0 - mean)
        assert (row["t1"], row["confidence"]) == (9_990.0 - mean / 2, pytest.approx(0.55 + 0.03 + 0.1 * (1 - 90 / 100)))
