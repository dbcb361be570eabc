"""Tables in folders, prices that are not above 0, ticks at one instant, streaks across days and dense streams."""

from __future__ import annotations

import re
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from barlab import queries
from barlab.operators import detect, score
from tests.test_oracle import plain


def compared(spark, folder: str, name: str, tables: dict[str, str]) -> tuple[list, list]:
    """A query's rows and its SQL's over a folder; `tables` gives each table's files."""
    con = duckdb.connect()
    for table, files in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{files}')")
    df = queries.queries()[name](spark, folder)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    return mine, sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["news_ttl_window", "stream_in_play"])
def test_streams_of_a_table_in_a_folder_of_files(spark, tmp_path, name):
    """Several files out of order, and ids beyond 32 bits once they are minutes."""
    spark.range(300).select((F.col("id") + F.when(F.col("id") % 3 == 0, 400_000_000).otherwise(0)).alias("doc_id"), F.lit("text").alias("text")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    mine, theirs = compared(spark, str(tmp_path), name, {"documents": f"{tmp_path}/documents.parquet/*.parquet"})
    assert mine == theirs and mine


@pytest.fixture(scope="module")
def below_zero(spark, tmp_path_factory) -> str:
    """One daily series whose price walks from 1,000 to below 0 and stays there for two years."""
    folder = str(tmp_path_factory.mktemp("below"))
    i = F.col("id")
    step = i * 37 % 401
    cents = 401 * 100 + F.when(i < 900, F.floor(step / 4)).otherwise(step)
    rows = spark.range(3200).select(
        i.alias("l_orderkey"), F.lit(1).cast("long").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), (i % 50 + 1).cast("double").alias("l_quantity"),
        (cents / 100).alias("l_extendedprice"), F.timestamp_add("DAY", F.floor(i / 4), F.lit("1995-01-02").cast("timestamp_ntz")).alias("l_shipdate"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "STANDARD", "Brand#11")], "p_partkey long, p_type string, p_brand string").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name", ["log_returns", "vol_regime_label", "momentum_character", "feature_vector", "detect_daily", "detect_daily_windows", "scan", "scored_scan"])
def test_prices_that_are_not_above_zero(spark, below_zero, name):
    mine, theirs = compared(spark, below_zero, name, {t: f"{below_zero}/{t}.parquet/*.parquet" for t in ("lineitem", "part")})
    assert mine == theirs
    if name.startswith("detect_daily"):
        assert mine and not any("high_momentum_52w" in row for row in mine if "1996-06" < row[-1])


def test_ticks_of_one_instant_and_different_prices_are_kept(spark, tmp_path):
    at = F.timestamp_add("SECOND", F.floor(F.col("id") / 4), F.lit("2024-01-01").cast("timestamp_ntz"))
    spark.range(80).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit("view").alias("event_type"), (F.col("id") % 3 + 0.5).alias("value")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    mine, theirs = compared(spark, str(tmp_path), "stream_dedup_bars", {"events": f"{tmp_path}/events.parquet/*.parquet"})
    assert mine == theirs and len(mine) == 60


def test_streak_runs_join_only_the_ends_of_days(spark):
    from itertools import groupby

    from barlab.operators import perf

    r = [(i * i * 7 // 11 + i // 9) % 5 - 2 for i in range(400)]
    r[150:260] = [3] * 110  # a run over several days
    rows = [(f"{i:04d}", i // 20, x) for i, x in enumerate(r)]
    trades = spark.createDataFrame(rows, "id string, d int, r_milli long").withColumn("closed_at", F.timestamp_add("DAY", F.col("d"), F.lit("2024-01-01").cast("timestamp_ntz")))
    want = []
    for (sign, _), run in groupby(rows, key=lambda x: ((x[2] > 0) - (x[2] < 0), x[0] if x[2] == 0 else "")):
        run = list(run)
        want.append((sign, len(run), sum(x[2] for x in run), run[0][1], run[-1][1]))
    day = lambda c: F.datediff(c, F.lit("2024-01-01"))
    found = perf.streak_runs(trades)
    got = [tuple(x) for x in found.select("sign", "length", "total", day("first_day"), day("last_day")).collect()]
    assert sorted(got) == sorted(want)
    best = [n for s, n, *_ in want if s > 0], [n for s, n, *_ in want if s < 0]
    assert tuple(perf.streaks(trades).first()) == (max(best[0]), max(best[1]), want[-1][0] * want[-1][1])
    # what the one ordered task sees is cut down to the days' ends first
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = max(k for k, x in enumerate(plan) if re.search(r"\], \[day#\d+ ASC NULLS FIRST, run#\d+L? ASC NULLS FIRST\]$", x))
    assert any("Filter" in x and "last#" in x for x in plan[first + 1 : first + 4])


def test_prices_give_the_setups_that_a_bar_changes():
    from barlab.streaming import tracker as T

    made = lambda i: {"bias": 1 if i % 2 else -1, "entry": 1000 + i * 7 % 60, "status": "PENDING"}
    setups = {i: {**(s := made(i)), "stop": s["entry"] - s["bias"] * 30, "t1": s["entry"] + s["bias"] * 30, "t2": s["entry"] + s["bias"] * 60, "risk": 30} for i in range(60)}
    plain, index = {k: dict(s) for k, s in setups.items()}, T.Prices()
    for k, s in setups.items():
        index.add(k, s)
    for i in range(80):
        bar = (1030 + i * 37 % 90 + i % 5, 1030 + i * 37 % 90 - i % 4 - 40, 1030 + i * 37 % 90 - 20)
        want = sorted((k, *e) for k, s in plain.items() if s["status"] not in T.ENDS for e in T.advance(s, *bar))
        got = []
        for k in index.hit(setups, *bar):
            got += [(k, *e) for e in T.advance(setups[k], *bar)]
            if setups[k]["status"] not in T.ENDS:
                index.add(k, setups[k])
        assert sorted(got) == want


def test_the_spread_of_a_session_is_a_running_one(spark):
    """Two days of 288 bars: the closes' deviation so far, carried from bar to bar; no pattern walks the day's closes within a walk of them."""
    i = F.col("id")
    close = 10_000 + i * i * 7919 % 301
    bars = spark.range(576).select(
        F.lit("a").alias("symbol"), F.lit("5min").alias("tf"), F.timestamp_add("MINUTE", i * 5, F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
        (close - 3).alias("o"), (close + 5).alias("h"), (close - 6).alias("l"), close.alias("c"), (i % 9 + 1).alias("v"),
    )
    rows = detect.wide(bars).select("ts", "c", "day_std").orderBy("ts").collect()
    for day in (rows[:288], rows[288:]):
        for n in (1, 2, 50, 287, 288):
            assert day[n - 1]["day_std"] == pytest.approx(statistics.pstdev([r["c"] for r in day[:n]]), abs=1e-9)
    reversions = [d for d in detect.intraday_detectors() if d.name.startswith("vwap_reversion")]
    assert len(reversions) == 2 and not any("day_closes" in str(x) for d in reversions for x in (d.when, d.t1, d.t2))


def test_recent_trades_by_running_sums_in_chunks(spark):
    """Three patterns, one without a name, in chunks of 256 trades, against a plain loop; no frame adds up a trade's 200 predecessors."""
    rows = [(f"{i:05d}", (None, "a", "b")[0 if i % 50 == 7 else 1 + i % 7 // 6], i * i * 31 // 17 % 40, (i * i * 13 // 7 + i // 90) % 801 - 420 + (i * i * 31 // 17 % 40 % 7 - 3) * 120) for i in range(3000)]
    trades = spark.createDataFrame(rows, "id string, pattern_name string, d int, r_milli long").withColumn("closed_at", F.timestamp_add("DAY", F.col("d"), F.lit("2024-01-01").cast("timestamp_ntz")))
    want = {}
    for pattern in (None, "a", "b"):
        ordered = sorted((d, i, r) for i, p, d, r in rows if p == pattern)
        for k, (_, i, _) in enumerate(ordered):
            recent, older = [[r for *_, r in ordered[max(0, k - a) : max(0, k - b)]] for a, b in ((20, 0), (200, 20))]
            edge = (2 * sum(recent) + sum(older)) / (2 * len(recent) + len(older)) / 1000 if k else 0
            want[i] = 1.0 if k < 50 else next((m for least, m in ((0.15, 1.25), (0, 1.0), (-0.1, 0.75), (-0.3, 0.5)) if edge >= least), 0.25)
    found = score.recency_multiplier(trades, chunk=256)
    assert {i: m for i, m in found.collect()} == want and found.count() == len(rows) and len(set(want.values())) > 2
    assert not re.search(r"RowFrame, -\d+", found._jdf.queryExecution().optimizedPlan().toString().replace("RowFrame, -20, -20", "").replace("RowFrame, -200, -200", ""))
