"""Chart patterns as of each bar, and streams against batch."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.functions import folds, indicators
from barlab.operators import chart_patterns, resample, structures
from barlab.operators.resample import ticks_to_bars
from barlab.sources import fixtures
from barlab.streaming import bars as streams
from tests.test_operators import bars, walk

SF = "/root/testdata/sf0.001"


def swings(h, order, better):
    """Strict local extremes by a plain loop."""
    return [i for i in range(order, len(h) - order) if all(better(h[i], h[j]) for j in range(i - order, i + order + 1) if j != i)]


def double_bottoms(df, order=3):
    out = set()
    for k in range(29, len(df)):
        low, high = df["l"].tolist()[: k + 1], df["h"].tolist()[: k + 1]
        found = swings(low, order, lambda a, b: a < b)
        if len(found) < 2:
            continue
        a, b = found[-2:]
        neck, floor = max(high[a : b + 1]), min(low[a], low[b])
        if abs(low[a] - low[b]) <= low[a] * 0.015 and df["c"].iloc[k] >= neck and neck + 2 > floor - 2:
            out.add((df["ts"].iloc[k].to_pydatetime(), float(neck + 2), float(floor - 2)))
    return out


@pytest.mark.parametrize("seed", [11, 12])
def test_double_bottoms_equal_a_loop_over_prefixes(spark, seed):
    df = walk(seed, 140)
    got = chart_patterns.chart_patterns(resample.with_index(bars(spark, df)), 3).where("pattern = 'double_bottom'").collect()
    assert {(r["ts"], r["entry"], r["stop"]) for r in got} == double_bottoms(df)


def test_chart_patterns_do_not_look_ahead(spark):
    df = walk(13, 200)
    whole = chart_patterns.chart_patterns(resample.with_index(bars(spark, df)), 3)
    part = chart_patterns.chart_patterns(resample.with_index(bars(spark, df.iloc[:150])), 3)
    end = df["ts"].iloc[149].to_pydatetime()
    assert {tuple(r) for r in whole.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz")).collect()} == {tuple(r) for r in part.collect()}


def test_levels_are_greedy(spark):
    prices = [100.0, 100.5, 100.8, 101.0, 200.0, 201.0, 300.0]
    pivots = spark.createDataFrame([("A", "1d", i, i, p, "low") for i, p in enumerate(prices)], "symbol string, tf string, pivot long, confirm long, price double, kind string")
    got = {(round(r["price"], 4), r["touches"], r["type"]) for r in structures.cluster_levels(pivots).collect()}
    assert got == {(round((100 + 100.5 + 100.8) / 3, 4), 3, "support"), (200.5, 2, "support")}


def test_as_of_join_takes_the_latest(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "key string, t long")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 6, 60)], "key string, t long, v long")
    assert {tuple(r) for r in structures.as_of_join(left, right, "key", "t", ["v"]).collect()} == {("a", 5, 50), ("a", 1, None), ("b", 9, None)}


def test_stream_bars_equal_batch(spark):
    fixtures.ship(spark)
    ticks = streams.ticks_stream(spark, SF)
    got = streams.run_to_table(streams.tick_bars(ticks, 15), "complete")
    events = spark.read.parquet(f"{SF}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("long")
    batch = ticks_to_bars(events.select(F.col("event_type").alias("symbol"), "ts", "event_id", (cents % 2000 + 9000).alias("px"), (cents % 500 + 1).alias("qty")), 15)
    columns = ["symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "o", "h", "l", "c", "v"]
    assert {tuple(r) for r in got.select(*columns).collect()} == {tuple(r) for r in batch.select(*columns).collect()}


def test_zones_hold_exactly_their_points(spark):
    df = bars(spark, walk(21, 300), walk(22, 300))
    points = resample.with_index(df)
    levels = structures.cluster_levels(structures.swing_pivots(points, 3), 0.01)
    zones = levels.select("symbol", "tf", (F.col("price") - F.col("width")).alias("low"), (F.col("price") + F.col("width")).alias("high"))
    got = sorted((r["symbol"], r["k"]) for r in structures.zones_of(points, zones).collect())
    spans = [(r["symbol"], r["low"], r["high"]) for r in zones.collect()]
    assert got and got == sorted((r["symbol"], r["k"]) for r in points.collect() for s, a, b in spans if s == r["symbol"] and a <= r["c"] <= b)


def test_nearest_levels_equal_all_pairs(spark):
    points = resample.with_index(bars(spark, walk(23, 200)))
    pivots = structures.swing_pivots(points, 3)
    prices = [r["price"] for r in pivots.collect()]
    got = {r["k"]: r["level"] for r in structures.nearest_level(points, pivots).collect()}
    assert got == {r["k"]: min(prices, key=lambda p: (abs(p - r["c"]), p)) for r in points.collect()}


def minutes(rows, start="2024-01-02 09:30"):
    """A session of 5-minute bars from (o, h, l, c, v)."""
    out = pd.DataFrame(rows, columns=["o", "h", "l", "c", "v"]).astype("int64")
    return out.assign(symbol="S", tf="5min", ts=pd.date_range(start, periods=len(out), freq="5min"))[["symbol", "tf", "ts", "o", "h", "l", "c", "v"]]


def scalps(spark, df):
    wide = folds.fold_series(bars(spark, df), ("ema9", "atr")).withColumn("opened", indicators.session_open())
    return chart_patterns.session_scalps(wide.withColumn("vwap", indicators.session_vwap()))


def test_rubber_band_snaps_back(spark):
    calm = [(10000, 10020, 9980, 10000, 100)] * 20
    fall = [(10000 - 20 * i, 10000 - 20 * i + 10, 9970 - 20 * i, 9980 - 20 * i, 100) for i in range(5)] + [(9900 - 60 * i, 9900 - 60 * i + 10, 9830 - 60 * i, 9840 - 60 * i, 200) for i in range(5)]
    snap = [(9600, 9640, 9595, 9598, 100), (9605, 9760, 9600, 9750, 900)]
    df = pd.concat([minutes(calm, "2024-01-01 09:30"), minutes(fall + snap)])
    got = scalps(spark, df).collect()
    assert [(r["pattern"], r["entry"], r["stop"], r["target"]) for r in got] == [("rubber_band", 9762.0, 9588.0, 9762.0 + 2 * 174)]
    assert got[0]["ts"] == df["ts"].iloc[-1].to_pydatetime()


def test_second_chance_and_bouncing_ball(spark):
    rise = [(10000, 10010, 9990, 10000, 100)] * 20
    peak = lambda top: [(9950, 9960, 9940, 9950, 100)] * 4 + [(9980, top, 9960, 9970, 100)] + [(9950, 9960, 9940, 9950, 100)] * 4
    tail = [(10060, 10200, 10050, 10190, 500), (10190, 10300, 10150, 10290, 300), (10250, 10250, 10110, 10120, 100), (10120, 10260, 10115, 10255, 200)]
    df = minutes(rise + peak(10100) + peak(10110) + tail)
    got = chart_patterns.level_scalps(resample.with_index(bars(spark, df)), 3).where("pattern = 'second_chance'").collect()
    assert not got  # 1 R to the pullback's high is not there
    tail[2], tail[3] = (10150, 10150, 10110, 10120, 100), (10120, 10170, 10115, 10165, 200)
    df = minutes(rise + peak(10100) + peak(10110) + tail)
    got = chart_patterns.level_scalps(resample.with_index(bars(spark, df)), 3).where("pattern = 'second_chance'").collect()
    assert [(r["entry"], r["stop"], r["target"], round(r["confidence"], 6)) for r in got] == [(10165.0, 10108.0, 10300.0, 0.7)]

    hop = lambda top, low: [(9700, top, 9650, 9700, 100)] * 3 + [(9600, 9620, low, 9600, 100)] + [(9700, 9750, 9650, 9700, 100)] * 3
    down = minutes(rise + hop(9950, 9500) + hop(9900, 9505) + hop(9850, 9510) + [(9600, 9610, 9480, 9490, 300)])
    got = chart_patterns.level_scalps(resample.with_index(bars(spark, down)), 3).where("pattern = 'bouncing_ball'").collect()
    assert [(r["entry"], r["stop"]) for r in got] == [(9498.0, 9852.0)]


@pytest.mark.parametrize("seed", [31, 32])
def test_scalps_do_not_look_ahead(spark, seed):
    df = walk(seed, 400)
    df["ts"], df["tf"] = pd.date_range("2024-01-02 09:30", periods=400, freq="5min"), "5min"
    end = df["ts"].iloc[299].to_pydatetime()
    until = F.col("ts") <= F.lit(end).cast("timestamp_ntz")
    for make in (lambda x: chart_patterns.level_scalps(resample.with_index(bars(spark, x)), 3), lambda x: scalps(spark, x)):
        assert {tuple(r) for r in make(df).where(until).collect()} == {tuple(r) for r in make(df.iloc[:300]).collect()}
