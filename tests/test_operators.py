"""Golden values, plain loops and invariants."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.functions import folds
from barlab.operators import detect, outcomes, resample, score, stats
from barlab.plans import compose


def walk(seed: int, n: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 10000 + rng.integers(-200, 201, n).cumsum()
    open_ = close + rng.integers(-80, 81, n)
    return pd.DataFrame(
        {"symbol": f"S{seed}", "tf": "1d", "ts": pd.date_range("2020-01-01", periods=n), "o": open_, "h": np.maximum(open_, close) + rng.integers(0, 90, n), "l": np.minimum(open_, close) - rng.integers(0, 90, n), "c": close, "v": rng.integers(100, 900, n)}
    )


def bars(spark, *frames: pd.DataFrame):
    return spark.createDataFrame(pd.concat(frames)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_true_range_and_atr_golden():
    h, l, c = (np.array(x, dtype=float) for x in ([105, 108, 104, 107, 103], [100, 101, 99, 102, 98], [103, 106, 100, 105, 99]))  # noqa: E741
    assert folds.true_ranges(h, l, c).tolist() == [5, 7, 7, 7, 7]
    assert np.round(folds.wilder_atr(h, l, c, 3), 4).tolist()[2:] == [6.3333, 6.5556, 6.7037]
    assert np.isnan(folds.wilder_atr(h, l, c, 3)[:2]).all()


@pytest.mark.parametrize("seed", range(5))
def test_zigzag_alternates_and_never_changes_its_past(seed):
    df = walk(seed, 300)
    h, l = df["h"].to_numpy(float), df["l"].to_numpy(float)  # noqa: E741
    whole = folds.zigzag(h, l, 0.03)
    kinds = [x[3] for x in whole]
    assert all(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    for end in (60, 120, 200):
        assert folds.zigzag(h[:end], l[:end], 0.03) == [x for x in whole if x[1] < end]


def test_affine_scan_equals_the_fold(spark):
    df = resample.with_index(bars(spark, walk(1, 300), walk(2, 90)))
    k = 2 / 21
    out = folds.affine_scan(df, 1 - k, k, "c", "ema", 37).select("symbol", "k", "ema").toPandas().sort_values(["symbol", "k"])
    for seed, n in ((1, 300), (2, 90)):
        want = folds.ema_first_seed(walk(seed, n)["c"].to_numpy(float), 20)
        assert np.allclose(out[out.symbol == f"S{seed}"]["ema"], want)


def loop(sig, after, hold, splits=(0.5, 0.3, 0.2)):
    """A trade bar by bar: stop first, then the targets."""
    sign = 1 if sig["bias"] == "long" else -1
    entry, stop, t1, t2 = (sig[x] for x in ("entry", "stop", "t1", "t2"))
    risk, left, total, got1, got2, last = abs(entry - stop), 1.0, 0.0, False, False, None
    leg = lambda p: round(sign * (p - entry) / risk, 3)
    for k, h, l, c in after[:hold]:  # noqa: E741
        worst, best, last = (l, h, (k, c)) if sign > 0 else (-h, -l, (k, c))
        if worst <= sign * stop:
            return total + left * leg(stop), got1, got2, k
        if not got1 and best >= sign * t1:
            got1, total, left, stop = True, total + splits[0] * leg(t1), left - splits[0], entry
        if got1 and not got2 and best >= sign * t2:
            got2, total, left = True, total + splits[1] * leg(t2), left - splits[1]
    return total + left * leg(last[1]), got1, got2, last[0]


def test_barriers_equal_a_loop(spark):
    frames = [walk(s, 160) for s in range(4)]
    df = resample.with_index(bars(spark, *frames))
    sign = F.when(F.col("k") % 2 == 0, 1).otherwise(-1)
    signals = df.where("k % 5 = 0 AND k < 150").select("symbol", "tf", "k", F.when(F.col("k") % 2 == 0, "long").otherwise("short").alias("bias"), F.col("c").alias("entry"), (F.col("c") - sign * 300).alias("stop"), (F.col("c") + sign * 250).alias("t1"), (F.col("c") + sign * 500).alias("t2"))
    got = outcomes.barrier_resolve(signals, df, 20).collect()
    assert len(got) == 4 * 30
    by = {f["symbol"].iloc[0]: f for f in frames}
    for r in got:
        f = by[r["symbol"]].iloc[r["k"] + 1 :]
        after = [(r["k"] + 1 + i, *x) for i, x in enumerate(zip(f["h"], f["l"], f["c"], strict=True))]
        want = loop(r, after, 20)
        assert (round(r["raw_r"], 6), r["got1"], r["got2"], r["k_exit"]) == (round(want[0], 6), *want[1:])


GOLDEN = [
    (("long", 100, 95, 105, 110), [(106, 99, 104), (111, 105, 108)], "win", 1.40),
    (("short", 200, 210, 190, 180), [(201, 189, 195), (201, 190, 200)], "partial_win", 0.48),
    (("long", 150, 147, 153, 159), [(160, 149, 155), (158.5, 157, 158)], "win", 1.913),
    (("long", 500, 490, 510, 520), [(501, 488, 489)], "loss", -1.02),
    (("long", 550, 547, 553, 556), [(551.5, 549, 551)], "timeout", 0.313),
]


@pytest.mark.parametrize("signal, path, outcome, r", GOLDEN)
def test_final_r_golden(spark, signal, path, outcome, r):
    sig = spark.createDataFrame([("A", "1d", 0, *map(lambda x: float(x) if not isinstance(x, str) else x, signal))], "symbol string, tf string, k long, bias string, entry double, stop double, t1 double, t2 double")
    after = spark.createDataFrame([("A", "1d", i + 1, *map(float, b)) for i, b in enumerate(path)], "symbol string, tf string, k long, h double, l double, c double")
    row = outcomes.finalize_r(outcomes.barrier_resolve(sig, after, 10)).first()
    assert (row["outcome"], row["r"]) == (outcome, pytest.approx(r, abs=1e-9))


def test_signals_do_not_look_ahead(spark):
    """What all daily detectors say at bars of a prefix is what they say on the prefix alone."""
    df = walk(7, 330)
    whole = detect.detect(detect.wide(bars(spark, df)), detect.daily_detectors()).select("ts", "pattern", F.round("stop", 6).alias("stop"))
    part = detect.detect(detect.wide(bars(spark, df.iloc[:300])), detect.daily_detectors()).select("ts", "pattern", F.round("stop", 6).alias("stop"))
    seen = {tuple(r) for r in whole.where("ts < '2020-10-27'").collect()}
    assert seen == {tuple(r) for r in part.collect()} and seen


def test_non_overlapping_is_greedy(spark):
    rows = [("A", "1d", "p", 1, "long", 1, 5, 0.5, 2), ("A", "1d", "p", 3, "long", 1, 9, 0.9, 2), ("A", "1d", "p", 5, "long", 1, 7, 0.5, 9), ("A", "1d", "p", 5, "short", 1, 8, 0.4, 2), ("A", "1d", "q", 3, "long", 1, 4, 0.5, 2)]
    df = spark.createDataFrame(rows, "symbol string, tf string, pattern string, k long, bias string, bucket long, k_exit long, confidence double, cooldown int")
    kept = {(r["pattern"], r["k"], r["bias"]) for r in outcomes.select_non_overlapping(df).collect()}
    assert kept == {("p", 1, "long"), ("p", 5, "short"), ("q", 3, "long")}


def test_position_size_golden(spark):
    row = spark.createDataFrame([(100.0, 98.0)], "entry double, stop double").select(*(x.alias(k) for k, x in score.position_size(25000.0, 0.01, F.lit(1.0), 0.60).items())).first()
    assert (row["shares"], row["risk_amount"]) == (125, 250.0)
    row = spark.createDataFrame([(5.0, 4.99)], "entry double, stop double").select(*(x.alias(k) for k, x in score.position_size(25000.0, 0.01, F.lit(1.0)).items())).first()
    assert row["shares"] == 750 and "capped" in row["warnings"]


def test_user_detector_is_planned_with_the_others(spark):
    compose.register_detector("gap_up", ("1d",), 5, "long", F.col("o") > F.col("prev") + 60, F.col("c") - F.col("atr"), F.col("c") + F.col("atr"), F.col("c") + 2 * F.col("atr"), F.lit(0.6))
    try:
        found = detect.detect(detect.wide(bars(spark, walk(3, 80))), [d for d in detect.catalogue(["1d"]) if d.name == "gap_up"])
        assert found.count() > 0
    finally:
        compose.unregister_detector("gap_up")
    assert all(d.name != "gap_up" for d in detect.catalogue(["1d"]))


def test_grades(spark):
    row = spark.range(1).select(stats.grade(F.lit(71), F.lit(20)).alias("a"), stats.grade(F.lit(71), F.lit(12)).alias("b"), stats.grade(F.lit(10), F.lit(99)).alias("f")).first()
    assert tuple(row) == ("A", "B", "F")


def test_plans_push_down_and_shuffle_once(spark):
    """Resampling reads the columns it needs and shuffles partial sums."""
    from barlab.sources import fixtures

    plan = fixtures.table(spark, "/root/testdata/sf0.001", "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("px"), F.lit(1).alias("qty"))
    text = resample.ticks_to_bars(plan, 5)._jdf.queryExecution().toString()
    assert "partial_min" in text.replace("partial_min_by", "partial_min") and "user_id" not in text.split("== Physical Plan ==")[1]


def test_backtest_equals_a_loop_trade_by_trade(spark):
    df = bars(spark, walk(41, 420), walk(42, 380))
    detectors = [d for d in detect.daily_detectors() if d.name.startswith(("range_expansion", "streak_reversal", "turtle", "atr_expansion", "multi_tf"))]
    got = sorted((r["symbol"], r["pattern"], r["k"], r["k_exit"], r["outcome"], round(r["r"], 3)) for r in compose.walk_forward_backtest(df, detectors).collect())
    numbered = outcomes.with_window_atr(resample.with_index(df))
    series = {s: g.sort_values("k").reset_index(drop=True) for s, g in numbered.toPandas().groupby("symbol")}
    found = detect.with_traits(detect.detect(detect.wide(df), detectors)).toPandas()
    want = []
    for (symbol, _), group in found.groupby(["symbol", "family"]):
        own, open_until, fired = series[symbol], -1, {}
        for x in group.sort_values(["k", "confidence"], ascending=[True, False], kind="stable").itertuples():
            place = (x.bias, round(x.entry / 100))
            if x.k < 60 or len(own) < 70 or x.k < open_until or x.k - fired.get(place, -(10**9)) < max(1, x.cooldown_minutes // 390):
                continue
            after = own[(own.k > x.k) & (own.k <= x.k + max(1, x.hold_minutes // 390))]
            if not len(after):
                continue
            sign = 1 if x.bias == "long" else -1
            entry = x.entry + sign * 0.05 * own.window_atr[x.k]
            risk, stop, left, legs, hit = abs(entry - x.stop), x.stop, 1.0, [], [False, False]
            for b in after.itertuples():
                worst, best = (b.l, b.h) if sign == 1 else (b.h, b.l)
                if sign * (worst - stop) <= 0:
                    legs.append((left, round(sign * (stop - entry) / risk, 3)))
                    left = 0.0
                elif not hit[0] and sign * (best - x.t1) >= 0:
                    hit[0], left, stop = True, left - x.splits[0], entry
                    legs.append((x.splits[0], round(sign * (x.t1 - entry) / risk, 3)))
                if left > 0.01 and hit[0] and not hit[1] and sign * (best - x.t2) >= 0:
                    hit[1], left = True, left - x.splits[1]
                    legs.append((x.splits[1], round(sign * (x.t2 - entry) / risk, 3)))
                if left <= 0.01:
                    break
            if left > 0.01:
                legs.append((left, round(sign * (b.c - entry) / risk, 3)))
            r = round(max(-10.0, min(10.0, sum(w * v for w, v in legs))) - 0.02, 3)
            outcome = "win" if all(hit) else "partial_win" if hit[0] else "timeout" if r > 0 and left > 0.01 else "loss"
            open_until, fired[place] = b.k, x.k
            want.append((symbol, x.pattern, x.k, b.k, outcome, r))
    assert len(got) > 20 and [g[:5] for g in got] == [w[:5] for w in sorted(want)] and np.allclose([g[5] for g in got], [w[5] for w in sorted(want)], atol=0.0011)


def test_sql_functions(spark):
    compose.register_sql_functions(spark)
    df = walk(51, 200)
    bars(spark, df).createOrReplaceTempView("walked")
    h, l, c = (df[x].to_numpy(float) for x in "hlc")  # noqa: E741
    row = spark.sql("SELECT ema(double(c), ts, 9) AS e, wilder_atr(double(h), double(l), double(c), ts, 14) AS a FROM walked GROUP BY symbol, tf").first()
    assert row["e"] == pytest.approx(folds.ema_first_seed(c, 9)[-1]) and row["a"] == pytest.approx(folds.wilder_atr(h, l, c, 14)[-1])
    got = [tuple(r) for r in spark.sql("SELECT pivot, confirm, price, kind FROM swings(TABLE(walked) PARTITION BY (symbol, tf) ORDER BY ts)").collect()]
    assert got == folds.zigzag(h, l, 0.03)
    few = compose.detectors_with_params(("1d",), spark.createDataFrame([("streak", 8.0)], "name string, value double"))
    assert len(few) == len(detect.catalogue(("1d",)))
    # every pattern with a threshold takes it: one that nothing reaches silences both sides
    strict = {"climax_volume": "volume_climax", "vwap_sigma": "vwap_reversion", "divergence_move": "vp_divergence", "keltner_volume": "keltner_breakout", "streak": "streak_reversal"}
    given = compose.detectors_with_params(("5min", "15min", "1d"), spark.createDataFrame([(name, 987.0) for name in strict], "name string, value double"))
    for pattern in strict.values():
        assert all("987" in str(d.when) for d in given if d.name.startswith(pattern)) and sum(d.name.startswith(pattern) for d in given) == 2
    with pytest.raises(ValueError, match="no such"):
        compose.detectors_with_params(("1d",), spark.createDataFrame([("strike", 8.0)], "name string, value double"))


def test_power_hour_shares_equal_a_look_at_all_closes(spark):
    rng = np.random.default_rng(7)
    rows = []
    for day in range(60):
        base = 10000 + (day % 7) * 40
        for i in range(48):
            c = base + int(rng.integers(-60, 61))
            rows.append(("P", "5min", pd.Timestamp("2024-01-01 13:00") + pd.Timedelta(days=day, minutes=5 * i), c, c + 5, c - 5, c, 100 + 200 * (i % 9 == 0), day * 48 + i + 1))
    df = pd.DataFrame(rows, columns=["symbol", "tf", "ts", "o", "h", "l", "c", "v", "n"])
    df["minute"], df["atr"], df["v6"], df["v78"], df["vwap"] = df.ts.dt.hour * 60 + df.ts.dt.minute, 50.0, 2.0, 1.0, df.c.rolling(5, 1).mean()
    wide = spark.createDataFrame(df).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {(r["ts"], r["bias"]) for r in detect.power_hour(wide).collect()}
    want = set()
    for r in df[df.minute.between(840, 870) & (df.n >= 30)].itertuples():
        past = df[(df.minute >= 780) & (df.ts <= r.ts)].c
        share = (past > r.vwap).mean()
        sign = 1 if share > 0.7 else -1 if share < 0.3 else 0
        risk = abs(r.c - (r.vwap - sign * 5.0))
        if sign and len(past) >= 10 and risk > 0 and round(50.0 / risk, 2) >= 1:
            want.add((r.ts.to_pydatetime(), "long" if sign == 1 else "short"))
    assert len(want) > 10 and got == want


def test_stores_are_pruned_and_extended(spark, tmp_path):
    from barlab.sources import bars as store

    base = walk(91, 6).assign(tf="1h", ts=pd.to_datetime(["2024-01-02 10:00", "2024-01-02 11:00", "2024-01-03 10:00", "2024-01-03 15:00", "2024-01-04 10:00", "2024-01-04 16:00"]))
    daily = walk(92, 5).assign(ts=pd.date_range("2024-01-01", periods=5))
    everything = bars(spark, base, daily)
    path = f"{tmp_path}/store"
    store.write_bars(everything.where("to_date(ts) <= DATE'2024-01-02'"), path)
    # of two bars of one time one is added, of an unknown series none
    fetched = everything.unionByName(everything.where("tf = '1h'")).unionByName(everything.withColumn("symbol", F.lit("new")))
    first = {(r["symbol"], r["tf"]): (r["added"], r["status"]) for r in store.extend_series(path, fetched, "2024-01-04").collect()}
    assert first == {("S91", "1h"): (3, "ok"), ("S92", "1d"): (2, "ok")}
    assert {r["status"] for r in store.extend_series(path, fetched, "2024-01-04").collect()} == {"skip"}
    some = store.read_bars(spark, path, ("1d",), "2024-01-02", "2024-01-03")
    assert sorted(r["ts"].day for r in some.collect()) == [2, 3]
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "tf#" in filters and "date#" in filters and plan.count("PartitionFilters: []") == 0
