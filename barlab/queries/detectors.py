"""F, G, H, R and the compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions import folds
from barlab.functions import indicators as I
from barlab.operators import chart_patterns as C
from barlab.operators import detect as D
from barlab.operators import features as G
from barlab.operators import outcomes as O
from barlab.operators import resample, score
from barlab.operators import structures as S
from barlab.plans import compose
from barlab.queries.folds import _D, ATR_SQL
from barlab.queries.sql import CLOSED, DAILY, HOURLY, K, lag, over
from barlab.sources import bars as store
from barlab.sources import fixtures

SIGNAL = ["symbol", "tf", "ts", "pattern", "bias", *("entry", "stop", "t1", "t2", "confidence")]


def _signals(df):
    return df.select(*SIGNAL[:5], *(F.round(x, 6).alias(x) for x in SIGNAL[5:]))


def detect_daily(spark, sf_dir):
    return _signals(D.detect(D.wide(fixtures.daily(spark, sf_dir)), D.daily_detectors()))


_WITH_ORACLE = ("momentum_breakout", "range_expansion_long", "range_expansion_short", "volume_breakout_long", "volume_breakout_short", "rs_persistence_long", "high_momentum_52w",
                "ts_momentum_long", "ts_momentum_short", "atr_expansion_long", "atr_expansion_short", "low_vol_long", "bab_long")


def detect_daily_windows(spark, sf_dir):
    """Those daily patterns that SQL can follow with one recursion."""
    picked = [d for d in D.daily_detectors() if d.name in _WITH_ORACLE]
    return _signals(D.detect(D.wide(fixtures.daily(spark, sf_dir)), picked))


def detect_swing(spark, sf_dir):
    bars = fixtures.intraday(spark, sf_dir).unionByName(fixtures.intraday(spark, sf_dir, 15))
    return _signals(D.detect(D.wide(bars), D.swing_detectors()))


def detect_intraday(spark, sf_dir):
    return _signals(D.detect(D.wide(fixtures.intraday(spark, sf_dir, 5)), D.intraday_detectors()))


def power_hour(spark, sf_dir):
    return _signals(D.power_hour(D.wide(fixtures.intraday(spark, sf_dir, 5))))


_CHART = ["symbol", "ts", "pattern", "bias", "entry", "stop", "target", "confidence"]


def chart_patterns(spark, sf_dir):
    return C.chart_patterns(resample.with_index(fixtures.daily(spark, sf_dir)), 5).select(*_CHART[:4], *(F.round(x, 6).alias(x) for x in _CHART[4:]))


def breaking_news(spark, sf_dir):
    return C.breaking_news(fixtures.daily(spark, sf_dir)).select(*_CHART[:4], *(F.round(x, 6).alias(x) for x in _CHART[4:]))


def opening_range_break(spark, sf_dir):
    bars = fixtures.intraday(spark, sf_dir, 15)
    both = C.opening_range_break(bars, 15).unionByName(C.opening_range_break(bars, 30))
    return both.select(*_CHART[:4], *(F.round(x, 6).alias(x) for x in _CHART[4:]))


def _with_vwap(spark, sf_dir):
    bars = folds.fold_series(fixtures.intraday(spark, sf_dir, 5), ("ema9",)).withColumn("opened", I.session_open())
    return bars.withColumn("vwap", I.session_vwap())


def ema_vwap_cross(spark, sf_dir):
    return C.ema_vwap_cross(_with_vwap(spark, sf_dir)).select("symbol", "ts", F.round("vwap", 5).alias("vwap"), "day_low")


def fashionably_late(spark, sf_dir):
    return C.fashionably_late(_with_vwap(spark, sf_dir)).select(*_CHART[:4], *(F.round(x, 5).alias(x) for x in _CHART[4:]))


def spencer(spark, sf_dir):
    return C.spencer(fixtures.intraday(spark, sf_dir, 5)).select(*_CHART[:4], *(F.round(x, 5).alias(x) for x in _CHART[4:]))


def session_patterns(spark, sf_dir):
    bars = fixtures.intraday(spark, sf_dir, 5)
    return C.hitch_hiker(bars).unionByName(C.gap_give_and_go(bars)).select(*_CHART[:4], *(F.round(x, 5).alias(x) for x in _CHART[4:]))


def session_scalps(spark, sf_dir):
    bars = folds.fold_series(fixtures.intraday(spark, sf_dir, 5), ("ema9", "atr")).withColumn("opened", I.session_open())
    return C.session_scalps(bars.withColumn("vwap", I.session_vwap())).select(*_CHART[:4], *(F.round(x, 5).alias(x) for x in _CHART[4:]))


def level_scalps(spark, sf_dir):
    bars = resample.with_index(fixtures.intraday(spark, sf_dir, 5))
    return C.level_scalps(bars, 3).select(*_CHART[:4], *(F.round(x, 5).alias(x) for x in _CHART[4:]))


def setup_gate(spark, sf_dir):
    """Channel breaks held against the price three bars later."""
    bars = O.with_window_atr(resample.with_index(fixtures.daily(spark, sf_dir))).withColumn("price", F.lead("c", 3).over(I.series()))
    up = F.col("c") > I.donchian_high(20)
    made = bars.withColumn("up", up).where("up and price is not null").select(
        "symbol", "k", F.lit("long").alias("bias"), F.col("c").cast("double").alias("entry"), (F.col("l") - 200.0).alias("stop"), (F.col("c") + 900.0).alias("target"), F.when(F.col("k") % 2 == 0, 0.0).otherwise(F.col("c") + 250.0).alias("target_1"),
        F.lit(None).cast("double").alias("target_2"), "price", F.when(F.col("k") % 3 > 0, F.col("window_atr")).alias("atr"), (F.lit(0.9) + F.col("k") % 10 / 100).alias("confidence"),
    )
    return D.setup_gate(made).select("symbol", "k", "entry", "rr", "t1", "t2", F.round("confidence", 6).alias("confidence"))


def pivot_bonuses(spark, sf_dir):
    """Volume bonuses of the last two touches and of the last three pivots of a kind, and whether the two touches are far enough apart."""
    bars = resample.with_index(fixtures.daily(spark, sf_dir))
    vols = S.pivot_volumes(bars, S.last_pivots(_pivots(spark, sf_dir), 3)).groupBy("symbol", "tf", "kind").agg(F.array_sort(F.collect_list(F.struct("pivot", "vol"))).alias("p")).where(F.size("p") == 3)
    x = lambda i, f: F.col("p")[i][f]
    return vols.select(
        "symbol", "kind", S.volume_touch_bonus(x(1, "vol"), x(2, "vol")).alias("touch"), F.round(S.volume_hs_bonus(x(0, "vol"), x(1, "vol"), x(2, "vol")), 6).alias("shoulders"), S.min_span_ok(x(1, "pivot"), x(2, "pivot"), F.col("tf")).alias("apart"),
    )


def neckline(spark, sf_dir):
    return C.neckline(S.last_pivots(_pivots(spark, sf_dir), 2), 0.05).select("symbol", F.round("neckline", 6).alias("neckline"))


def tidal_wave(spark, sf_dir):
    """By levels of the confirmed zigzag swings of either timeframe."""
    found = []
    for minutes, threshold in ((5, 0.005), (15, 0.01)):
        bars = fixtures.intraday(spark, sf_dir, minutes)
        found.append(C.tidal_wave(folds.fold_series(bars, ("atr",)), S.cluster_levels(folds.zigzag_pivots(bars, threshold))))
    return found[0].unionByName(found[1])


def tidal_wave_scans(spark, sf_dir):
    """At every bar of the live scan, for both intraday timeframes."""
    found = [C.tidal_waves(folds.fold_series(fixtures.intraday(spark, sf_dir, m), ("atr",)), {"5min": 6, "15min": 4}) for m in (5, 15)]
    return found[0].unionByName(found[1])


def price_in_zone(spark, sf_dir):
    """Bars whose close lies in the zone of one of their series' levels."""
    levels = S.cluster_levels(_pivots(spark, sf_dir)).select("symbol", "tf", (F.col("price") - F.col("width")).alias("low"), (F.col("price") + F.col("width")).alias("high"))
    bars = resample.with_index(fixtures.daily(spark, sf_dir))
    return S.zones_of(bars, levels).groupBy("symbol", "k").agg(F.count("*").alias("zones"))


def results_sink(spark, sf_dir):
    """Statistics of a run written under its id, and read back by it."""
    from barlab.operators import stats

    folder = store.scratch_folder(spark)
    found = stats.pattern_stats(store.history_union(fixtures.trades(spark, sf_dir), fixtures.TRADE_TIES), "pattern_name").select("pattern_name", "n", "win", "loss")
    found.withColumn("run_id", F.lit("first")).write.partitionBy("run_id").mode("append").parquet(folder)
    found.where("n > 1800").withColumn("run_id", F.lit("second")).write.partitionBy("run_id").mode("append").parquet(folder)
    return spark.read.parquet(folder).where("run_id = 'second'").select("pattern_name", "n", "win", "loss")


def _pivots(spark, sf_dir, order: int = 5):
    return S.swing_pivots(resample.with_index(fixtures.daily(spark, sf_dir)), order)


def swing_pivots(spark, sf_dir):
    return _pivots(spark, sf_dir).select("symbol", "pivot", "confirm", "price", "kind")


def swing_helpers(spark, sf_dir):
    return S.swing_helpers(_pivots(spark, sf_dir)).drop("tf")


def fit_trendline(spark, sf_dir):
    out = S.fit_trendline(S.last_pivots(_pivots(spark, sf_dir), 6), "symbol", "tf", "kind")
    return out.select("symbol", "kind", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), "points", "start", "end")


def detect_channel(spark, sf_dir):
    out = S.channels(_pivots(spark, sf_dir, 3), 3, 0.3)
    return out.select("symbol", *(F.round(x, 5).alias(x) for x in ("width_start", "width_end", "mid_slope", "compression", "bars_to_meet")), "converging", "same_sign")


def cluster_levels(spark, sf_dir):
    return S.cluster_levels(_pivots(spark, sf_dir)).select("symbol", F.round("price", 4).alias("price"), "touches", F.round("width", 4).alias("width"), "type")


def detect_breakouts(spark, sf_dir):
    bars = resample.with_index(fixtures.daily(spark, sf_dir))
    return S.detect_breakouts(S.cluster_levels(_pivots(spark, sf_dir), 0.004), bars, 40).select("symbol", F.round("price", 4).alias("price"), "k", "side")


def nearest_level(spark, sf_dir):
    bars = resample.with_index(fixtures.daily(spark, sf_dir))
    return S.nearest_level(bars, _pivots(spark, sf_dir)).select("symbol", "k", "c", "level")


def horizontal_levels(spark, sf_dir):
    found = S.horizontal_levels(_pivots(spark, sf_dir), 0.008)
    return found.select("symbol", "side", "rank", F.round("price", 4).alias("price"), "touches", "strength", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def level_search(spark, sf_dir):
    """For every bar, the nearest level below, above and either way, and the targets by touches at least one ATR (here the mean range of 14 bars) away."""
    bars = resample.with_index(fixtures.daily(spark, sf_dir)).select("symbol", "tf", "k", "c", F.avg(F.col("h") - F.col("l")).over(I.frame(-13)).alias("atr"))
    levels = S.cluster_levels(_pivots(spark, sf_dir))
    out = S.level_targets(bars, levels)
    for direction in ("below", "above", "any"):
        found = S.nearest_level(bars, levels, direction).select("symbol", "tf", "k", F.col("level").alias(direction))
        out = out.join(found.hint("merge"), ["symbol", "tf", "k"], "left")
    return out.select("symbol", "k", *(F.round(x, 4).alias(x) for x in ("below", "above", "any", "target_long", "target_short")))


def swing_window(spark, sf_dir):
    """The last two highs and lows among the pivots of each series' bars 100 to 300, and all between."""
    found = S.pivots_between(_pivots(spark, sf_dir), F.lit(100), F.lit(300))
    last = S.last_pivots(found, 2).groupBy("symbol", "kind").agg(F.min("pivot").alias("earlier"), F.max("pivot").alias("last"), F.max_by("price", "pivot").alias("last_price"))
    return last.join(found.groupBy("symbol", "kind").agg(F.count("*").alias("pivots")).hint("merge"), ["symbol", "kind"])


def as_of_regime(spark, sf_dir):
    """Closed trades with the benchmark's last close at or before the entry."""
    trades = store.history_union(fixtures.trades(spark, sf_dir), fixtures.TRADE_TIES).select(F.lit("STANDARD").alias("market"), F.col("entered_at").alias("ts"), "id")
    ref = fixtures.daily(spark, sf_dir).where("symbol = 'STANDARD'").select(F.col("symbol").alias("market"), "ts", "c")
    return S.as_of_join(trades, ref, "market", "ts", ["c"]).select("id", "ts", "c")


def feature_vector(spark, sf_dir):
    out = G.feature_vector(fixtures.daily(spark, sf_dir), "STANDARD")
    return out.select("symbol", "ts", *(F.round(x, 5).alias(x) for x in (*score.FEATURES, "composite")))


def detect_regime(spark, sf_dir):
    return G.detect_regime(fixtures.daily(spark, sf_dir), "STANDARD").select("symbol", "ts", "regime")


def regime_alignment(spark, sf_dir):
    return G.detect_regime(fixtures.daily(spark, sf_dir), "STANDARD").select("symbol", "ts", G.alignment(F.col("regime"), F.lit("momentum")).cast("long").alias("momentum"), G.alignment(F.col("regime"), F.lit("breakout")).cast("long").alias("breakout"))


def relative_strength(spark, sf_dir):
    out = G.relative_strength(fixtures.intraday(spark, sf_dir), "view")
    return out.select("symbol", "day", *(F.round(x, 6).alias(x) for x in ("ret", "bret", "spread", "agreement")), "grade", "label")


def scan(spark, sf_dir):
    return compose.scan(fixtures.daily(spark, sf_dir), tfs=("1d",)).select("symbol", "pattern_name", "bias", "composite", F.col("rank").cast("long").alias("rank"))


def scored_scan(spark, sf_dir):
    """Each series' last signals by the seven factors."""
    out = compose.scored_scan(fixtures.daily(spark, sf_dir), "STANDARD", ("1d",))
    return out.select("symbol", "pattern_name", "bias", "bucket", "composite", F.round("confidence", 6).alias("confidence"), "multi_tf", "label")


def walk_forward_backtest(spark, sf_dir):
    """All daily series and all daily patterns."""
    out = compose.walk_forward_backtest(fixtures.daily(spark, sf_dir), D.daily_detectors())
    return out.select("symbol", "tf", "k", "pattern", "bias", "outcome", "r", "k_exit")


def breakout_study(spark, sf_dir):
    return compose.breakout_study(fixtures.intraday(spark, sf_dir)).withColumn("total_r", F.round("total_r", 6))


QUERIES = {
    f.__name__: f
    for f in (
        detect_daily, detect_daily_windows, detect_swing, detect_intraday, power_hour, chart_patterns, breaking_news, opening_range_break, ema_vwap_cross, fashionably_late, spencer, session_patterns, session_scalps, level_scalps, setup_gate, pivot_bonuses, neckline, tidal_wave, tidal_wave_scans, price_in_zone, results_sink, swing_pivots, swing_helpers, fit_trendline, detect_channel, cluster_levels, detect_breakouts, nearest_level, horizontal_levels, level_search, swing_window, as_of_regime,
        feature_vector, detect_regime, regime_alignment, relative_strength, scan, scored_scan, walk_forward_backtest, breakout_study,
    )
}


def _pv(order: int) -> str:
    return f"""{DAILY}, kb AS (SELECT *, {K} - 1 AS k FROM daily), pv AS (SELECT symbol, k AS pivot, k + {order} AS confirm, h AS price, 'high' AS kind FROM (SELECT *, h > max(h) OVER {over(-order, -1)} AND h > max(h) OVER {over(1, order)} AS z FROM kb) WHERE z
      UNION ALL SELECT symbol, k, k + {order}, l, 'low' FROM (SELECT *, l < min(l) OVER {over(-order, -1)} AND l < min(l) OVER {over(1, order)} AS z FROM kb) WHERE z)"""


_LASTP = ", lp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY \"pivot\" DESC) AS r FROM pv) WHERE r <= {})"
_WIDE = f"""{_D}, {ATR_SQL}, w AS (SELECT d.symbol, d.ts, d.k, y AS atr, h, l, c, o, v, avg(c) OVER {over(-19)} AS sma20, CASE WHEN k >= 50 THEN avg(c) OVER {over(-49)} END AS sma50, avg(v) OVER {over(-19)} AS v20, avg(v) OVER {over(-49)} AS v50,
  max(h) OVER {over(-30, -1)} AS hi30, min(l) OVER {over(-9)} AS lo10, max(h) OVER {over(-9)} AS hi10, avg(h - l) OVER {over(-10, -1)} AS r10, max(h) OVER {over(-251)} AS hi252,
  {lag('c', 4)} AS c4, {lag('c', 164)} AS c164, {lag('c', 62)} AS c62, CASE WHEN k >= 200 THEN avg(c) OVER {over(-199)} END AS sma200, avg(h - l) OVER {over(-19, -1)} AS r19,
  CASE WHEN k > 60 THEN stddev_pop(diff::DOUBLE / (c - diff)) OVER {over(-59)} * sqrt(252) END AS vol60, CASE WHEN k > 252 THEN stddev_pop(diff::DOUBLE / (c - diff)) OVER {over(-251)} * sqrt(252) END AS vol252
  FROM d LEFT JOIN atr USING (symbol, k) JOIN (SELECT symbol, ts, o, v FROM daily) USING (symbol, ts))"""


def _pattern(name: str, bias: str, least: int, when: str, stop: str, t1: str, t2: str, conf: str) -> str:
    return f"SELECT symbol, '1d' AS tf, ts, '{name}' AS pattern, '{bias}' AS bias, c::DOUBLE AS entry, {stop} AS stop, {t1} AS t1, {t2} AS t2, least(0.95, {conf})::DOUBLE AS confidence FROM w WHERE k >= {least} AND atr > 0 AND {when}"


_LS, _SS = "(greatest(lo10, c - 2 * atr) - 0.1::DOUBLE * atr)", "(least(hi10, c + 2 * atr) + 0.1::DOUBLE * atr)"
_SIGS = " UNION ALL ".join(
    [
        _pattern("momentum_breakout", "long", 50, "c > hi30 AND c >= sma50 AND v >= 2.5 * v20", "c - 2 * atr", "c + 2 * atr", "c + 4.5::DOUBLE * atr", "0.58"),
        _pattern("range_expansion_long", "long", 20, "k > 10 AND h - l >= 2 * r10 AND v >= 1.3::DOUBLE * v20 AND c > o AND c > sma20", _LS, f"c + (c - {_LS})", f"c + 2 * (c - {_LS})", "0.54"),
        _pattern("range_expansion_short", "short", 20, "k > 10 AND h - l >= 2 * r10 AND v >= 1.3::DOUBLE * v20 AND c < o AND c < sma20", _SS, f"c + (c - {_SS})", f"c + 2 * (c - {_SS})", "0.54"),
        _pattern("volume_breakout_long", "long", 20, "v >= 3 * v20 AND c > o", _LS, f"c + (c - {_LS})", f"c + 2 * (c - {_LS})", "CASE WHEN c > sma20 THEN 0.56 ELSE 0.51 END"),
        _pattern("volume_breakout_short", "short", 20, "v >= 3 * v20 AND c < o", _SS, f"c + (c - {_SS})", f"c + 2 * (c - {_SS})", "CASE WHEN c < sma20 THEN 0.56 ELSE 0.51 END"),
        _pattern("rs_persistence_long", "long", 60, "c / sma50 >= 1.14::DOUBLE AND c >= sma20", "c - 2 * atr", "c + 2 * atr", "c + 4 * atr", "0.56 + CASE WHEN v20 > v50 THEN 0.05 ELSE 0 END + CASE WHEN c / sma50 > 1.10 THEN 0.05 ELSE 0 END"),
        *(_pattern(f"ts_momentum_{b}", b, 165, f"vol60 > 0 AND {s} * (c4::DOUBLE / nullif(c164, 0) - 1) > 0.10::DOUBLE", f"c - {s} * 2 * atr", f"c + {s} * 2 * atr", f"c + {s} * 4 * atr", "0.55::DOUBLE + least(abs(c4::DOUBLE / nullif(c164, 0) - 1) / 0.30::DOUBLE, 1) * 0.10::DOUBLE") for b, s in (("long", "1"), ("short", "-1"))),
        *(_pattern(f"atr_expansion_{b}", b, 30, f"(h - l) / nullif(r19, 0) >= 1.8::DOUBLE AND v >= 1.3::DOUBLE * v20 AND {at}", f"{edge} - {s} * 0.1::DOUBLE * atr", f"c + {s} * 1.5::DOUBLE * atr", f"c + {s} * 3 * atr", "0.56::DOUBLE + least(0.10::DOUBLE, ((h - l) / nullif(r19, 0) - 1.8::DOUBLE) * 0.05::DOUBLE)")
          for b, s, edge, at in (("long", "1", "l", "coalesce((c - l)::DOUBLE / nullif(h - l, 0), 0.5) > 0.65::DOUBLE"), ("short", "-1", "h", "coalesce((c - l)::DOUBLE / nullif(h - l, 0), 0.5) < 0.35::DOUBLE"))),
        _pattern("low_vol_long", "long", 253, "vol60 / vol252 <= 0.75::DOUBLE AND vol60 > 0 AND c >= sma50 AND c >= sma200", "c - 2 * atr", "c + 2 * atr", "c + 4 * atr", "0.58::DOUBLE + (0.75::DOUBLE - vol60 / vol252) * 0.15::DOUBLE"),
        _pattern("bab_long", "long", 120, "vol60 <= 0.35::DOUBLE AND c >= sma50 AND c >= coalesce(sma200, sma50) AND c >= c62", "c - 2 * atr", "c + 2 * atr", "c + 4 * atr", "0.58::DOUBLE + (0.35::DOUBLE - vol60) * 0.20::DOUBLE"),
        _pattern("high_momentum_52w", "long", 252, "hi252 > 0 AND (hi252 - c)::DOUBLE / hi252 <= 0.05::DOUBLE AND v >= 0.8::DOUBLE * v20", "c - 2.5::DOUBLE * atr", "hi252::DOUBLE", "hi252 + 2 * atr", "0.58::DOUBLE + (0.05::DOUBLE - (hi252 - c)::DOUBLE / hi252) * 2"),
    ]
)
_REG = f"""{_D}, {ATR_SQL}, m AS (SELECT symbol, ts, k, c, CASE WHEN count(y) OVER {over(-1000000)} >= 19 AND quantile_cont(y, 0.5) OVER {over(-73, -14)} > 0 THEN y / quantile_cont(y, 0.5) OVER {over(-73, -14)} ELSE 1 END AS ratio,
  CASE WHEN k >= 200 THEN avg(c) OVER {over(-199)} WHEN k >= 50 THEN avg(c) OVER {over(-49)} END AS anchor FROM d LEFT JOIN atr USING (symbol, k)), g AS (SELECT *, anchor / {lag('anchor', 19)} - 1 AS slope FROM m),
  reg AS (SELECT symbol, ts, CASE WHEN k < 30 OR anchor IS NULL THEN 'mean_reverting' WHEN ratio > 1.8 THEN 'high_volatility' WHEN c > anchor AND slope > 0.005 THEN 'trending_bull' WHEN c < anchor AND slope < -0.005 THEN 'trending_bear' ELSE 'mean_reverting' END AS regime FROM g)"""
ORACLE_SQL = {
    "detect_daily_windows": f"WITH RECURSIVE {_WIDE}, s AS ({_SIGS}) SELECT symbol, tf, ts, pattern, bias, round(entry, 6) AS entry, round(stop, 6) AS stop, round(t1, 6) AS t1, round(t2, 6) AS t2, round(confidence, 6) AS confidence FROM s WHERE round(abs(t2 - entry) / nullif(abs(entry - stop), 0), 2) >= 1",
    "breaking_news": f"""WITH {DAILY}, w AS (SELECT *, {K} AS k, avg(v) OVER {over(-11, -2)} AS vol, avg(h - l) OVER {over(-11, -2)} AS sp FROM daily),
      s AS (SELECT symbol, ts, 'breaking_news' AS pattern, CASE WHEN c > o THEN 'long' ELSE 'short' END AS bias, c::DOUBLE AS entry, CASE WHEN c > o THEN l - 2 ELSE h + 2 END::DOUBLE AS stop, round(least(0.85, 0.45::DOUBLE + CASE WHEN v > 5 * vol THEN 0.15 ELSE 0 END + CASE WHEN h - l > 3 * sp THEN 0.10 ELSE 0 END), 6) AS confidence
        FROM w WHERE k >= 12 AND vol > 0 AND v >= 3 * vol AND sp > 0 AND h - l >= 2 * sp) SELECT *, 3 * entry - 2 * stop AS target FROM s""",
    "setup_gate": f"""WITH {DAILY}, b AS (SELECT symbol, ts, {K} - 1 AS k, h, l, c, max(h) OVER {over(-20, -1)} AS hi, lead(c, 3) OVER (PARTITION BY symbol ORDER BY ts) AS price, greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')}))::DOUBLE AS tr FROM daily),
      w AS (SELECT *, list(tr) OVER {over(-19)} AS t, list((h - l)::DOUBLE) OVER {over(-19)} AS r FROM b), x AS (SELECT *, list_concat([r[1]], t[2:]) AS z FROM w),
      a AS (SELECT *, CASE WHEN k % 3 > 0 THEN CASE WHEN len(z) >= 14 THEN list_reduce(list_concat([list_sum(z[1:14]) / 14], z[15:]), lambda a, b: (a * 13 + b) / 14) ELSE 0 END END AS atr FROM x WHERE k >= 20 AND c > hi AND price IS NOT NULL),
      s AS (SELECT symbol, k, c::DOUBLE AS entry, l - 200.0::DOUBLE AS stop, c + 900.0::DOUBLE AS target, price, CASE WHEN atr > 0 THEN atr ELSE price * 0.01::DOUBLE END AS a FROM a)
      SELECT symbol, k, entry, round((target - entry) / (entry - stop), 2) AS rr, CASE WHEN k % 2 = 0 THEN entry + (entry - stop) ELSE entry + 250 END AS t1, target AS t2, round(least(0.95, 0.9::DOUBLE + k % 10 / 100.0::DOUBLE), 6) AS confidence
      FROM s WHERE entry > stop AND round((target - entry) / (entry - stop), 2) >= 1 AND price <= entry + a * 0.5::DOUBLE""",
    "pivot_bonuses": f"""WITH {_pv(5)}{_LASTP.format(3)}, m AS (SELECT symbol, {K} - 1 AS k, avg(v) OVER {over(-2, 2)} AS vol FROM daily), j AS (SELECT lp.symbol, kind, lp."pivot" AS p, vol, r FROM lp JOIN m ON m.symbol = lp.symbol AND m.k = lp."pivot"),
      g AS (SELECT symbol, kind, max(vol) FILTER (r = 3) AS a, max(vol) FILTER (r = 2) AS b, max(vol) FILTER (r = 1) AS c, max(p) FILTER (r = 1) - max(p) FILTER (r = 2) AS d, count(*) AS n FROM j GROUP BY ALL HAVING count(*) = 3)
      SELECT symbol, kind, CASE WHEN b <= 0 THEN 0 WHEN c < b * 0.85::DOUBLE THEN 0.08 WHEN c < b THEN 0.04 ELSE 0 END::DOUBLE AS touch, round(CASE WHEN a <= 0 THEN 0 ELSE (b < a)::INT * 0.04 + (c < b)::INT * 0.04 + (a > b AND b > c)::INT * 0.04 END, 6)::DOUBLE AS shoulders, d >= 15 AS apart FROM g""",
    "neckline": f"WITH {_pv(5)}{_LASTP.format(2)}, a AS (SELECT symbol, avg(price) AS m, max(price) AS t, min(price) AS b FROM lp WHERE kind = 'low' GROUP BY 1) SELECT symbol, round(m, 6) AS neckline FROM a WHERE greatest(t - m, m - b) <= 0.05 * m",
    "results_sink": f"WITH {CLOSED} SELECT pattern_name, count(*) AS n, count(*) FILTER (outcome = 'win') AS win, count(*) FILTER (outcome = 'loss') AS loss FROM closed GROUP BY 1 HAVING count(*) > 1800",
    "swing_pivots": f"WITH {_pv(5)} SELECT * FROM pv",
    "swing_helpers": f"WITH {_pv(5)} SELECT symbol, count(*) FILTER (kind = 'high') AS highs, count(*) FILTER (kind = 'low') AS lows, max(price) FILTER (kind = 'high') AS highest, min(price) FILTER (kind = 'low') AS lowest, arg_max(price, (\"pivot\", kind)) AS last_price, max(price) - min(price) AS price_range FROM pv GROUP BY 1",
    "fit_trendline": f"WITH {_pv(5)}{_LASTP.format(6)} SELECT symbol, kind, round(regr_slope(price, \"pivot\"), 6) AS slope, round(coalesce(regr_r2(price, \"pivot\"), 0), 6) AS r2, count(*) AS points, min(\"pivot\") AS start, max(\"pivot\") AS \"end\" FROM lp GROUP BY ALL",
    "swing_window": f"""WITH {_pv(5)}, w AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY "pivot" DESC) AS r, count(*) OVER (PARTITION BY symbol, kind) AS pivots FROM pv WHERE "pivot" BETWEEN 100 AND 300)
      SELECT symbol, kind, min("pivot") AS earlier, max("pivot") AS last, arg_max(price, "pivot") AS last_price, any_value(pivots) AS pivots FROM w WHERE r <= 2 GROUP BY ALL""",
    "nearest_level": f"WITH {_pv(5)} SELECT b.symbol, k, c, arg_min(price, (abs(price - c), price)) AS level FROM kb b JOIN pv USING (symbol) GROUP BY ALL",
    "as_of_regime": f"WITH {CLOSED}, {DAILY}, m AS (SELECT ts AS mts, c FROM daily WHERE symbol = 'STANDARD') SELECT id, entered_at AS ts, c FROM closed ASOF LEFT JOIN m ON entered_at >= mts",
    "detect_regime": f"WITH RECURSIVE {_REG} SELECT symbol, ts, regime FROM reg",
    "regime_alignment": f"WITH RECURSIVE {_REG} SELECT symbol, ts, " + ", ".join(f"(CASE regime {' '.join(f'''WHEN '{r}' THEN {x}''' for (r, k2), x in G.ALIGNMENT.items() if k2 == kind)} END)::BIGINT AS {kind}" for kind in ("momentum", "breakout")) + " FROM reg",
    "relative_strength": f"""WITH {HOURLY}, m AS (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts DESC) AS rn, sign(c - o) AS mv FROM hourly),
      d AS (SELECT symbol, day, (arg_max(c, ts)::DOUBLE / arg_min(o, ts) - 1) * 100 AS ret, count(*) AS n FROM m GROUP BY ALL), a AS (SELECT m.symbol, m.day, avg((m.mv = b.mv)::INT) * 100 AS agr FROM m JOIN m b ON b.symbol = 'view' AND b.day = m.day AND b.rn = m.rn GROUP BY ALL),
      z AS (SELECT d.symbol, d.day, d.ret, b.ret AS bret, agr FROM d JOIN d b ON b.symbol = 'view' AND b.day = d.day JOIN a ON a.symbol = d.symbol AND a.day = d.day WHERE d.n >= 3)
      SELECT symbol, day, round(ret, 6) AS ret, round(bret, 6) AS bret, round(ret - bret, 6) AS spread, round(agr, 6) AS agreement, CASE WHEN agr <= 30 THEN 'A' WHEN agr <= 45 THEN 'B' WHEN agr <= 60 THEN 'C' WHEN agr <= 75 THEN 'D' ELSE 'F' END AS grade,
        CASE WHEN ret > 0.05 AND bret < -0.05 THEN 'Relative Strength' WHEN ret < -0.05 AND bret > 0.05 THEN 'Relative Weakness' WHEN ret > 0.05 AND bret > 0.05 THEN (CASE WHEN ret - bret > 0.3 THEN 'Outperforming' WHEN bret - ret > 0.3 THEN 'Lagging' ELSE 'In Line' END)
          WHEN ret < -0.05 AND bret < -0.05 THEN (CASE WHEN ret > 0.6 * bret THEN 'Holding Up' WHEN ret < 1.5 * bret THEN 'Underperforming' ELSE 'In Line' END) ELSE 'Neutral' END AS label FROM z""",
    "breakout_study": f"""WITH {HOURLY}, b AS (SELECT *, {K} - 1 AS k, CASE WHEN {K} > 20 THEN max(h) OVER {over(-20, -1)} END AS hi, CASE WHEN {K} > 20 THEN min(l) OVER {over(-20, -1)} END AS lo, ({K} <= 20 OR v >= 1.2::DOUBLE * avg(v) OVER {over(-20, -1)}) AS loud FROM hourly),
      s AS (SELECT symbol, k, CASE WHEN c > hi THEN 1 ELSE -1 END AS sg, c AS entry, greatest(hi - lo, 1) AS sp FROM b WHERE loud AND (c > hi OR c < lo)),
      f AS (SELECT s.symbol, s.k, s.sg, min(b.k) FILTER ((CASE WHEN sg = 1 THEN b.l ELSE -b.h END) <= sg * (entry - sg * sp)) AS ks, min(b.k) FILTER ((CASE WHEN sg = 1 THEN b.h ELSE -b.l END) >= sg * (entry + 2 * sg * sp)) AS kt FROM s JOIN b ON b.symbol = s.symbol AND b.k > s.k AND b.k <= s.k + 20 GROUP BY ALL)
      SELECT symbol, CASE WHEN sg = 1 THEN 'long' ELSE 'short' END AS bias, count(*) AS n, count(*) FILTER (kt IS NOT NULL AND (ks IS NULL OR kt < ks)) AS wins, count(*) FILTER (ks IS NOT NULL AND NOT coalesce(kt < ks, false)) AS losses,
        round(sum(CASE WHEN kt IS NOT NULL AND (ks IS NULL OR kt < ks) THEN 2.0::DOUBLE WHEN ks IS NOT NULL THEN -1.0::DOUBLE END), 6) AS total_r FROM f GROUP BY ALL""",
}
