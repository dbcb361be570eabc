"""DuckDB's SQL of the features, of trades bar by bar and of the patterns within a session."""

from __future__ import annotations

from barlab.queries.detectors import _pattern
from barlab.queries.folds import _D, ATR_SQL, ema_sql
from barlab.queries.outcomes import _B, HOLD, _met
from barlab.queries.pattern_sql import _GATED
from barlab.queries.sql import FIVE, QUARTER, lag, over

_POS = "(c - min(l) OVER {0}) * 100.0::DOUBLE / nullif(max(h) OVER {0} - min(l) OVER {0}, 0)"


def _clip(x: str) -> str:
    return f"greatest(0, least(100, {x}))"


def _roc(n: int) -> str:
    return _clip(f"(c::DOUBLE / {lag('c', n)} - 1 + 0.10::DOUBLE) / 0.20::DOUBLE * 100")


_FEATURES = f"""{_D}, {ATR_SQL}, {ema_sql('a', 9, False)}, {ema_sql('b', 21, False)},
  f AS (SELECT d.symbol, d.ts, d.k, d.h, d.l, d.c, v, atr.y AS atr, a.y AS e9, b.y AS e21, CASE WHEN c::DOUBLE / nullif(c - diff, 0) > 0 THEN ln(c::DOUBLE / (c - diff)) END AS ret FROM d LEFT JOIN atr USING (symbol, k) LEFT JOIN a USING (symbol, k) LEFT JOIN b USING (symbol, k) JOIN (SELECT symbol, ts, v FROM daily) USING (symbol, ts)),
  x AS (SELECT *, CASE WHEN count(atr) OVER {over(-1000000)} >= 19 AND quantile_cont(atr, 0.5) OVER {over(-73, -14)} > 0 THEN atr / quantile_cont(atr, 0.5) OVER {over(-73, -14)} ELSE 1 END AS ratio,
    stddev_pop(ret) OVER {over(-9)} / nullif(stddev_pop(ret) OVER {over(-59)}, 0) AS vr, avg(v) OVER {over(-2)} / nullif(avg(v) OVER {over(-22, -3)}, 0) AS rv, {_roc(5)} AS r5, {_roc(20)} AS r20, {_roc(60)} AS r60,
    CASE WHEN k >= 20 THEN avg(c) OVER {over(-19)} END AS s20, CASE WHEN k >= 50 THEN avg(c) OVER {over(-49)} END AS s50, CASE WHEN k >= 200 THEN avg(c) OVER {over(-199)} END AS s200, stddev_pop(c) OVER {over(-19)} AS dev,
    {_POS.format(over(-19))} AS p20, CASE WHEN k > 50 THEN {_POS.format(over(-49))} END AS p50, {lag('c', 20)} AS back FROM f),
  m AS (SELECT ts, c AS bc, s20 AS b20, s50 AS b50, back AS blag FROM x WHERE symbol = 'STANDARD'),
  g AS (SELECT x.symbol, ts, CASE WHEN k < 10 THEN 50 WHEN k > 60 THEN 0.2::DOUBLE * r5 + 0.3::DOUBLE * r20 + 0.5::DOUBLE * r60 WHEN k > 20 THEN 0.3::DOUBLE * r5 + 0.7::DOUBLE * r20 ELSE r5 END AS momentum,
    CASE WHEN k < 25 OR vr IS NULL THEN 50 ELSE {_clip('(vr - 0.3::DOUBLE) / 1.7::DOUBLE * 100')} END AS volatility, CASE WHEN k < 30 THEN 50 ELSE {_clip('(1.5::DOUBLE - ratio) / 1.1::DOUBLE * 100')} END AS vol_compression,
    CASE WHEN k < 15 OR rv IS NULL THEN 50 ELSE {_clip('sqrt(rv) * 50')} END AS volume,
    CASE WHEN k < 10 THEN 50 ELSE coalesce(((c > e9)::INT + (c > e21)::INT + (c > s50)::INT + (c > s200)::INT) * 100.0::DOUBLE, (coalesce((c > e9)::INT, 0) + coalesce((c > e21)::INT, 0) + coalesce((c > s50)::INT, 0)) * 400.0::DOUBLE / nullif((e9 IS NOT NULL)::INT + (e21 IS NOT NULL)::INT + (s50 IS NOT NULL)::INT, 0)) / 4 END AS trend,
    CASE WHEN k < 22 THEN 50 ELSE coalesce(0.6::DOUBLE * p20 + 0.4::DOUBLE * p50, p20, p50, 50) END AS breakout, CASE WHEN k < 22 OR dev = 0 THEN 50 ELSE {_clip('abs((c - s20) / dev) / 3 * 100')} END AS mean_reversion,
    CASE WHEN bc IS NULL OR b50 IS NULL THEN 50 WHEN bc > b20 AND bc > b50 AND bc > blag THEN 80 WHEN bc > b50 THEN 55 WHEN bc < b20 AND bc < b50 THEN 25 ELSE 50 END::DOUBLE AS regime FROM x LEFT JOIN m USING (ts))"""
_WEIGHTED = " + ".join(f"{w}::DOUBLE * {k}" for k, w in (("momentum", 0.18), ("volatility", 0.10), ("vol_compression", 0.12), ("volume", 0.15), ("trend", 0.15), ("breakout", 0.12), ("mean_reversion", 0.08), ("regime", 0.10)))

# A trade's state after each bar of its span.
_STOPPED = "(status = 'STOPPED' OR worst <= sg * lf.stop)"
_LIFE = f"""WITH RECURSIVE {_B}, {_met(HOLD)}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol, k ORDER BY bk) AS i FROM met),
  lf(symbol, k, i, status, stop, stopped_at, peak) AS (SELECT symbol, k, 0::BIGINT, 'ACTIVE', stop, NULL::BIGINT, 0::BIGINT FROM p WHERE i = 1
    UNION ALL SELECT p.symbol, p.k, p.i, CASE WHEN {_STOPPED} THEN 'STOPPED' WHEN status = 'ACTIVE' AND best >= sg * t1 THEN 'AT_T1' WHEN status = 'AT_T1' AND best >= sg * t2 THEN 'TRAILING' ELSE status END,
      CASE WHEN {_STOPPED} THEN lf.stop WHEN status = 'ACTIVE' AND best >= sg * t1 THEN entry WHEN status = 'TRAILING' THEN sg * greatest(sg * lf.stop, sg * bc - abs(entry - p.stop)) ELSE lf.stop END,
      CASE WHEN status <> 'STOPPED' AND {_STOPPED} THEN bk ELSE stopped_at END, CASE WHEN status = 'STOPPED' THEN peak ELSE greatest(peak, best - sg * entry) END
    FROM lf JOIN p ON p.symbol = lf.symbol AND p.k = lf.k AND p.i = lf.i + 1),
  life AS (SELECT symbol, k, arg_max(status, i) AS status, arg_max(stop, i) AS last_stop, max(stopped_at) AS stopped_at, max(peak) AS peak FROM lf GROUP BY ALL)"""

# Bars with their session: its start, the VWAP from it on, and the bar's place in the day.
_DAY = "(PARTITION BY symbol, day)"
_SO_FAR = "(PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def _sessions(table: str) -> str:
    return f"""sb AS (SELECT symbol, ts, o, h, l, c, v, ts::DATE AS day, hour(ts) * 60 + minute(ts) AS mi, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM {table}),
  so AS (SELECT *, coalesce(min(CASE WHEN mi >= 570 THEN ts END) OVER {_DAY}, min(ts) OVER {_DAY}) AS opened FROM sb),
  ses AS (SELECT *, sum(CASE WHEN ts >= opened THEN (h + l + c) * v END) OVER {_SO_FAR} / 3.0::DOUBLE / nullif(sum(CASE WHEN ts >= opened THEN v END) OVER {_SO_FAR}, 0) AS sv, row_number() OVER {_SO_FAR} AS n_day,
    first_value(o) OVER {_SO_FAR} AS first_o, first_value(h) OVER {_SO_FAR} AS first_h, max(h) OVER {_SO_FAR} AS top, min(l) OVER {_SO_FAR} AS bottom, {lag('c')} AS prev, greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')}))::DOUBLE AS tr FROM so)"""


_E9 = """e9(symbol, k, y) AS (SELECT symbol, 9::BIGINT, avg(c)::DOUBLE FROM ses WHERE k <= 9 GROUP BY symbol HAVING max(k) = 9 UNION ALL SELECT s.symbol, s.k, y * 0.8::DOUBLE + s.c * 0.2::DOUBLE FROM e9 JOIN ses s ON s.symbol = e9.symbol AND s.k = e9.k + 1)"""
_WILDER = """wa(symbol, k, atr) AS (SELECT symbol, 14::BIGINT, avg(tr) FROM ses WHERE k <= 14 GROUP BY symbol HAVING max(k) = 14 UNION ALL SELECT s.symbol, s.k, (atr * 13 + s.tr) / 14 FROM wa JOIN ses s ON s.symbol = wa.symbol AND s.k = wa.k + 1)"""
_CROSS = f"""WITH RECURSIVE {FIVE}, {_sessions('five')}, {_E9}, j AS (SELECT ses.*, y FROM ses LEFT JOIN e9 USING (symbol, k)),
  q AS (SELECT *, {lag('y', 1)} AS y1, {lag('y', 3)} AS y3, {lag('sv', 1)} AS w1, {lag('sv', 5)} AS w5 FROM j), x AS (SELECT * FROM q WHERE y1 < w1 AND y >= sv AND y > y3 AND sv - w5 <= 0.001::DOUBLE * sv AND n_day > 10)"""
_OUT = "round(entry, 5) AS entry, round(stop, 5) AS stop, round(target, 5) AS target, round(confidence, 5) AS confidence"
_BASE = f"""base AS (SELECT *, n_day - 1 AS i, list(h) OVER {over(-20, -1)} AS hs, list(l) OVER {over(-20, -1)} AS ls, list(v) OVER {over(-20, -1)} AS vs, first_value(prev) OVER {_SO_FAR} AS before FROM ses)"""


def _opening(minutes: int) -> str:
    inside = f"ts >= opened AND ts <= opened + INTERVAL {minutes} MINUTE"
    return f"""oa{minutes} AS (SELECT *, max(CASE WHEN {inside} THEN h END) OVER {_DAY} AS hi, min(CASE WHEN {inside} THEN l END) OVER {_DAY} AS lo, avg(CASE WHEN {inside} THEN v END) OVER {_DAY} AS vo, arg_min(c, CASE WHEN {inside} THEN ts END) OVER {_DAY} AS co FROM so),
  ob{minutes} AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts) AS i, hi - lo AS sp FROM oa{minutes} WHERE ts > opened + INTERVAL {minutes} MINUTE),
  oc{minutes} AS (SELECT *, c > hi AND hi - l + 4 > 0 AND hi - l + 4 <= sp AS up, c < lo AND h - lo + 4 > 0 AND h - lo + 4 <= sp AS down FROM ob{minutes} WHERE i <= 29 AND sp > 0),
  od{minutes} AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY ts) AS place FROM oc{minutes} WHERE up OR down),
  oe{minutes} AS (SELECT symbol, ts, 'orb_{minutes}' AS pattern, CASE WHEN up THEN 'long' ELSE 'short' END AS bias, CASE WHEN up THEN hi + 2 ELSE lo - 2 END::DOUBLE AS entry, CASE WHEN up THEN l - 2 ELSE h + 2 END::DOUBLE AS stop, CASE WHEN up THEN hi + 2 + 2 * sp ELSE lo - 2 - 2 * sp END::DOUBLE AS target,
    CASE WHEN up THEN 0.50::DOUBLE + CASE WHEN v > 1.5::DOUBLE * vo THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN sp < 0.02::DOUBLE * co THEN 0.05::DOUBLE ELSE 0 END ELSE 0.55::DOUBLE END AS confidence FROM od{minutes} WHERE place = 1)"""


# What the 5-minute patterns read, by bar.
_AT_OPEN = "first_value({}) OVER " + _SO_FAR
_RSI = "CASE WHEN loss{0} = 0 THEN 100 ELSE 100 - 100 / (1 + gain{0} / loss{0}) END"


def _smooth(name: str, n: int, sign: str) -> str:
    """Wilder's mean of the rises (or falls) among the first `n` of 20 closes."""
    side = f"[greatest({sign}(cs[i + 1] - cs[i]), 0)::DOUBLE for i in range(1, {n})]"
    return f"list_reduce(list_concat([list_sum(({side})[1:14]) / 14], ({side})[15:]), lambda a, b: (a * 13 + b) / 14) AS {name}{n}"


_FIVE = f"""{FIVE}, {_sessions('five')}, {_WILDER}, em(symbol, k, e21) AS (SELECT symbol, 1::BIGINT, c::DOUBLE FROM ses WHERE k = 1 UNION ALL SELECT s.symbol, s.k, e21 + (s.c - e21) / 11 FROM em JOIN ses s ON s.symbol = em.symbol AND s.k = em.k + 1),
  j AS (SELECT ses.*, atr, e21 FROM ses JOIN em USING (symbol, k) LEFT JOIN wa USING (symbol, k)),
  i1 AS (SELECT *, CASE WHEN k >= 50 THEN avg(c) OVER {over(-49)} END AS sma50, stddev_pop(c) OVER {over(-49)} AS dev50, quantile_cont(atr, 0.5) OVER {over(-53, -14)} AS past60, coalesce(v <= 1.3::DOUBLE * avg(v) OVER {over(-3, -1)}, false) AS dry, {lag('e21', 5)} AS e21b,
    {', '.join(f"min(l) OVER {over(1 - n)} AS lo{n}, max(h) OVER {over(1 - n)} AS hi{n}" for n in (5, 10, 20))}, count(*) FILTER (c < o) OVER {over(-3, -1)} AS reds, count(*) FILTER (c > o) OVER {over(-3, -1)} AS greens,
    avg(v) OVER {over(-29)} AS v30, avg(v) OVER {over(-9)} AS v10, avg(v) OVER {over(-30, -1)} AS b30, avg(v) OVER {over(-20, -1)} AS b20, avg(v) OVER {over(-1000000, -1)} AS b_all, lag(day) OVER (PARTITION BY symbol ORDER BY ts) AS day_before,
    CASE WHEN k > 9 THEN min(l) OVER {over(-9, -1)} END AS lo9, CASE WHEN k > 9 THEN max(h) OVER {over(-9, -1)} END AS hi9, CASE WHEN k >= 20 THEN list(c) OVER {over(-19)} END AS cs,
    list({{'c': c, 'h': h, 'l': l, 'v': v, 'm': mi}}) OVER {_SO_FAR} AS d, stddev_pop(c) OVER {_SO_FAR} AS spread FROM j),
  i2 AS (SELECT *, CASE WHEN k >= 19 AND past60 > 0 THEN atr / past60 ELSE 1 END AS ratio, (c - sma50) / nullif(dev50, 0) AS z, CASE WHEN {_AT_OPEN.format('day_before')} = day - 1 THEN {_AT_OPEN.format('prev')} END AS prior, {_AT_OPEN.format('b30')} AS o30, {_AT_OPEN.format('b20')} AS o20, {_AT_OPEN.format('b_all')} AS o_all,
    {_AT_OPEN.format('v')} AS first_v, {_AT_OPEN.format('k')} AS n0, d[1:6] AS six, list_filter(d, lambda x: x.m < 690) AS am, {_smooth('gain', 20, '')}, {_smooth('loss', 20, '-')}, {_smooth('gain', 15, '')}, {_smooth('loss', 15, '-')} FROM i1),
  i3 AS (SELECT *, CASE WHEN k < 50 THEN 'unknown' WHEN c > sma50 AND ratio > 0.8::DOUBLE THEN 'bull' WHEN c < sma50 AND ratio > 0.8::DOUBLE THEN 'bear' WHEN ratio < 0.6::DOUBLE THEN 'reverting' ELSE 'mixed' END AS hint, first_o - prior AS gap, (first_o - prior)::DOUBLE / prior AS share,
    list_avg([x.v for x in d[1:3]]) AS first3, (c - sv) / nullif(spread, 0) AS sigma, six[-1].c - first_o AS drive, list_sum([x.v for x in six]) AS vol6, list_min([x.l for x in six]) AS low6, list_max([x.h for x in six]) AS high6, am[-1].c AS noon, am[-1].c - first_o AS moved,
    len(list_filter(d, lambda x: x.c > sv))::DOUBLE / n_day AS above, len(list_filter(d, lambda x: (abs(x.l - sv) < 0.3::DOUBLE * atr AND x.c > sv) OR (abs(x.h - sv) < 0.3::DOUBLE * atr AND x.c < sv))) AS tests, {_RSI.format(20)} AS rsi, {_RSI.format(15)} AS rsi_before FROM i2),
  w AS (SELECT *, CASE WHEN sv > 0 THEN sv ELSE c - z * dev50 END AS goal, hint NOT IN ('bull', 'bear') AS calm, (0.58::DOUBLE + CASE WHEN dry THEN 0.05::DOUBLE ELSE 0 END) * CASE WHEN hint = 'reverting' THEN 1.1::DOUBLE WHEN hint IN ('bull', 'bear') THEN 0.9::DOUBLE ELSE 1 END AS conf FROM i3)"""


def _sides(name: str, least: int, both: str, whens: tuple[str, str], stops: tuple[str, str], t1: tuple[str, str] | float, t2: tuple[str, str] | float, conf: str | tuple[str, str]) -> list[str]:
    """A 5-minute pattern's two sides; numbers are ATRs from the close."""
    at = lambda t, i: f"c {'+-'[i]} {t}::DOUBLE * atr" if isinstance(t, (int, float)) else t[i]
    return [_pattern(f"{name}_{b}", b, least, f"{both} AND {whens[i]}", stops[i], at(t1, i), at(t2, i), conf if isinstance(conf, str) else conf[i]).replace("'1d' AS tf", "'5min' AS tf") for i, b in enumerate(("long", "short"))]


def _beyond(low: str, high: str, by: float) -> tuple[str, str]:
    return f"{low} - {by}::DOUBLE * atr", f"{high} + {by}::DOUBLE * atr"


_PULL = _beyond("lo5", "hi5", 0.1)
_HALF_WAY = ("(first_o + prior) / 2.0::DOUBLE",) * 2
_INTRADAY = [
    *_sides("mean_reversion", 50, "hint IN ('reverting', 'mixed')", ("z < -2.5", "z > 2.5"), ("least(lo10, c - atr) - atr", "greatest(hi10, c + atr) + atr"), ("c + (goal - c) / 2", "c - (c - goal) / 2"), ("goal", "goal"), "conf"),
    *_sides("trend_pullback", 30, "abs(c - e21) <= 0.3::DOUBLE * atr", ("hint = 'bull' AND e21 > e21b AND hi10 - lo5 >= atr AND coalesce(c >= sv, true) AND reds > 0 AND c > o", "hint = 'bear' AND e21 < e21b AND hi5 - lo10 >= atr AND coalesce(c <= sv, true) AND greens > 0 AND c < o"), _PULL,
            tuple(f"2 * c - ({x})" for x in _PULL), (f"greatest(hi20, 3 * c - 2 * ({_PULL[0]}))", f"least(lo20, 3 * c - 2 * ({_PULL[1]}))"), ("0.66", "0.638")),
    *_sides("gap_fade", 10, "calm AND mi BETWEEN 570 AND 630 AND abs(share) >= 0.02::DOUBLE AND coalesce(first3 <= 3 * o_all, true)", ("gap < 0 AND c > first_o", "gap > 0 AND c < first_o"), ("first_o - 0.5::DOUBLE * abs(gap)", "first_o + 0.5::DOUBLE * abs(gap)"), _HALF_WAY, ("prior", "prior"), "0.55"),
    *_sides("vwap_reversion", 30, "calm AND mi BETWEEN 630 AND 840 AND n_day >= 10 AND abs(c - sv) >= 2 * atr", ("sigma < -2", "sigma > 2"), _beyond("lo10", "hi10", 0.2), ("sv - spread", "sv + spread"), ("sv", "sv"), "conf"),
    *_sides("gap_reversal", 20, "mi BETWEEN 585 AND 630 AND abs(share) BETWEEN 0.005::DOUBLE AND 0.03::DOUBLE", ("gap <= 0 AND c - first_o >= 0.3::DOUBLE * abs(gap)", "gap > 0 AND first_o - c >= 0.3::DOUBLE * abs(gap) AND coalesce(first_v <= 3 * o20, true)"), _beyond("first_o", "first_o", 0.1), ("(c + prior) / 2.0::DOUBLE",) * 2, ("prior", "prior"), "0.55"),
    *_sides("opening_drive", 20, "mi BETWEEN 600 AND 615 AND n_day >= 6 AND abs(drive) >= 0.5::DOUBLE * atr AND (n0 <= 31 OR vol6 >= 1.3::DOUBLE * 6 * o30)", ("drive > 0", "drive < 0"), _beyond("low6", "high6", 0.1), 1, 2, "0.56"),
    *_sides("volume_climax", 30, "mi BETWEEN 585 AND 930 AND v >= 4 * v30", ("l <= 1.002::DOUBLE * lo20 AND c > o AND NOT (h >= 0.998::DOUBLE * hi20 AND c < o)", "h >= 0.998::DOUBLE * hi20 AND c < o"), _beyond("l", "h", 0.1), 1, 2, "0.56::DOUBLE + least(0.10::DOUBLE, (v / nullif(v30, 0) - 3) * 0.02::DOUBLE)"),
    *_sides("vwap_trend", 40, "mi BETWEEN 630 AND 870 AND n_day >= 24 AND tests >= 2 AND abs(c - sv) <= 0.4::DOUBLE * atr", ("above > 0.75 AND c > sv", "above < 0.25 AND c < sv"), _beyond("sv", "sv", 0.15), 1, 2, "0.57"),
    *_sides("rsi_divergence", 30, "mi BETWEEN 585 AND 930 AND v <= 1.2::DOUBLE * v10", ("l < lo9 AND rsi > rsi_before AND rsi < 40", "h > hi9 AND rsi < rsi_before AND rsi > 60"), _beyond("l", "h", 0.1), 1, 2, "0.55"),
    *_sides("midday_reversal", 30, "mi BETWEEN 690 AND 750 AND len(am) >= 10 AND abs(moved) >= atr", ("moved < 0 AND c - noon >= 0.3::DOUBLE * abs(moved)", "moved > 0 AND noon - c >= 0.3::DOUBLE * moved"), _beyond("list_min([x.l for x in am])", "list_max([x.h for x in am])", 0.05), 1, 2, "0.55"),
]

QUERIES: dict = {}  # the other modules have them
ORACLE_SQL = {
    "detect_intraday": f"WITH RECURSIVE {_FIVE}, s AS ({' UNION ALL '.join(_INTRADAY)}) {_GATED}",
    "feature_vector": f"WITH RECURSIVE {_FEATURES} SELECT symbol, ts, {', '.join(f'round({k}, 5) AS {k}' for k in ('momentum', 'volatility', 'vol_compression', 'volume', 'trend', 'breakout', 'mean_reversion', 'regime'))}, round({_WEIGHTED}, 5) AS composite FROM g",
    "trade_lifecycle": f"{_LIFE} SELECT symbol, '1h' AS tf, k, bias, status, last_stop, stopped_at, peak FROM life JOIN (SELECT symbol, k, bias FROM sig) USING (symbol, k)",
    "overnight_flag": f"{_LIFE} SELECT symbol, k, status IN ('ACTIVE', 'AT_T1') AS overnight FROM life",
    "ema_vwap_cross": f"{_CROSS} SELECT symbol, ts, round(sv, 5) AS vwap, bottom AS day_low FROM x",
    "fashionably_late": f"{_CROSS}, s AS (SELECT symbol, ts, 'fashionably_late' AS pattern, 'long' AS bias, sv AS entry, sv - (sv - bottom) / 3 AS stop, sv + (sv - bottom) AS target, 0.65::DOUBLE + CASE WHEN mi BETWEEN 600 AND 645 THEN 0.10::DOUBLE ELSE 0 END AS confidence FROM x WHERE n_day >= 20 AND sv > bottom) SELECT * REPLACE ({_OUT}) FROM s",
    "opening_range_break": f"WITH {QUARTER}, {_sessions('quarter')}, {_opening(15)}, {_opening(30)} SELECT * REPLACE (round(confidence, 6) AS confidence) FROM (SELECT * FROM oe15 UNION ALL SELECT * FROM oe30)",
    "spencer": f"""WITH {FIVE}, {_sessions('five')}, b AS (SELECT *, max(h) OVER {over(-20, -1)} AS ch, min(l) OVER {over(-20, -1)} AS cl, avg(v) OVER {over(-20, -1)} AS vol, stddev_pop(v) OVER {over(-20, -1)} AS dev, {lag('v')} AS v1, top - bottom AS sp FROM ses),
      m AS (SELECT *, ch - cl AS base, row_number() OVER (PARTITION BY symbol, day ORDER BY ts) AS place FROM b WHERE n_day >= 26 AND sp > 0 AND cl >= bottom + sp * 2 / 3.0::DOUBLE AND ch - cl <= 0.35::DOUBLE * sp AND dev <= 0.8::DOUBLE * vol AND h > ch AND ch + 2 > cl - 2)
      SELECT symbol, ts, 'spencer' AS pattern, 'long' AS bias, (ch + 2)::DOUBLE AS entry, (cl - 2)::DOUBLE AS stop, (ch + 2 + 2 * base)::DOUBLE AS target, round(0.50::DOUBLE + CASE WHEN v1 < 0.7::DOUBLE * vol THEN 0.10 ELSE 0 END + CASE WHEN base < 0.20::DOUBLE * sp THEN 0.10 ELSE 0 END, 5) AS confidence FROM m WHERE place = 1""",
    "session_patterns": f"""WITH {FIVE}, {_sessions('five')}, {_BASE}, hm AS (SELECT *, i - 1 - min(CASE WHEN i BETWEEN 3 AND 9 AND c > 1.005::DOUBLE * first_o THEN i END) OVER {_SO_FAR} AS n, i - max(CASE WHEN i BETWEEN 1 AND 5 AND l < 0.995::DOUBLE * first_o THEN i END) OVER {_SO_FAR} AS g, top - bottom AS sp FROM base),
      hh AS (SELECT *, list_max(hs[-n:]) AS ch, list_min(ls[-n:]) AS cl, list_sum(vs[-n:]) / n::DOUBLE AS mean FROM hm WHERE n BETWEEN 5 AND 20), gg AS (SELECT *, list_max(hs[-g:]) AS ch, list_min(ls[-g:]) AS cl FROM hm WHERE g BETWEEN 3 AND 7 AND first_o::DOUBLE / before - 1 >= 0.005::DOUBLE),
      s AS (SELECT symbol, ts, 'hitch_hiker' AS pattern, 'long' AS bias, (ch + 2)::DOUBLE AS entry, (cl - 2)::DOUBLE AS stop, ch + 2 + 1.9::DOUBLE * (ch - cl + 4) AS target, 0.50::DOUBLE + CASE WHEN v > 1.3::DOUBLE * mean THEN 0.10 ELSE 0 END + CASE WHEN mi BETWEEN 570 AND 599 THEN 0.10 ELSE 0 END + CASE WHEN cl > first_h THEN 0.05 ELSE 0 END AS confidence
          FROM hh WHERE sp > 0 AND ch - cl < 0.40::DOUBLE * sp AND cl >= bottom + sp * 2 / 3.0::DOUBLE AND h > ch
        UNION ALL SELECT symbol, ts, 'gap_give_and_go', 'long', (ch + 2)::DOUBLE, (cl - 2)::DOUBLE, first_o::DOUBLE, 0.50::DOUBLE + CASE WHEN mi BETWEEN 570 AND 585 THEN 0.10 ELSE 0 END FROM gg WHERE first_o > cl AND ch - cl <= 0.5::DOUBLE * (first_o - cl) AND h > ch AND first_o - (ch + 2) >= ch - cl + 4)
      SELECT * REPLACE ({_OUT}) FROM s""",
    "power_hour": f"""WITH RECURSIVE {FIVE}, {_sessions('five')}, {_WILDER}, j AS (SELECT ses.*, atr, avg(v) OVER {over(-5)} AS v6, avg(v) OVER {over(-77)} AS v78 FROM ses LEFT JOIN wa USING (symbol, k)),
      a AS (SELECT * FROM j WHERE mi BETWEEN 840 AND 870 AND sv IS NOT NULL AND k >= 30 AND atr > 0 AND v6 >= 1.2::DOUBLE * v78), m AS (SELECT a.symbol, a.ts, count(*) AS m, count(*) FILTER (p.c > a.sv) / count(*)::DOUBLE AS share FROM a JOIN j p ON p.symbol = a.symbol AND p.ts <= a.ts AND p.mi >= 780 GROUP BY ALL),
      b AS (SELECT a.*, CASE WHEN share > 0.70::DOUBLE THEN 1 WHEN share < 0.30::DOUBLE THEN -1 END AS sg FROM a JOIN m USING (symbol, ts) WHERE m >= 10),
      s AS (SELECT symbol, '5min' AS tf, ts, CASE WHEN sg = 1 THEN 'power_hour_long' ELSE 'power_hour_short' END AS pattern, CASE WHEN sg = 1 THEN 'long' ELSE 'short' END AS bias, c::DOUBLE AS entry, sv - sg * 0.1::DOUBLE * atr AS stop, c + sg * 0.5::DOUBLE * atr AS t1, c + sg * atr AS t2, 0.55::DOUBLE AS confidence, sg FROM b WHERE sg IS NOT NULL)
      SELECT symbol, tf, ts, pattern, bias, round(entry, 6) AS entry, round(stop, 6) AS stop, round(t1, 6) AS t1, round(t2, 6) AS t2, confidence FROM s WHERE round(abs(t2 - entry) / nullif(abs(entry - stop), 0), 2) >= 1""",
}
