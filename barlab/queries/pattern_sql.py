"""DuckDB's SQL of the patterns that need recursions, streaks, ranks or weeks."""

from __future__ import annotations

from barlab.queries.detectors import _LASTP, _LS, _SIGS, _SS, _WIDE, _pattern, _pv
from barlab.queries.folds import _D, ATR_SQL
from barlab.queries.sql import HOURLY, QUARTER, TICKS, lag, over

# Directional movement and its recursions.
_ADX = f"""dm AS (SELECT symbol, k, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS plus, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS minus FROM (SELECT *, h - {lag('h')} AS up, {lag('l')} - l AS dn FROM d)),
  sx(symbol, k, sp, sm, st) AS (SELECT symbol, 15::BIGINT, sum(plus)::DOUBLE, sum(minus)::DOUBLE, sum(tr)::DOUBLE FROM dm WHERE k BETWEEN 2 AND 15 GROUP BY symbol HAVING max(k) = 15
    UNION ALL SELECT m.symbol, m.k, sp - sp / 14 + plus, sm - sm / 14 + minus, st - st / 14 + tr FROM sx JOIN dm m ON m.symbol = sx.symbol AND m.k = sx.k + 1),
  dx AS (SELECT symbol, k, CASE WHEN st > 0 AND sp + sm > 0 THEN 100 * abs(sp - sm) / (sp + sm) ELSE 0 END AS dx FROM sx),
  ad(symbol, k, y) AS (SELECT symbol, 29::BIGINT, avg(dx) FROM dx WHERE k <= 29 GROUP BY symbol HAVING max(k) = 29
    UNION ALL SELECT x.symbol, x.k, (y * 13 + x.dx) / 14 FROM ad JOIN dx x ON x.symbol = ad.symbol AND x.k = ad.k + 1),
  adx AS (SELECT symbol, k, y AS adx FROM ad WHERE k >= 42 AND y > 0)"""


def _emas(name: str, source: str, spans: tuple[int, ...], key: str = "symbol") -> str:
    """EMAs e<span> of the closes of `source`, from the first close on, in one recursion."""
    steps = ", ".join(f"e{p} + (x.c - e{p}) * {2 / (p + 1)!r}::DOUBLE" for p in spans)
    keys = key.split(", ")
    same = " AND ".join(f"x.{k} = e.{k}" for k in keys)
    return f"""{name}({key}, k, {', '.join(f'e{p}' for p in spans)}) AS (SELECT {key}, 1::BIGINT, {', '.join('c::DOUBLE' for _ in spans)} FROM {source} WHERE k = 1
      UNION ALL SELECT {', '.join(f'x.{k}' for k in keys)}, x.k, {steps} FROM {name} e JOIN {source} x ON {same} AND x.k = e.k + 1)"""


_STREAK = f"""sg AS (SELECT symbol, ts, k, coalesce(sign(diff), 0)::INT AS sg FROM d), sn AS (SELECT *, CASE WHEN sg = {lag('sg')} THEN 0 ELSE 1 END AS nw FROM sg), sr AS (SELECT *, sum(nw) OVER {over(-1000000)} AS run FROM sn),
  streaks AS (SELECT symbol, k, sg, least(9, row_number() OVER (PARTITION BY symbol, run ORDER BY k)) AS run FROM sr)"""
_WEEKS = """wk AS (SELECT symbol, date_trunc('week', ts) AS week, arg_max(c, ts) AS close FROM daily GROUP BY ALL),
  wl AS (SELECT symbol, week, """ + ", ".join(f"lag(close, {j}) OVER (PARTITION BY symbol ORDER BY week) AS w{j}" for j in range(1, 5)) + " FROM wk)"
_HEAVY = "len(list_filter(days[-{}:], lambda x: x.v > v50 AND {}))"
_WIDER = f"""{_WIDE}, {_ADX}, {_emas('em', 'd', (20, 50, 100, 200))}, {_STREAK}, {_WEEKS},
  bw AS (SELECT symbol, k, CASE WHEN k >= 30 THEN avg(c) OVER {over(-29)} END AS mid, CASE WHEN k >= 30 THEN stddev_pop(c) OVER {over(-29)} END AS dev FROM d),
  bx AS (SELECT b.symbol, b.k, ts, mid + 2.25::DOUBLE * dev AS upper, mid - 2.25::DOUBLE * dev AS lower, 4.5::DOUBLE * dev / mid AS width FROM bw b JOIN d USING (symbol, k)),
  bq AS (SELECT *, list_filter(list(width) OVER {over(-125, -20)}, lambda x: x IS NOT NULL) AS past FROM bx),
  bands AS (SELECT symbol, k, upper, lower, CASE WHEN len(past) >= 20 THEN len(list_filter(past, lambda x: x > width))::DOUBLE / len(past) END AS rk FROM bq),
  more AS (SELECT d.symbol, d.ts, d.k, avg(h - l) OVER {over(-4)} / nullif(avg(h - l) OVER {over(-19, -5)}, 0) AS sq, CASE WHEN d.k > 20 THEN max(h) OVER {over(-20, -1)} END AS hi20, CASE WHEN d.k > 20 THEN min(l) OVER {over(-20, -1)} END AS lo20,
    min(l) OVER {over(-30, -1)} AS lo30, CASE WHEN d.k >= 10 THEN avg(c) OVER {over(-9)} END AS sma10, min(l) OVER {over(-4)} > min(l) OVER {over(-9, -5)} AND min(l) OVER {over(-2)} > min(l) OVER {over(-9, -7)} AS rising,
    max(h) OVER {over(-4)} < max(h) OVER {over(-9, -5)} AND max(h) OVER {over(-2)} < max(h) OVER {over(-9, -7)} AS falling, avg(y) OVER {over(-16)} AS atr30, quantile_cont(y, 0.5) OVER {over(-53, -14)} AS past60,
    list({{'v': v, 'up': coalesce(diff > 0, false)}}) OVER {over(-9)} AS days, list(l) OVER {over(-8)} AS ls, list(h) OVER {over(-8)} AS hs, list(c::DOUBLE) OVER {over(-252)} AS cs, coalesce(v <= 1.3::DOUBLE * avg(v) OVER {over(-3, -1)}, false) AS dry
    FROM d LEFT JOIN atr USING (symbol, k) JOIN (SELECT symbol, ts, v FROM daily) USING (symbol, ts)),
  calm AS (SELECT m.symbol, m.k, count(*) FILTER (y < 0.7::DOUBLE * atr30) OVER (PARTITION BY m.symbol ORDER BY m.k ROWS 9 PRECEDING) AS quiet FROM more m LEFT JOIN atr USING (symbol, k)),
  mo AS (SELECT symbol, k, least(11, (least(k, 252) - 2) // 21) AS known, list_reverse(cs) AS r FROM more),
  ms AS (SELECT symbol, k, known, r[22] AS c21, r[1] / r[22] - 1 AS now, [r[21 * j + 1] / r[21 * j + 22] - 1 for j in range(1, known + 1)] AS months FROM mo WHERE known >= 3 AND k - 1 >= 21 * (known + 1)),
  z AS (SELECT symbol, k, c21, (now - list_avg(months)) / list_stddev_pop(months) AS z FROM ms WHERE list_stddev_pop(months) > 0),
  ww AS (SELECT w.*, sq, hi20, lo20, lo30, sma10, rising, falling, atr30, quiet, days, ls, hs, dry, adx, upper, lower, rk, s.sg, s.run, w1, w2, w3, w4, c21, z, (CASE WHEN e20 > e50 THEN 1 ELSE -1 END + CASE WHEN e50 > e100 THEN 1 ELSE -1 END + CASE WHEN e100 > e200 THEN 1 ELSE -1 END) / 3.0::DOUBLE AS votes,
    CASE WHEN w.k >= 19 AND past60 > 0 THEN w.atr / past60 ELSE 1 END AS ratio40, {_HEAVY.format(7, 'x.up')} AS acc7, {_HEAVY.format(7, 'NOT x.up')} AS dis7, {_HEAVY.format(10, 'x.up')} AS acc10, {_HEAVY.format(10, 'NOT x.up')} AS dis10
    FROM w JOIN more USING (symbol, k) JOIN calm USING (symbol, k) JOIN em USING (symbol, k) JOIN streaks s USING (symbol, k) JOIN bands USING (symbol, k) LEFT JOIN adx USING (symbol, k) LEFT JOIN z USING (symbol, k) JOIN wl ON wl.symbol = w.symbol AND wl.week = date_trunc('week', w.ts))"""


def _of(*args: str | int) -> str:
    return _pattern(*args).replace(" FROM w ", " FROM ww ")


def _both(name: str, least: int, long: str, short: str, stop: float, t1: float, t2: float, conf: str | tuple[str, str]) -> list[str]:
    """Twins with stop and targets in ATRs."""
    conf = (conf, conf) if isinstance(conf, str) else conf
    return [_of(f"{name}_{b}", b, least, when, f"c - {s} * {stop}::DOUBLE * atr", f"c + {s} * {t1}::DOUBLE * atr", f"c + {s} * {t2}::DOUBLE * atr", c) for b, s, when, c in (("long", 1, long, conf[0]), ("short", -1, short, conf[1]))]


def _at_risk(name: str, least: int, long: str, short: str, stops: tuple[str, str], conf: tuple[str, str]) -> list[str]:
    """Twins with targets at once and twice the risk."""
    return [_of(f"{name}_{b}", b, least, when, stop, f"c + (c - {stop})", f"c + 2 * (c - {stop})", c) for b, when, stop, c in (("long", long, stops[0], conf[0]), ("short", short, stops[1], conf[1]))]


_WEAK = "CASE WHEN v >= 1.5::DOUBLE * v20 THEN 0 ELSE 0.05::DOUBLE END"
_BONUS = "0.60::DOUBLE + least(0.10::DOUBLE, (adx - 25) / 500)"
_QUIET = "atr <= 0.6::DOUBLE * atr30 AND quiet >= 5"
_REV = "0.55::DOUBLE + CASE WHEN dry THEN 0.05::DOUBLE ELSE 0 END + least(0.10::DOUBLE, (abs(z) - 2) * 0.05::DOUBLE)"
_RUN = "0.55::DOUBLE + least(0.10::DOUBLE, (run - 5) * 0.03::DOUBLE)"
_MANY, _SELLING = "(acc7 >= 5 AND dis7 <= 1)", "(dis10 >= 3 AND acc10 <= 1)"
_MORE = [
    *_both("adx_stack", 60, "adx >= 35 AND c > sma10 AND sma10 > sma50 AND rising AND c > w1 AND w1 > w2 AND w2 > w3 AND w3 > w4 AND v20 >= v50", "adx >= 25 AND c < sma20 AND sma20 < sma50 AND falling AND c < w1 AND w1 < w2 AND w2 < w3", 2, 2, 4,
           (f"{_BONUS} + least(0.05::DOUBLE, (CASE WHEN v50 > 0 THEN v20 / v50 ELSE 1 END - 1) * 0.1::DOUBLE) + CASE WHEN c > sma50 AND ratio40 > 0.8::DOUBLE THEN 0.08::DOUBLE ELSE 0 END", _BONUS)),
    *_at_risk("vol_compression_breakout", 30, f"{_QUIET} AND c > sma20", f"{_QUIET} AND c <= sma20", ("(sma20 - atr)", "(sma20 + atr)"), ("0.57::DOUBLE + CASE WHEN v > 1.3::DOUBLE * v20 THEN 0.05::DOUBLE ELSE 0 END",) * 2),
    *_at_risk("donchian_breakout", 50, "coalesce(sq <= 0.85::DOUBLE, true) AND c > hi20", "coalesce(sq <= 0.85::DOUBLE, true) AND c < lo20", (_LS, _SS), tuple(f"CASE WHEN c {x} sma50 THEN 0.55::DOUBLE ELSE 0.48::DOUBLE END - {_WEAK}" for x in "><")),
    *_both("multi_tf_trend", 200, "v >= 0.8::DOUBLE * v20 AND votes >= 0.5", "v >= 0.8::DOUBLE * v20 AND votes <= -0.5", 3, 2, 5, "0.55::DOUBLE + abs(votes) * 0.10::DOUBLE"),
    *(_of(f"st_reversal_{b}", b, 60, f"{s} * z < -2", f"c - {s} * 1.5::DOUBLE * atr", f"c + {s} * abs(c - c21) * 0.5::DOUBLE", "c21", _REV) for b, s in (("long", 1), ("short", -1))),
    *_both("turtle_breakout", 60, "coalesce(sq <= 0.80::DOUBLE, true) AND c > hi30", "coalesce(sq <= 0.80::DOUBLE, true) AND c < lo30", 1, 2.5, 5.5, tuple(f"CASE WHEN v >= 2 * v20 THEN {a}::DOUBLE ELSE {b}::DOUBLE END" for a, b in ((0.58, 0.52), (0.55, 0.50)))),
    _of("streak_reversal_long", "long", 10, "sg = -1 AND run >= 5", "list_min(ls[-run:]) - 0.1::DOUBLE * atr", "c + atr", "c + 2 * atr", _RUN),
    _of("streak_reversal_short", "short", 10, "sg = 1 AND run >= 5", "list_max(hs[-run:]) + 0.1::DOUBLE * atr", "c - atr", "c - 2 * atr", _RUN),
    _of("bb_squeeze_long", "long", 130, "rk <= 0.19::DOUBLE AND c > upper", "c - atr", "c + 3 * atr", "c + 8 * atr", "0.58"),
    _of("bb_squeeze_short", "short", 130, "rk <= 0.19::DOUBLE AND c < lower", "c + atr", "c - 2 * atr", "c - 4 * atr", "0.56"),
    _of("accumulation_long", "long", 30, f"{_MANY} AND c >= coalesce(sma50, c)", "c - 3.25::DOUBLE * atr", "c + 3.75::DOUBLE * atr", "c + 7 * atr", "0.56::DOUBLE + least(0.08::DOUBLE, (acc7 - 5) * 0.03::DOUBLE)"),
    _of("distribution_short", "short", 30, f"NOT {_MANY} AND {_SELLING} AND c <= coalesce(sma50, c)", "c + 3.25::DOUBLE * atr", "c - 3.75::DOUBLE * atr", "c - 7 * atr", "0.52::DOUBLE + least(0.08::DOUBLE, (dis10 - 3) * 0.02::DOUBLE)"),
]
_GATED = """SELECT symbol, tf, ts, pattern, bias, round(entry, 6) AS entry, round(stop, 6) AS stop, round(t1, 6) AS t1, round(t2, 6) AS t2, round(confidence, 6) AS confidence FROM s
  WHERE round(abs(t2 - entry) / nullif(abs(entry - stop), 0), 2) >= 1"""

# Bars of both swing timeframes, with what their patterns read.
_IN = "(PARTITION BY symbol, tf ORDER BY ts ROWS BETWEEN {} PRECEDING AND {})"


def _last(n: int) -> str:
    return _IN.format(n - 1, "CURRENT ROW")


def _ago(a: int, b: int) -> str:
    return _IN.format(a, f"{b} PRECEDING")


_BACK = "lag({}, {}) OVER (PARTITION BY symbol, tf ORDER BY ts)"
_SWING = f"""{HOURLY}, {QUARTER.removeprefix(TICKS + ', ')}, two AS (SELECT *, '1h' AS tf FROM hourly UNION ALL SELECT *, '15min' FROM quarter),
  nb AS (SELECT symbol, tf, ts, o, h, l, c, v, row_number() OVER (PARTITION BY symbol, tf ORDER BY ts) AS k, greatest(h - l, abs(h - {_BACK.format('c', 1)}), abs(l - {_BACK.format('c', 1)}))::DOUBLE AS tr FROM two),
  ta(symbol, tf, k, atr) AS (SELECT symbol, tf, 14::BIGINT, avg(tr) FROM nb WHERE k <= 14 GROUP BY ALL HAVING max(k) = 14 UNION ALL SELECT x.symbol, x.tf, x.k, (atr * 13 + x.tr) / 14 FROM ta JOIN nb x ON x.symbol = ta.symbol AND x.tf = ta.tf AND x.k = ta.k + 1),
  {_emas('em', 'nb', (12, 20, 26), 'symbol, tf')},
  j AS (SELECT nb.*, atr, e20, e12 - e26 AS macd FROM nb JOIN em USING (symbol, tf, k) LEFT JOIN ta USING (symbol, tf, k)),
  w AS (SELECT *, avg(v) OVER {_last(20)} AS v20, avg(h - l) OVER {_last(5)} / nullif(avg(h - l) OVER {_ago(19, 5)}, 0) AS sq, list(c) OVER {_ago(4, 1)} AS band, {_BACK.format('macd', 1)} AS m1, {_BACK.format('macd', 2)} AS m2,
    min(l) OVER {_last(5)} AS lo5, max(h) OVER {_last(5)} AS hi5, min(l) OVER {_last(10)} AS lo10, max(h) OVER {_last(10)} AS hi10, avg(v) OVER {_last(5)} AS v5, avg(v) OVER {_ago(9, 5)} AS v5b, c::DOUBLE / {_BACK.format('c', 10)} - 1 AS move FROM j)"""


def _swing(name: str, bias: str, least: int, when: str, stop: str, t1: str, t2: str, conf: str) -> str:
    return _pattern(name, bias, least, when, stop, t1, t2, conf).replace("'1d' AS tf", "tf")


_READY = "len(list_filter(band, lambda x: x > e20 - 2 * atr AND x < e20 + 2 * atr)) > 0 AND (k < 25 OR coalesce(sq <= 0.80::DOUBLE, true)) AND v >= 1.5::DOUBLE * v20"
_SIDES = (("long", 1, ">", "lo5 - 0.1::DOUBLE * atr"), ("short", -1, "<", "hi5 + 0.1::DOUBLE * atr"))
_SWINGS = " UNION ALL ".join(
    [
        *(_swing(f"keltner_breakout_{b}", b, 30, f"{_READY} AND c {x} e20 + {s} * 2 * atr", f"e20 - {s} * 0.1::DOUBLE * atr", f"c + {s} * 1.5::DOUBLE * atr", f"c + {s} * 3 * atr", "0.58") for b, s, x, _ in _SIDES),
        *(_swing(f"macd_turn_{b}", b, 35, f"{s} * m2 > {s} * m1 AND {s} * macd > {s} * m1 AND {s} * macd > 0 AND {s} * m1 < 0", stop, f"c + {s} * 1.5::DOUBLE * atr", f"c + {s} * 3 * atr", "0.55") for b, s, _, stop in _SIDES),
        *(_swing(f"vp_divergence_{b}", b, 20, f"v5 < 0.60::DOUBLE * v5b AND {s} * move < -0.02::DOUBLE AND {edge}", stop, f"c + {s} * atr", f"c + {s} * 2 * atr", "0.55") for (b, s, _, stop), edge in zip(_SIDES, ("c <= 1.005::DOUBLE * lo10", "c >= 0.995::DOUBLE * hi10"), strict=True)),
    ]
)

# Greedy levels: pivots in price order, each with the first price of its level.
_LEVELS = f"""{_pv(5)}, pn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY price, "pivot", kind) AS i FROM pv),
  lv(symbol, i, price, kind, anchor) AS (SELECT symbol, i, price, kind, price FROM pn WHERE i = 1
    UNION ALL SELECT p.symbol, p.i, p.price, p.kind, CASE WHEN p.price - anchor <= anchor * TOLERANCE::DOUBLE THEN anchor ELSE p.price END FROM lv JOIN pn p ON p.symbol = lv.symbol AND p.i = lv.i + 1),
  levels AS (SELECT symbol, avg(price) AS price, count(*) AS touches, stddev_pop(price) AS width, CASE WHEN bool_and(kind = 'high') THEN 'resistance' WHEN bool_and(kind = 'low') THEN 'support' ELSE 'both' END AS type FROM lv GROUP BY symbol, anchor HAVING count(*) >= 2)"""
_LEVELS_8, _LEVELS_4 = _LEVELS.replace("TOLERANCE", "0.008"), _LEVELS.replace("TOLERANCE", "0.004")


QUERIES: dict = {}  # the detectors module has them
ORACLE_SQL = {
    "adx": f"WITH RECURSIVE {_D}, {_ADX} SELECT symbol, ts, round(adx, 5) AS adx FROM d LEFT JOIN adx USING (symbol, k)",
    "detect_daily": f"WITH RECURSIVE {_WIDER}, s AS ({_SIGS} UNION ALL {' UNION ALL '.join(_MORE)}) {_GATED}",
    "detect_swing": f"WITH RECURSIVE {_SWING}, s AS ({_SWINGS}) {_GATED}",
    "cluster_levels": f"WITH RECURSIVE {_LEVELS_8} SELECT symbol, round(price, 4) AS price, touches, round(width, 4) AS width, type FROM levels",
    "horizontal_levels": f"""WITH RECURSIVE {_LEVELS_8}, s AS (SELECT * FROM levels JOIN (VALUES ('support'), ('resistance')) v(side) ON type IN (side, 'both'))
      SELECT symbol, side, row_number() OVER (PARTITION BY symbol, side ORDER BY touches DESC, price)::INTEGER AS rank, round(price, 4) AS price, touches, least(100.0::DOUBLE, touches * 15.0::DOUBLE) AS strength, round(price - width, 4) AS low, round(price + width, 4) AS high FROM s""",
    "level_search": f"""WITH RECURSIVE {_LEVELS_8}, b AS (SELECT symbol, k, c, avg(h - l) OVER {over(-13)} AS atr FROM kb)
      SELECT b.symbol, k, round(max(price) FILTER (price < c), 4) AS below, round(min(price) FILTER (price > c), 4) AS above, round(arg_min(price, (abs(price - c), price)), 4) AS "any",
        round(arg_max(price, (touches, -price)) FILTER (atr > 0 AND price > c AND price >= c + atr), 4) AS target_long, round(arg_max(price, (touches, -price)) FILTER (atr > 0 AND price < c AND price <= c - atr), 4) AS target_short
      FROM b LEFT JOIN levels v USING (symbol) GROUP BY b.symbol, k""",
    "price_in_zone": f"WITH RECURSIVE {_LEVELS_8} SELECT b.symbol, k, count(*) AS zones FROM kb b JOIN levels v ON v.symbol = b.symbol AND c BETWEEN price - width AND price + width GROUP BY ALL",
    "detect_breakouts": f"""WITH RECURSIVE {_LEVELS_4}, r AS (SELECT symbol, k, c, max(c) OVER {over(-5, -1)} AS top, min(c) OVER {over(-5, -1)} AS bottom, max(k) OVER (PARTITION BY symbol) AS e FROM kb),
      m AS (SELECT r.symbol, price, k, CASE WHEN c > price + width AND bottom < price THEN 'up' WHEN c < price - width AND top > price THEN 'down' END AS side FROM r JOIN levels v ON v.symbol = r.symbol WHERE k > e - 40)
      SELECT symbol, round(price, 4) AS price, min(k) AS k, arg_min(side, k) AS side FROM m WHERE side IS NOT NULL GROUP BY symbol, m.price""",
    "detect_channel": f"""WITH {_pv(3)}{_LASTP.format(3)}, ln AS (SELECT symbol, kind, regr_slope(price, "pivot") AS s, regr_intercept(price, "pivot") AS i, min("pivot") AS a, max("pivot") AS z FROM lp GROUP BY ALL HAVING count(*) >= 2 AND coalesce(regr_r2(price, "pivot"), 0) >= 0.3::DOUBLE),
      b AS (SELECT u.symbol, u.s AS us, d.s AS ds, u.s * greatest(u.a, d.a) + u.i - d.s * greatest(u.a, d.a) - d.i AS w0, u.s * greatest(u.z, d.z) + u.i - d.s * greatest(u.z, d.z) - d.i AS w1 FROM ln u JOIN ln d ON u.symbol = d.symbol AND u.kind = 'high' AND d.kind = 'low')
      SELECT symbol, round(w0, 5) AS width_start, round(w1, 5) AS width_end, round((us + ds) / 2, 5) AS mid_slope, round(w1 / nullif(w0, 0), 5) AS compression, CASE WHEN ds > us THEN round(w1 / (ds - us), 5) END AS bars_to_meet, w1 < w0 AS converging, sign(us) = sign(ds) AS same_sign FROM b WHERE w1 > 0""",
}
