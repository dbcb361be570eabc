"""DuckDB's SQL of what goes by swings and of walks from one row to the next."""

from __future__ import annotations

from barlab.operators.features import ALIGNMENT
from barlab.operators.score import DEFAULT_WEIGHTS, FEATURES, PATTERN_TYPES, TYPE_WEIGHTS
from barlab.queries.detectors import _REG, _SIGS, _pv
from barlab.queries.outcomes import _RES
from barlab.queries.pattern_sql import _MORE, _WIDER
from barlab.queries.session_sql import _FEATURES
from barlab.queries.sql import DAILY, K, over
from barlab.queries.streams import _T

_FIELDS = "p, price, p1, price1, price2, neck, neck1, next_p, next_price"


def _side(name: str, kind: str, other: str, far: str, pick: str) -> str:
    """Pivots of a kind with the two before them, the far side's extreme back to the one before, and the next pivot of the other kind."""
    return f"""{name}0 AS (SELECT symbol, confirm, "pivot" AS p, price, lag("pivot") OVER s AS p1, lag(price) OVER s AS price1, lag(price, 2) OVER s AS price2 FROM pv WHERE kind = '{kind}' WINDOW s AS (PARTITION BY symbol ORDER BY "pivot")),
  {name}1 AS (SELECT a.symbol, a.p, {pick}(b.{far}) AS neck FROM {name}0 a JOIN kb b ON b.symbol = a.symbol AND b.k BETWEEN coalesce(a.p1, 0) AND a.p GROUP BY ALL),
  {name}2 AS (SELECT a.symbol, a.p, min(o."pivot") AS next_p, arg_min(o.price, o."pivot") AS next_price FROM {name}0 a JOIN pv o ON o.symbol = a.symbol AND o.kind = '{other}' AND o."pivot" > a.p GROUP BY ALL),
  {name} AS (SELECT a.*, neck, lag(neck) OVER (PARTITION BY a.symbol ORDER BY a.p) AS neck1, next_p, next_price FROM {name}0 a JOIN {name}1 USING (symbol, p) LEFT JOIN {name}2 USING (symbol, p))"""


_CHART = f"""{_pv(5)}, {_side('lo', 'low', 'high', 'h', 'max')}, {_side('hi', 'high', 'low', 'l', 'min')},
  b AS (SELECT symbol, ts, k, c, list(l) OVER {over(-29)} AS ls, list(h) OVER {over(-29)} AS hs, max(h) OVER {over(-1000000)} AS top FROM kb),
  x AS (SELECT b.*, {', '.join(f'lo.{f.strip()} AS l_{f.strip()}, hi.{f.strip()} AS h_{f.strip()}' for f in _FIELDS.split(','))} FROM b ASOF LEFT JOIN lo ON b.symbol = lo.symbol AND b.k >= lo.confirm ASOF LEFT JOIN hi ON b.symbol = hi.symbol AND b.k >= hi.confirm),
  rr AS (SELECT x.symbol, x.k, max(o.h) AS right_rim FROM x JOIN kb o ON o.symbol = x.symbol AND o.k BETWEEN x.l_p AND x.k GROUP BY ALL), lr AS (SELECT symbol, k AS l_p, max(h) OVER {over(-1000000, -1)} AS left_rim FROM kb),
  y AS (SELECT x.*, least(left_rim, right_rim) AS rim, left_rim, k + 1 AS n, k - l_p - 4 AS since, k - l_next_p + 1 AS up_n, k - h_next_p + 1 AS down_n, l_next_price - l_price AS up, h_price - h_next_price AS down, (h_price + h_price1) / 2.0::DOUBLE AS roof, (l_price + l_price1) / 2.0::DOUBLE AS floor,
    least(h_neck, h_neck1) AS neck_down, greatest(l_neck, l_neck1) AS neck_up FROM x LEFT JOIN rr USING (symbol, k) LEFT JOIN lr USING (symbol, l_p)),
  w AS (SELECT *, list_min(ls[-least(greatest(since, 1), 10):]) AS handle, CASE WHEN l_next_p + 5 <= k AND up_n BETWEEN 3 AND 30 THEN list_min(ls[-up_n:]) END AS flag_low, CASE WHEN h_next_p + 5 <= k AND down_n BETWEEN 3 AND 30 THEN list_max(hs[-down_n:]) END AS flag_high FROM y)"""


def _chart(name: str, bias: str, when: str, entry: str, stop: str, target: str, confidence: float) -> str:
    risk = f"{entry} - ({stop})" if bias == "long" else f"{stop} - ({entry})"
    return f"SELECT symbol, ts, '{name}' AS pattern, '{bias}' AS bias, ({entry})::DOUBLE AS entry, ({stop})::DOUBLE AS stop, ({target})::DOUBLE AS target, {confidence}::DOUBLE AS confidence FROM w WHERE {when} AND {risk} > 0"


_CHARTS = " UNION ALL ".join(
    [
        _chart("double_bottom", "long", "n >= 30 AND abs(l_price1 - l_price) <= l_price1 * 0.015::DOUBLE AND c >= l_neck", "l_neck + 2", "least(l_price, l_price1) - 2", "2 * l_neck + 2 - least(l_price, l_price1)", 0.65),
        _chart("double_top", "short", "n >= 30 AND abs(h_price1 - h_price) <= h_price1 * 0.015::DOUBLE AND c <= h_neck", "h_neck - 2", "greatest(h_price, h_price1) + 2", "2 * h_neck - 2 - greatest(h_price, h_price1)", 0.63),
        _chart("bull_flag", "long", "n >= 20 AND up::DOUBLE / l_price >= 0.02::DOUBLE AND l_next_price - flag_low <= 0.5::DOUBLE * up", "l_next_price * 1.001::DOUBLE", "flag_low * 0.998::DOUBLE", "l_next_price * 1.001::DOUBLE + up", 0.60),
        _chart("bear_flag", "short", "n >= 20 AND down::DOUBLE / h_price >= 0.02::DOUBLE AND flag_high - h_next_price <= 0.5::DOUBLE * down", "h_next_price * 0.999::DOUBLE", "flag_high * 1.002::DOUBLE", "h_next_price * 0.999::DOUBLE - down", 0.58),
        _chart("head_and_shoulders", "short", "n >= 40 AND h_price1 > h_price2 AND h_price1 > h_price AND abs(h_price2 - h_price) <= h_price2 * 0.03::DOUBLE AND c <= neck_down", "neck_down - 2", "h_price + 2", "2 * neck_down - 2 - h_price1", 0.68),
        _chart("inverse_head_and_shoulders", "long", "n >= 40 AND l_price1 < l_price2 AND l_price1 < l_price AND abs(l_price2 - l_price) <= l_price2 * 0.03::DOUBLE AND c >= neck_up", "neck_up + 2", "l_price - 2", "2 * neck_up + 2 - l_price1", 0.68),
        _chart("ascending_triangle", "long", "n >= 25 AND abs(h_price - h_price1) <= roof * 0.01::DOUBLE AND l_price > l_price1 AND c >= roof", "roof + 2", "l_price - 2", "2 * roof + 2 - l_price", 0.62),
        _chart("descending_triangle", "short", "n >= 25 AND abs(l_price - l_price1) <= floor * 0.01::DOUBLE AND h_price < h_price1 AND c <= floor", "floor - 2", "h_price + 2", "2 * floor - 2 - h_price", 0.60),
        _chart("cup_with_handle", "long", "n >= 40 AND left_rim IS NOT NULL AND rim > l_price AND since >= 3 AND (rim - handle)::DOUBLE / (rim - l_price) BETWEEN 0.10::DOUBLE AND 0.50::DOUBLE AND c >= rim", "rim + 2", "handle - 2", "2 * rim + 2 - l_price", 0.65),
    ]
)

# Zigzag: the running extreme x, seen at xa, of the leg that rises or falls.
_ZIGZAG = f"""{DAILY}, zb AS (SELECT symbol, h::DOUBLE AS h, l::DOUBLE AS l, {K} - 1 AS k FROM daily), zs AS (SELECT symbol, arg_max(k, (h, -k)) <= arg_min(k, (l, k)) AS up FROM zb WHERE k < 20 GROUP BY 1),
  zz(symbol, k, up, x, xa, turned, tx, ta) AS (SELECT symbol, 0::BIGINT, up, CASE WHEN up THEN h ELSE l END, 0::BIGINT, false, NULL::DOUBLE, NULL::BIGINT FROM zb JOIN zs USING (symbol) WHERE k = 0
    UNION ALL SELECT symbol, k, up <> turns, CASE WHEN turns THEN CASE WHEN up THEN l ELSE h END ELSE nx END, CASE WHEN turns THEN k ELSE na END, turns, nx, na
    FROM (SELECT *, CASE WHEN up THEN l <= nx * (1 - 0.03::DOUBLE) ELSE h >= nx * (1 + 0.03::DOUBLE) END AS turns
      FROM (SELECT b.symbol, b.k, b.h, b.l, up, CASE WHEN up THEN greatest(x, b.h) ELSE least(x, b.l) END AS nx, CASE WHEN (up AND b.h > x) OR (NOT up AND b.l < x) THEN b.k ELSE xa END AS na FROM zz JOIN zb b ON b.symbol = zz.symbol AND b.k = zz.k + 1)))"""

# Candidates in bar order, each against the open trade and the last ones taken.
_GREEDY = f"""{_RES}, ca AS (SELECT symbol, k, bias, floor(entry / 100)::BIGINT AS bucket, k_exit, CASE WHEN got1 AND got2 THEN 'win' WHEN got1 THEN 'partial_win' WHEN ks IS NULL AND raw_r > 0.0205 THEN 'timeout' ELSE 'loss' END AS outcome, row_number() OVER (PARTITION BY symbol ORDER BY k) AS i FROM res),
  gr(symbol, i, took, until, lately) AS (SELECT symbol, 0::BIGINT, false, -1::BIGINT, []::STRUCT(b VARCHAR, u BIGINT, k BIGINT)[] FROM ca WHERE i = 1
    UNION ALL SELECT symbol, i, ok, CASE WHEN ok THEN k_exit ELSE until END, CASE WHEN ok THEN list_append(held, {{'b': bias, 'u': bucket, 'k': k}}) ELSE held END
    FROM (SELECT c.symbol, c.i, c.k, c.bias, c.bucket, c.k_exit, until, list_filter(lately, lambda x: c.k - x.k < 12) AS held, until <= c.k AND len(list_filter(lately, lambda x: c.k - x.k < 12 AND x.b = c.bias AND x.u = c.bucket)) = 0 AS ok FROM gr JOIN ca c ON c.symbol = gr.symbol AND c.i = gr.i + 1))"""

_RR = "CASE WHEN rr >= 3 THEN 100 WHEN rr >= 2.5 THEN 80 + (rr - 2.5) * 40 WHEN rr >= 2 THEN 60 + (rr - 2) * 40 WHEN rr >= 1.5 THEN 35 + (rr - 1.5) * 50 WHEN rr >= 1 THEN 10 + (rr - 1) * 50 ELSE 0 END"


def _paths(minutes: int) -> str:
    """Setups with the times at which they become active, reach the first target and end, over ticks whose span of minutes lies ten minutes before the stream's head."""
    return f"""WITH {_T}, f AS (SELECT * FROM t WHERE time_bucket(INTERVAL {minutes} MINUTE, ts) + INTERVAL {minutes} MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)),
      s AS (SELECT symbol, event_id AS setup_id, ts AS made, px AS entry, CASE WHEN event_id % 80 = 0 THEN 1 ELSE -1 END AS sg FROM f WHERE event_id % 40 = 0),
      m AS (SELECT s.*, f.ts, sg * (px - entry) AS way FROM s LEFT JOIN f ON f.symbol = s.symbol AND f.ts > made),
      a AS (SELECT *, min(ts) FILTER (way >= 0) OVER x AS active, min(ts) FILTER (way <= -300) OVER x AS expired FROM m WINDOW x AS (PARTITION BY symbol, setup_id)),
      b AS (SELECT *, min(ts) FILTER (way <= -300 AND ts >= active) OVER x AS stopped, min(ts) FILTER (way >= 300 AND ts >= active) OVER x AS one FROM a WINDOW x AS (PARTITION BY symbol, setup_id)),
      c AS (SELECT symbol, setup_id, made, entry, sg, any_value(active) AS active, any_value(expired) AS expired, any_value(stopped) AS stopped, any_value(one) AS one,
        min(ts) FILTER (way <= 0 AND ts > one) AS back, min(ts) FILTER (way >= 600 AND ts >= one) AS two FROM b GROUP BY ALL),
      n AS (SELECT *, CASE WHEN expired < active OR (active IS NULL AND expired IS NOT NULL) THEN 'EXPIRED' WHEN stopped < one OR (one IS NULL AND stopped IS NOT NULL) THEN 'STOPPED'
        WHEN back < two OR (two IS NULL AND back IS NOT NULL) THEN 'EVEN' WHEN two IS NOT NULL THEN 'AT_T2' END AS cause FROM c),
      d AS (SELECT *, CASE WHEN cause = 'EVEN' THEN 'STOPPED' ELSE cause END AS status, CASE cause WHEN 'EXPIRED' THEN expired WHEN 'STOPPED' THEN stopped WHEN 'EVEN' THEN back ELSE two END AS ended FROM n)"""


def _day_events() -> str:
    """The events at which setups end, by prices or by the day's end, or are held overnight, as `ev`. A setup's walk by prices does not depend on
    the days' ends, so its first day's end without a hold closes it."""
    return f"""{_paths(30)},
      l AS (SELECT symbol, ts::DATE AS day, arg_max(px, (ts, event_id)) AS last FROM t WHERE hour(ts) * 60 + minute(ts) < 990 GROUP BY ALL),
      e AS (SELECT symbol, day + INTERVAL 990 MINUTE AS eod, last FROM l WHERE day + INTERVAL 990 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)),
      w AS (SELECT d.*, e.eod, sg * (last - entry) AS gain, active <= e.eod AND sg * (last - entry) >= 0.7::DOUBLE * CASE WHEN one <= e.eod THEN 600 ELSE 300 END AS held
        FROM d JOIN e ON d.symbol = e.symbol AND e.eod > made AND (ended IS NULL OR ended >= e.eod)),
      x AS (SELECT symbol, setup_id, min(eod) AS shut FROM w WHERE held IS NOT TRUE GROUP BY ALL),
      ev AS (SELECT symbol, setup_id, 'CLOSED' AS status, shut AS "at", (sign(gain) * floor((2000 * abs(gain) + 300) / 600))::BIGINT AS r_milli FROM x JOIN w USING (symbol, setup_id) WHERE eod = shut
      UNION ALL SELECT symbol, setup_id, 'OVERNIGHT', eod, 0 FROM w LEFT JOIN x USING (symbol, setup_id) WHERE held AND (shut IS NULL OR eod < shut)
      UNION ALL SELECT d.symbol, d.setup_id, status, ended, CASE cause WHEN 'STOPPED' THEN -1000 WHEN 'AT_T2' THEN 2000 ELSE 0 END FROM d LEFT JOIN x USING (symbol, setup_id) WHERE cause IS NOT NULL AND shut IS NULL)"""


def _kinds() -> str:
    """Strategy type by the start of a pattern's name."""
    whens = " ".join(f"WHEN pattern = '{n}' OR starts_with(pattern, '{n}_') THEN '{k}'" for k, names in PATTERN_TYPES.items() for n in names)
    return f"CASE {whens} ELSE 'breakout' END"


def _typed() -> str:
    """Weighted mean of the features by strategy type."""
    def mean(weights) -> str:
        return "(" + " + ".join(f"{x if x != 'regime' else 'f_regime'} * {w}::DOUBLE" for x, w in zip(FEATURES, weights) if w) + f") / {sum(weights)}::DOUBLE"

    return "(CASE " + " ".join(f"WHEN kind = '{k}' THEN {mean(w)}" for k, w in TYPE_WEIGHTS.items()) + f" ELSE {mean(DEFAULT_WEIGHTS)} END)"


def _aligned() -> str:
    return "(CASE " + " ".join(f"WHEN market = '{r}' AND kind = '{k}' THEN {x}" for (r, k), x in ALIGNMENT.items()) + " ELSE 50 END)"


QUERIES: dict = {}  # the other modules have them
ORACLE_SQL = {
    "chart_patterns": f"WITH {_CHART}, s AS ({_CHARTS}) SELECT symbol, ts, pattern, bias, round(entry, 6) AS entry, round(stop, 6) AS stop, round(target, 6) AS target, confidence FROM s",
    "zigzag": f"WITH RECURSIVE {_ZIGZAG} SELECT symbol, '1d' AS tf, ta AS \"pivot\", k AS confirm, tx AS price, CASE WHEN up THEN 'low' ELSE 'high' END AS kind FROM zz WHERE turned",
    "select_non_overlapping": f"WITH RECURSIVE {_GREEDY} SELECT symbol, k, bias, k_exit, outcome FROM gr JOIN ca USING (symbol, i) WHERE took",
    "scan": f"""WITH RECURSIVE {_WIDER}, s AS ({_SIGS} UNION ALL {' UNION ALL '.join(_MORE)}), e AS (SELECT symbol, max(ts) AS ts FROM daily GROUP BY 1), g AS (SELECT *, abs(t2 - entry) / abs(entry - stop) AS rr FROM s JOIN e USING (symbol, ts) WHERE round(abs(t2 - entry) / nullif(abs(entry - stop), 0), 2) >= 1),
      q AS (SELECT symbol, pattern AS pattern_name, bias, round(confidence * 70 + ({_RR}) * 0.3::DOUBLE, 6) AS composite FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY composite DESC, pattern_name) AS rank FROM q) SELECT * FROM p WHERE rank <= 2""",
    "scored_scan": f"""WITH RECURSIVE {_WIDER}, s AS ({_SIGS} UNION ALL {' UNION ALL '.join(_MORE)}), e AS (SELECT symbol, max(ts) AS ts FROM daily GROUP BY 1 HAVING count(*) >= 20),
      g AS (SELECT *, abs(t2 - entry) / abs(entry - stop) AS rr, {_kinds()} AS kind FROM s JOIN e USING (symbol, ts) WHERE round(abs(t2 - entry) / nullif(abs(entry - stop), 0), 2) >= 1),
      q AS (SELECT g.*, f.*, r.regime AS market FROM g JOIN (WITH RECURSIVE {_FEATURES} SELECT symbol AS fs, ts AS ft, momentum, volatility, vol_compression, volume, trend, breakout, mean_reversion, regime AS f_regime FROM g) f ON g.symbol = fs AND g.ts = ft
        JOIN (WITH RECURSIVE {_REG} SELECT symbol, ts, regime FROM reg) r ON g.symbol = r.symbol AND g.ts = r.ts),
      c AS (SELECT symbol, pattern AS pattern_name, bias, CASE WHEN entry / 100 > 50 THEN round_even(entry / 1000, 0) * 10 ELSE round_even(entry / 100, 0) END AS bucket, confidence,
        round(greatest(0, least(100, confidence * 100 * 0.20::DOUBLE + {_typed()} * 0.22::DOUBLE + 50 * 0.18::DOUBLE + {_aligned()} * 0.15::DOUBLE + 50 * 0.10::DOUBLE + volume * 0.10::DOUBLE + ({_RR}) * 0.05::DOUBLE)), 1) AS composite FROM q)
      SELECT symbol, pattern_name, bias, bucket, composite, round(confidence, 6) AS confidence, false AS multi_tf, '1d' AS label FROM c QUALIFY row_number() OVER (PARTITION BY symbol, pattern_name, bias, bucket ORDER BY composite DESC) = 1""",
    "stream_setup_lifecycle": f"""{_paths(60)}
      SELECT symbol, setup_id, status, ended AS at, (CASE cause WHEN 'STOPPED' THEN -1000 WHEN 'AT_T2' THEN 2000 ELSE 0 END)::BIGINT AS r_milli FROM d WHERE cause IS NOT NULL""",
    "stream_setup_day": f"{_day_events()} SELECT * FROM ev",
    "stream_trade_alerts": f"""{_day_events()}, k AS (SELECT ev.*, CASE WHEN setup_id % 80 = 0 THEN 'long' ELSE 'short' END AS side FROM ev UNION ALL
      SELECT d.symbol, d.setup_id, 'AT_T1', one, 0, CASE WHEN sg > 0 THEN 'long' ELSE 'short' END FROM d LEFT JOIN x USING (symbol, setup_id) WHERE (one < stopped OR stopped IS NULL) AND (shut IS NULL OR one < shut) AND active IS NOT NULL AND one IS NOT NULL AND (expired IS NULL OR expired >= active))
      SELECT concat_ws('-', symbol, setup_id::VARCHAR, status) AS id, CASE WHEN status IN ('AT_T1', 'AT_T2') THEN 'target' WHEN status IN ('STOPPED', 'EXPIRED') THEN 'stop' ELSE 'day_end' END AS kind, "at",
        concat(symbol, ' setup ', side, ' ', status, ' ', CASE WHEN r_milli < 0 THEN '-' ELSE '+' END, printf('%.2f', abs(floor(abs(r_milli) / 10.0::DOUBLE + 0.5) / 100.0::DOUBLE)), 'R') AS alert FROM k""",
    "stream_day_events": f"""{_day_events()} SELECT "at"::DATE AS day, count(*) FILTER (status <> 'OVERNIGHT') AS ended, count(*) FILTER (r_milli > 0) AS winners, count(*) FILTER (r_milli < 0) AS losers,
      count(*) FILTER (status = 'STOPPED' AND r_milli = 0) AS even, count(*) FILTER (status = 'AT_T2') AS second_targets, count(*) FILTER (status = 'OVERNIGHT') AS overnight, sum(r_milli)::BIGINT AS total_r_milli FROM ev GROUP BY 1""",
    "stream_running_metrics": f"""WITH {_T}, r AS (SELECT symbol AS pattern, px - 10000 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, px DESC) AS i FROM t), f AS (SELECT pattern, min(i) FILTER (r <= 0) AS loss, min(i) FILTER (r > 0) AS win, count(*) AS n FROM r WHERE i <= 60 GROUP BY 1)
      SELECT r.pattern, count(*) AS n, count(*) FILTER (r > 0) AS wins, sum(r)::BIGINT AS total, round(count(*) FILTER (r > 0) / count(*)::DOUBLE, 6) AS win_rate, round(sum(r) / count(*)::DOUBLE, 6) AS expectancy, round(sum(r) FILTER (r > 0)::DOUBLE / nullif(-sum(r) FILTER (r <= 0), 0), 6) AS profit_factor,
        (CASE WHEN any_value(win) = 1 THEN coalesce(any_value(loss), any_value(f.n) + 1) - 1 ELSE 1 - coalesce(any_value(win), any_value(f.n) + 1) END)::BIGINT AS streak FROM r JOIN f USING (pattern) WHERE i <= 60 GROUP BY r.pattern""",
}
