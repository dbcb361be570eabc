"""I: signals to outcomes, on the hourly bars and every sixth bar's signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.functions import indicators as I
from barlab.operators import outcomes as O
from barlab.operators import resample, sweep
from barlab.queries.sql import CLOSED, HOURLY, lag, over
from barlab.sources import bars as store
from barlab.sources import fixtures

HOLD = 48


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.with_index(fixtures.intraday(spark, sf_dir))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.signals(fixtures.intraday(spark, sf_dir))


def scan_schedule(spark, sf_dir):
    return O.scan_schedule(_bars(spark, sf_dir)).select("symbol", "k")


def cooldown_bars(spark, sf_dir):
    trades = store.history_union(fixtures.trades(spark, sf_dir), fixtures.TRADE_TIES).withColumn("tf", F.element_at(F.array(*map(F.lit, O.BAR_MINUTES)), (F.col("regime") + 1).cast("int")))
    return trades.select("id", O.bars_for(F.abs("r_milli") / 10).alias("cooldown"))


def apply_slippage(spark, sf_dir):
    """Slippage by the ATR that starts anew on the last 20 bars; none where a series is too short for one."""
    atr = O.with_window_atr(_bars(spark, sf_dir)).select("symbol", "tf", "k", F.col("window_atr").alias("atr"))
    return O.apply_slippage(_signals(spark, sf_dir).join(atr.hint("merge"), ["symbol", "tf", "k"])).select("symbol", "k", F.round("entry", 6).alias("entry"), F.round("risk", 6).alias("risk"))


def first_touch_label(spark, sf_dir):
    return O.first_touch_label(_signals(spark, sf_dir), _bars(spark, sf_dir)).select("symbol", "k", "label", "r")


def barrier_resolve(spark, sf_dir):
    out = O.barrier_resolve(_signals(spark, sf_dir), _bars(spark, sf_dir), HOLD)
    return out.select("symbol", "k", "got1", "got2", "k_exit", F.round("raw_r", 6).alias("raw_r"))


def finalize_r(spark, sf_dir):
    return O.finalize_r(O.barrier_resolve(_signals(spark, sf_dir), _bars(spark, sf_dir), HOLD)).select("symbol", "k", "outcome", F.round("raw_r", 6).alias("raw_r"))


def select_non_overlapping(spark, sf_dir):
    out = O.finalize_r(O.barrier_resolve(_signals(spark, sf_dir), _bars(spark, sf_dir), HOLD))
    made = {"pattern": F.lit("every_sixth"), "confidence": F.lit(0.5), "bucket": F.floor(F.col("entry") / 100), "cooldown": F.lit(12)}
    return O.select_non_overlapping(out.withColumns(made)).select("symbol", "k", "bias", "k_exit", "outcome")


def next_open_entry(spark, sf_dir):
    return O.next_open_entry(_signals(spark, sf_dir), _bars(spark, sf_dir)).select("symbol", "k", "fill", "risk", "reward")


def first_detection(spark, sf_dir):
    return O.first_detection(_signals(spark, sf_dir), 100).select("symbol", "bias", "k", "entry")


def recent_dedup(spark, sf_dir):
    trades = store.history_union(fixtures.trades(spark, sf_dir), fixtures.TRADE_TIES)
    return O.recent_dedup(trades.select("symbol", "pattern_name").distinct(), trades, "1998-06-01")


def trade_lifecycle(spark, sf_dir):
    return O.trade_lifecycle(_signals(spark, sf_dir), _bars(spark, sf_dir), HOLD)


def track_trades(spark, sf_dir):
    """Trades of both sides by closes, with trails of 1, 2 and 3 mean ranges of 14 bars, the first 13 bars of a series without one."""
    k = F.col("k")
    bars = _bars(spark, sf_dir).withColumn("atr", F.when(k >= 13, F.avg(F.col("h") - F.col("l")).over(I.frame(-13))))
    sign = F.when(k % 10 == 0, 1).otherwise(-1)
    fields = {"bias": F.when(k % 10 == 0, "long").otherwise("short"), "entry": F.col("c"), "stop": F.col("c") - sign * 150, "t1": F.col("c") + sign * 100, "t2": F.col("c") + sign * 200, "trail_by": (1 + k % 3).cast("double")}
    signals = bars.where(k % 5 == 0).select("symbol", "tf", "k", *(x.alias(name) for name, x in fields.items()))
    out = O.track_trades(signals, bars, HOLD)
    return out.select("symbol", "k", "bias", "status", F.round("stop_at", 4).alias("stop_at"), "entered_at", "ended_at", "realised_r", "peak_r", "trough_r")


def eod_close(spark, sf_dir):
    last = _bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("c", "ts").alias("last"))
    return O.eod_close(_signals(spark, sf_dir).join(last, "symbol")).select("symbol", "k", "action", F.round("r", 6).alias("r"))


def overnight_flag(spark, sf_dir):
    out = O.trade_lifecycle(_signals(spark, sf_dir), _bars(spark, sf_dir), HOLD)
    return out.select("symbol", "k", F.col("status").isin("PENDING", "ACTIVE", "AT_T1").alias("overnight"))


def param_sweep(spark, sf_dir):
    grid = [(s, t) for s in (100, 200, 300) for t in (200, 400, 600)]
    return O.param_sweep(_signals(spark, sf_dir), _bars(spark, sf_dir), grid).select("stop_d", "target_d", "n", "wins", F.round("score", 6).alias("score"))


#: Cells of the registered search.
CELLS = sweep.grid(stop=(1.0, 2.5), t1=(1.0, 2.0), t2=(3.0,), hold=(12, 40), cooldown=(8,), split_t1=(0.5, 0.7), split_t2=(0.3,))


def _swept(spark, sf_dir):
    """Signals of two patterns and both sides at every sixth bar, with the mean range of 14 bars as ATR."""
    bars = _bars(spark, sf_dir).withColumn("atr", F.avg(F.col("h") - F.col("l")).over(I.frame(-13)))
    k = F.col("k")
    fields = {"bias": F.when(k % 18 == 0, "short").otherwise("long"), "pattern": F.when(k % 12 == 0, "even").otherwise("odd"), "entry": F.col("c"), "bucket": F.floor(F.col("c") / 100)}
    signals = bars.where(k % 6 == 0).withColumns(fields)
    return sweep.sweep(signals.withColumn("confidence", F.lit(0.5)), bars, CELLS)


def param_grid(spark, sf_dir):
    found = sweep.by_cell(_swept(spark, sf_dir), CELLS)
    return found.select("pattern", "cell", "n", "wins", "total_milli", F.round("profit_factor", 6).alias("profit_factor"), F.round("score", 6).alias("score"))


def param_best(spark, sf_dir):
    """Each pattern's best cell on every other symbol by name, checked on the rest."""
    symbols = _bars(spark, sf_dir).select("symbol").distinct()
    halves = symbols.withColumn("half", (F.row_number().over(Window.orderBy("symbol")) - 1) % 2)  # a row for each symbol
    found = sweep.best_cells(_swept(spark, sf_dir), halves, CELLS)
    return found.select("pattern", "cell", "train_signals", F.round("train_score", 6).alias("train_score"), "val_signals", F.round("val_expectancy", 6).alias("val_expectancy"), "overfit")


def train_val_split(spark, sf_dir):
    """Symbols dealt to two halves by the rank of their volume; the gap of a pattern's mean R between them."""
    trades = store.history_union(fixtures.trades(spark, sf_dir), fixtures.TRADE_TIES)
    ranks = trades.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("half", F.row_number().over(Window.orderBy(F.desc("n"), "symbol")) % 2)
    sides = trades.join(ranks.select("symbol", "half"), "symbol").groupBy("pattern_name").pivot("half", [0, 1]).agg(F.avg("r_milli").alias("r"), F.count("r_milli").alias("n"))
    over = F.when(F.col("1_n") < 15, False).otherwise((F.col("1_r") < 0) | (F.col("1_r") < 0.5 * F.col("0_r")))
    return sides.select("pattern_name", F.round("0_r", 6).alias("train"), F.round("1_r", 6).alias("val"), over.alias("overfit"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_schedule, cooldown_bars, apply_slippage, first_touch_label, barrier_resolve, finalize_r, select_non_overlapping, next_open_entry, first_detection,
        recent_dedup, trade_lifecycle, track_trades, eod_close, overnight_flag, param_sweep, param_grid, param_best, train_val_split,
    )
}

_B = f"""{HOURLY}, bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k FROM hourly),
  sig AS (SELECT symbol, k, CASE WHEN k % 2 = 0 THEN 'long' ELSE 'short' END AS bias, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS sg, c AS entry, c - sg * 300 AS stop, c + sg * 300 AS t1, c + sg * 600 AS t2 FROM bars WHERE k % 6 = 0)"""


def _met(hold: int, source: str = "sig") -> str:
    return f"met AS (SELECT s.*, b.k AS bk, b.c AS bc, CASE WHEN sg = 1 THEN b.l ELSE -b.h END AS worst, CASE WHEN sg = 1 THEN b.h ELSE -b.l END AS best FROM {source} s JOIN bars b ON s.symbol = b.symbol AND b.k > s.k AND b.k <= s.k + {hold})"


_TOUCH = f"WITH {_B}, {_met(99)}, f AS (SELECT symbol, k, min(bk) FILTER (worst <= sg * stop) AS ks, min(bk) FILTER (best >= sg * t2) AS kt FROM met GROUP BY ALL)"
_RES = f"""{_B}, {_met(HOLD)},
  f AS (SELECT symbol, k, sg, bias, entry, stop, t1, t2, min(bk) FILTER (worst <= sg * stop) AS ks, min(bk) FILTER (best >= sg * t1) AS ka, max(bk) AS kl, arg_max(bc, bk) AS cl FROM met GROUP BY ALL),
  g AS (SELECT *, ka IS NOT NULL AND (ks IS NULL OR ka < ks) AS got1 FROM f),
  h AS (SELECT g.symbol, g.k, min(m.bk) FILTER (m.bk > ka AND worst <= m.sg * m.entry) AS kb, min(m.bk) FILTER (m.bk >= ka AND best >= m.sg * m.t2) AS kf FROM g JOIN met m USING (symbol, k) GROUP BY ALL),
  i AS (SELECT *, got1 AND kf IS NOT NULL AND (kb IS NULL OR kf < kb) AS got2, CASE WHEN kb IS NOT NULL THEN 0 ELSE round(sg * (cl - entry) / 300.0::DOUBLE, 3) END AS rest FROM g JOIN h USING (symbol, k)),
  res AS (SELECT *, CASE WHEN got1 AND got2 THEN 0.5::DOUBLE + 0.3::DOUBLE * 2 + 0.2::DOUBLE * rest WHEN got1 THEN 0.5::DOUBLE + 0.5::DOUBLE * rest WHEN ks IS NOT NULL THEN -1 ELSE round(sg * (cl - entry) / 300.0::DOUBLE, 3) END AS raw_r,
    CASE WHEN got1 THEN coalesce(kb, kl) ELSE coalesce(ks, kl) END AS k_exit FROM i)"""
_GRID = f"WITH {_B}, grid AS (SELECT s.v AS stop_d, t.v AS target_d FROM (VALUES (100), (200), (300)) s(v), (VALUES (200), (400), (600)) t(v)), gs AS (SELECT symbol, k, sg, entry, stop_d, target_d FROM sig, grid), {_met(60, 'gs')}"
_CELLS = ", ".join(f"({i}, {x.stop}::DOUBLE, {x.t1}::DOUBLE, {x.t2}::DOUBLE, {x.hold}, {x.cooldown}, {', '.join(f'{y}::DOUBLE' for y in x.splits())})" for i, x in enumerate(CELLS))
_LEG = "round(sg * ({}) / risk, 3)"
#: Every cell resolved bar by bar, then taken one candidate after another.
_SWEPT = f"""{_B}, cells(cell, sm, am, bm, hold, wait, w1, w2, w3) AS (VALUES {_CELLS}),
  atrs AS (SELECT symbol, k, c, avg(h - l) OVER {over(-13)} AS atr FROM bars),
  g0 AS (SELECT symbol, k, CASE WHEN k % 18 = 0 THEN -1 ELSE 1 END AS sg, CASE WHEN k % 12 = 0 THEN 'even' ELSE 'odd' END AS pattern, c AS entry, atr FROM atrs WHERE k % 6 = 0),
  gs AS (SELECT g0.*, cells.*, round_even(entry - sg * atr * sm, 0) AS stop, round_even(entry + sg * atr * am, 0) AS t1, round_even(entry + sg * atr * bm, 0) AS t2 FROM g0, cells),
  m AS (SELECT s.*, abs(entry - stop) AS risk, b.k AS bk, b.c AS bc, CASE WHEN sg = 1 THEN b.l ELSE -b.h END AS worst, CASE WHEN sg = 1 THEN b.h ELSE -b.l END AS best FROM gs s JOIN bars b ON s.symbol = b.symbol AND b.k > s.k AND b.k <= s.k + hold),
  f AS (SELECT symbol, k, cell, pattern, sg, entry, stop, t1, t2, risk, wait, w1, w2, w3, min(bk) FILTER (worst <= sg * stop) AS ks, min(bk) FILTER (best >= sg * t1) AS ka, max(bk) AS kl, arg_max(bc, bk) AS cl FROM m GROUP BY ALL),
  f2 AS (SELECT *, ka IS NOT NULL AND (ks IS NULL OR ka < ks) AS got1 FROM f),
  f3 AS (SELECT f.symbol, f.k, f.cell, min(m.bk) FILTER (m.bk > ka AND worst <= m.sg * m.entry) AS kb, min(m.bk) FILTER (m.bk >= ka AND best >= m.sg * m.t2) AS kf FROM f2 f JOIN m USING (symbol, k, cell) GROUP BY ALL),
  f4 AS (SELECT *, got1 AND kf IS NOT NULL AND (kb IS NULL OR kf < kb) AS got2, CASE WHEN kb IS NOT NULL THEN 0 ELSE {_LEG.format('cl - entry')} END AS rest FROM f2 JOIN f3 USING (symbol, k, cell)),
  f5 AS (SELECT *, CASE WHEN risk = 0 THEN -0.98::DOUBLE WHEN got1 AND got2 THEN w1 * {_LEG.format('t1 - entry')} + w2 * {_LEG.format('t2 - entry')} + w3 * rest WHEN got1 THEN w1 * {_LEG.format('t1 - entry')} + (w2 + w3) * rest
    WHEN ks IS NOT NULL THEN {_LEG.format('stop - entry')} ELSE {_LEG.format('cl - entry')} END AS raw, CASE WHEN risk = 0 THEN k + 1 WHEN got1 THEN coalesce(kb, kl) ELSE coalesce(ks, kl) END AS k_exit FROM f4),
  ca AS (SELECT symbol, pattern, cell, k, sg, floor(entry / 100)::BIGINT AS bucket, wait, k_exit, got1 AND risk > 0 AS won, round(round(greatest(-10, least(10, raw)) - 0.02::DOUBLE, 3) * 1000)::BIGINT AS r, row_number() OVER (PARTITION BY symbol, pattern, cell ORDER BY k) AS i FROM f5),
  gr(symbol, pattern, cell, i, took, until, lately) AS (SELECT symbol, pattern, cell, 0::BIGINT, false, -1::BIGINT, []::STRUCT(b INTEGER, u BIGINT, k BIGINT)[] FROM ca WHERE i = 1
    UNION ALL SELECT symbol, pattern, cell, i, ok, CASE WHEN ok THEN k_exit ELSE until END, CASE WHEN ok THEN list_append(held, {{'b': sg, 'u': bucket, 'k': k}}) ELSE held END
    FROM (SELECT c.symbol, c.pattern, c.cell, c.i, c.k, c.sg, c.bucket, c.k_exit, until, list_filter(lately, lambda x: c.k - x.k < c.wait) AS held,
      until <= c.k AND len(list_filter(lately, lambda x: c.k - x.k < c.wait AND x.b = c.sg AND x.u = c.bucket)) = 0 AS ok FROM gr JOIN ca c ON c.symbol = gr.symbol AND c.pattern = gr.pattern AND c.cell = gr.cell AND c.i = gr.i + 1)),
  tk AS (SELECT ca.* FROM gr JOIN ca USING (symbol, pattern, cell, i) WHERE took)"""
_CELL_SCORE = "CASE WHEN n >= 25 AND wins >= 0.25::DOUBLE * n THEN total / n::DOUBLE / 1000 * least(1.0::DOUBLE, sqrt(n / 100.0::DOUBLE)) ELSE -10 END"
ORACLE_SQL = {
    "param_grid": f"""WITH RECURSIVE {_SWEPT}, s AS (SELECT pattern, cell, count(*) AS n, count(*) FILTER (won) AS wins, sum(r)::BIGINT AS total, coalesce(sum(r) FILTER (won), 0) AS up, coalesce(-sum(r) FILTER (NOT won AND r <= 0), 0) AS down FROM tk GROUP BY ALL)
      SELECT pattern, cell, n, wins, total AS total_milli, round(least(99.0::DOUBLE, up::DOUBLE / greatest(down, 1)), 6) AS profit_factor, round({_CELL_SCORE}, 6) AS score FROM s""",
    "param_best": f"""WITH RECURSIVE {_SWEPT}, hs AS (SELECT symbol, (row_number() OVER (ORDER BY symbol) - 1) % 2 AS half FROM (SELECT DISTINCT symbol FROM bars)),
      s AS (SELECT pattern, cell, half, count(*) AS n, count(*) FILTER (won) AS wins, sum(r)::BIGINT AS total FROM tk JOIN hs USING (symbol) GROUP BY ALL),
      t AS (SELECT pattern, cell, n, {_CELL_SCORE} AS score FROM s WHERE half = 0), b AS (SELECT * FROM t WHERE score > -10 QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY round(score, 9) DESC, cell) = 1)
      SELECT pattern, cell, b.n AS train_signals, round(score, 6) AS train_score, coalesce(v.n, 0) AS val_signals, round(CASE WHEN v.n >= 15 THEN total / v.n::DOUBLE / 1000 END, 6) AS val_expectancy,
        v.n >= 15 AND (total < 0 OR (score > 0 AND total / v.n::DOUBLE / 1000 < 0.5::DOUBLE * score)) IS TRUE AS overfit FROM b LEFT JOIN (SELECT * FROM s WHERE half = 1) v USING (pattern, cell)""",
    "scan_schedule": f"WITH {_B}, t AS (SELECT symbol, count(*) AS bars_n FROM bars GROUP BY 1) SELECT symbol, k FROM bars JOIN t USING (symbol) WHERE bars_n >= 30 AND k >= 20 AND (k - 20) % 2 = 0",
    "cooldown_bars": f"WITH {CLOSED} SELECT id, greatest(1, floor(abs(r_milli) / 10 / [5, 15, 60, 390][regime + 1]))::BIGINT AS cooldown FROM closed",
    "apply_slippage": f"""WITH {_B}, d AS (SELECT symbol, ts, k, h, l, greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')}))::DOUBLE AS tr FROM bars), w AS (SELECT symbol, k, list(tr) OVER {over(-19)} AS t, list((h - l)::DOUBLE) OVER {over(-19)} AS r FROM d),
      x AS (SELECT symbol, k, list_concat([r[1]], t[2:]) AS t FROM w), a AS (SELECT symbol, k, CASE WHEN len(t) >= 14 THEN list_reduce(list_concat([list_sum(t[1:14]) / 14], t[15:]), lambda a, b: (a * 13 + b) / 14) ELSE 0 END AS atr FROM x)
      SELECT symbol, k, round(entry + sg * 0.05::DOUBLE * atr, 6) AS entry, round(abs(entry + sg * 0.05::DOUBLE * atr - stop), 6) AS risk FROM sig JOIN a USING (symbol, k)""",
    "first_touch_label": f"{_TOUCH} SELECT symbol, k, CASE WHEN kt IS NOT NULL AND (ks IS NULL OR kt < ks) THEN 'win' WHEN ks IS NOT NULL THEN 'loss' ELSE 'open' END AS label, CASE WHEN kt IS NOT NULL AND (ks IS NULL OR kt < ks) THEN 2.0::DOUBLE WHEN ks IS NOT NULL THEN -1.0::DOUBLE END AS r FROM f",
    "barrier_resolve": f"WITH {_RES} SELECT symbol, k, got1, got2, k_exit, round(raw_r, 6) AS raw_r FROM res",
    "finalize_r": f"WITH {_RES} SELECT symbol, k, CASE WHEN got1 AND got2 THEN 'win' WHEN got1 THEN 'partial_win' WHEN ks IS NULL AND raw_r > 0.0205 THEN 'timeout' ELSE 'loss' END AS outcome, round(raw_r, 6) AS raw_r FROM res",
    "next_open_entry": f"WITH {_B}, j AS (SELECT s.symbol, s.k, b.o AS fill, sg * (b.o - stop) AS risk, sg * (t2 - b.o) AS reward FROM sig s JOIN bars b ON b.symbol = s.symbol AND b.k = s.k + 1) SELECT * FROM j WHERE risk > 0 AND reward >= 1.5 * risk",
    "first_detection": f"WITH {_B} SELECT symbol, bias, min(k) AS k, arg_min(entry, k) AS entry FROM sig WHERE k >= 100 GROUP BY ALL",
    "recent_dedup": f"WITH {CLOSED}, p AS (SELECT DISTINCT symbol, pattern_name FROM closed) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM closed c WHERE c.symbol = p.symbol AND c.pattern_name = p.pattern_name AND closed_at BETWEEN TIMESTAMP '1998-06-01' - INTERVAL 30 DAY AND TIMESTAMP '1998-06-01')",
    "track_trades": f"""WITH {_B}, a AS (SELECT symbol, k, h, l, c, CASE WHEN k >= 13 THEN avg(h - l) OVER {over(-13)} ELSE 0 END AS atr FROM bars),
      g AS (SELECT symbol, k, CASE WHEN k % 10 = 0 THEN 1 ELSE -1 END AS sg, c AS entry, 1 + k % 3 AS m FROM bars WHERE k % 5 = 0),
      m AS (SELECT g.*, a.k AS bk, a.atr, sg * (a.c - entry) AS p FROM g JOIN a ON a.symbol = g.symbol AND a.k > g.k AND a.k <= g.k + {HOLD}),
      x1 AS (SELECT *, min(bk) FILTER (p >= 0) OVER w AS act, min(bk) FILTER (p <= -150) OVER w AS ex FROM m WINDOW w AS (PARTITION BY symbol, k)),
      x2 AS (SELECT *, act IS NULL AND ex IS NOT NULL OR ex < act AS expired, min(bk) FILTER (bk > act AND p <= -150) OVER w AS st, min(bk) FILTER (bk > act AND p >= 100) OVER w AS one FROM x1 WINDOW w AS (PARTITION BY symbol, k)),
      x3 AS (SELECT *, CASE WHEN one < st OR st IS NULL THEN one END AS t1 FROM x2),
      x4 AS (SELECT *, min(bk) FILTER (bk > t1 AND p <= 0) OVER w AS even, min(bk) FILTER (bk > t1 AND p >= 200) OVER w AS two FROM x3 WINDOW w AS (PARTITION BY symbol, k)),
      x5 AS (SELECT *, CASE WHEN two < even OR even IS NULL THEN two END AS t2 FROM x4),
      x6 AS (SELECT *, max(CASE WHEN bk = t2 AND atr <= 0 THEN 0 WHEN bk >= t2 AND atr > 0 THEN p - atr * m END) OVER (PARTITION BY symbol, k ORDER BY bk) AS trail FROM x5),
      x7 AS (SELECT *, min(bk) FILTER (bk > t2 AND atr > 0 AND p <= trail) OVER w AS shut FROM x6 WINDOW w AS (PARTITION BY symbol, k)),
      x8 AS (SELECT *, CASE WHEN expired THEN ex WHEN t1 IS NULL THEN st WHEN t2 IS NULL THEN even ELSE shut END AS ended FROM x7),
      y AS (SELECT symbol, k, sg, entry, any_value(ended) AS ended_at, any_value(CASE WHEN NOT coalesce(expired, false) THEN act END) AS entered_at, any_value(t1) AS t1, any_value(t2) AS t2, bool_or(expired) AS expired, max(bk) AS kl,
        arg_max(trail, bk) FILTER (ended IS NULL OR bk <= ended) AS trail, greatest(0.0::DOUBLE, max(round(p / 150.0::DOUBLE, 3)) FILTER (ended IS NULL OR bk <= ended)) AS peak_r, least(0.0::DOUBLE, min(round(p / 150.0::DOUBLE, 3)) FILTER (ended IS NULL OR bk <= ended)) AS trough_r FROM x8 GROUP BY ALL),
      z AS (SELECT *, CASE WHEN expired THEN 'EXPIRED' WHEN entered_at IS NULL THEN 'PENDING' WHEN t1 IS NULL THEN CASE WHEN ended_at IS NULL THEN 'ACTIVE' ELSE 'STOPPED' END WHEN t2 IS NULL THEN CASE WHEN ended_at IS NULL THEN 'AT_T1' ELSE 'STOPPED' END
        WHEN ended_at IS NOT NULL THEN 'CLOSED' WHEN t2 = kl THEN 'AT_T2' ELSE 'TRAILING' END AS status FROM y)
      SELECT symbol, k, CASE WHEN sg = 1 THEN 'long' ELSE 'short' END AS bias, status, round(CASE WHEN status = 'AT_T1' OR status = 'STOPPED' AND t1 IS NOT NULL THEN entry WHEN status IN ('AT_T2', 'TRAILING', 'CLOSED') THEN sg * (sg * entry + trail) ELSE entry - sg * 150 END, 4) AS stop_at, entered_at, ended_at,
        CASE WHEN status = 'CLOSED' THEN round(trail / 150.0::DOUBLE, 3) WHEN status = 'STOPPED' AND t1 IS NULL THEN -1.0::DOUBLE WHEN status = 'STOPPED' THEN 0.0::DOUBLE END AS realised_r, peak_r, trough_r FROM z""",
    "eod_close": f"WITH {_B}, la AS (SELECT symbol, arg_max(c, ts) AS last FROM bars GROUP BY 1), j AS (SELECT *, sg * (last - entry)::DOUBLE / 300 AS way FROM sig JOIN la USING (symbol)) SELECT symbol, k, CASE WHEN way >= 0.7 THEN 'gap_risk' ELSE 'closed' END AS action, CASE WHEN way < 0.7 THEN round(way, 6) END AS r FROM j",
    "param_sweep": f"{_GRID}, f AS (SELECT symbol, k, stop_d, target_d, min(bk) FILTER (worst <= sg * (entry - sg * stop_d)) AS ks, min(bk) FILTER (best >= sg * (entry + sg * target_d)) AS kt FROM met GROUP BY ALL), "
    "l AS (SELECT *, CASE WHEN kt IS NOT NULL AND (ks IS NULL OR kt < ks) THEN target_d::DOUBLE / stop_d WHEN ks IS NOT NULL THEN -1 END AS r FROM f) SELECT stop_d::BIGINT AS stop_d, target_d::BIGINT AS target_d, count(r) AS n, count(*) FILTER (r > 0) AS wins, round(sum(r) / count(r) * least(1.0::DOUBLE, sqrt(count(r) / 100.0::DOUBLE)), 6) AS score FROM l GROUP BY ALL",
    "train_val_split": f"WITH {CLOSED}, rk AS (SELECT symbol, row_number() OVER (ORDER BY n DESC, symbol) % 2 AS half FROM (SELECT symbol, count(*) AS n FROM closed GROUP BY 1)), "
    "s AS (SELECT pattern_name, avg(r_milli) FILTER (half = 0) AS a, avg(r_milli) FILTER (half = 1) AS b, count(*) FILTER (half = 1) AS nb FROM closed JOIN rk USING (symbol) GROUP BY 1) SELECT pattern_name, round(a, 6) AS train, round(b, 6) AS val, CASE WHEN nb < 15 THEN false ELSE b < 0 OR b < 0.5 * a END AS overfit FROM s",
}
