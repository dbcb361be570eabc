"""E and F1: recursions, on daily bars; the SQL side is a recursive query over bar numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.functions import folds
from barlab.functions import indicators as I
from barlab.operators import resample
from barlab.queries.sql import DAILY, K, lag, over
from barlab.sources import fixtures


def _folded(*names: str, digits: int = 6):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = folds.fold_series(fixtures.daily(spark, sf_dir), names)
        return out.select("symbol", "ts", *(F.round(n, digits).alias(n) for n in names))

    return run


def affine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20-bar EMA from the first close by chunks."""
    k = 2 / 21
    bars = resample.with_index(fixtures.daily(spark, sf_dir))
    return folds.affine_scan(bars, 1 - k, k, "c", "ema", 256).select("symbol", "ts", F.round("ema", 6).alias("ema"))


def macd_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.fold_series(fixtures.daily(spark, sf_dir), ("emaf12", "emaf26")).withColumn("macd", F.col("emaf12") - F.col("emaf26"))
    return out.select("symbol", "ts", F.round("macd", 6).alias("macd"), F.round(I.back("macd", 1), 6).alias("macd1"), F.round(I.back("macd", 2), 6).alias("macd2"))


def keltner(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.fold_series(fixtures.daily(spark, sf_dir), ("emaf20", "atr"))
    return out.select("symbol", "ts", F.round(F.col("emaf20") + 2 * F.col("atr"), 6).alias("upper"), F.round(F.col("emaf20") - 2 * F.col("atr"), 6).alias("lower"))


def atr_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folds.fold_series(fixtures.daily(spark, sf_dir), ("atr",))
    return with_atr_ratio(out).select("symbol", "ts", F.round("atr_ratio", 6).alias("atr_ratio"))


def with_atr_ratio(df: DataFrame) -> DataFrame:
    """ATR over the median of the 60 before the last 14; 1 with too little history."""
    past = F.percentile("atr", F.lit(0.5)).over(I.frame(-73, -14))
    valid = F.count("atr").over(I.series().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("atr_ratio", F.when((valid >= 19) & (past > 0), F.col("atr") / past).otherwise(1.0))


def atr_at_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilder's mean restarted on the last 20 bars; the first of them has no bar before it."""
    bars = fixtures.daily(spark, sf_dir).withColumns({"tr": I.true_range().cast("double"), "hl": (F.col("h") - F.col("l")).cast("double")})
    last = F.collect_list(F.struct("tr", "hl")).over(I.frame(-19))
    own = F.transform(last, lambda x, i: F.when(i == 0, x["hl"]).otherwise(x["tr"]))
    return bars.withColumn("list", own).select("symbol", "ts", F.round(folds.windowed_atr(F.col("list")), 6).alias("atr"))


def rsi_wilder(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = F.collect_list("c").over(I.frame(-19))
    return fixtures.daily(spark, sf_dir).withColumn("closes", closes).select("symbol", "ts", F.when(F.size("closes") == 20, F.round(folds.rsi_wilder(F.col("closes")), 6)).alias("rsi"))


def zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.zigzag_pivots(fixtures.daily(spark, sf_dir), 0.03)


QUERIES = {
    "wilder_atr": _folded("atr"), "ema_sma_seed": _folded("ema9", "ema21"), "ema_first_seed": _folded("emaf12", "emaf50"), "adx": _folded("adx", digits=5),
    **{f.__name__: f for f in (affine_scan, macd_hist, keltner, atr_ratio, atr_at_window, rsi_wilder, zigzag)},
}

_D = f"{DAILY}, d AS (SELECT symbol, ts, h, l, c, {K} AS k, greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')}))::DOUBLE AS tr, c - {lag('c')} AS diff FROM daily)"


def _recur(name: str, start: int, seed: str, step: str) -> str:
    """Rows of a recursion from bar number `start` on; `y` is the value before."""
    return f"""{name}(symbol, k, y) AS (SELECT symbol, {start}::BIGINT, {seed} FROM d WHERE k <= {start} GROUP BY symbol HAVING max(k) = {start}
      UNION ALL SELECT d.symbol, d.k, {step} FROM {name} e JOIN d ON d.symbol = e.symbol AND d.k = e.k + 1)"""


def ema_sql(name: str, p: int, first: bool) -> str:
    k = 2 / (p + 1)
    return _recur(name, 1 if first else p, "avg(c)::DOUBLE", f"{1 - k!r}::DOUBLE * y + {k!r}::DOUBLE * d.c")


ATR_SQL = _recur("atr", 14, "avg(tr)", "(y * 13 + d.tr) / 14")


def _read(columns: dict[str, str], more: str = "") -> str:
    joins = " ".join(f"LEFT JOIN {t} USING (symbol, k)" for t in columns.values())
    return f"FROM d {joins}"


ORACLE_SQL = {
    "wilder_atr": f"WITH RECURSIVE {_D}, {ATR_SQL} SELECT symbol, ts, round(y, 6) AS atr FROM d LEFT JOIN atr USING (symbol, k)",
    "ema_sma_seed": f"WITH RECURSIVE {_D}, {ema_sql('a', 9, False)}, {ema_sql('b', 21, False)} SELECT symbol, ts, round(a.y, 6) AS ema9, round(b.y, 6) AS ema21 FROM d LEFT JOIN a USING (symbol, k) LEFT JOIN b USING (symbol, k)",
    "ema_first_seed": f"WITH RECURSIVE {_D}, {ema_sql('a', 12, True)}, {ema_sql('b', 50, True)} SELECT symbol, ts, round(a.y, 6) AS emaf12, round(b.y, 6) AS emaf50 FROM d LEFT JOIN a USING (symbol, k) LEFT JOIN b USING (symbol, k)",
    "affine_scan": f"WITH RECURSIVE {_D}, {ema_sql('a', 20, True)} SELECT symbol, ts, round(y, 6) AS ema FROM d LEFT JOIN a USING (symbol, k)",
    "macd_hist": f"""WITH RECURSIVE {_D}, {ema_sql('a', 12, True)}, {ema_sql('b', 26, True)}, m AS (SELECT symbol, ts, a.y - b.y AS macd FROM d JOIN a USING (symbol, k) JOIN b USING (symbol, k))
      SELECT symbol, ts, round(macd, 6) AS macd, round({lag('macd')}, 6) AS macd1, round({lag('macd', 2)}, 6) AS macd2 FROM m""",
    "keltner": f"WITH RECURSIVE {_D}, {ema_sql('a', 20, True)}, {ATR_SQL} SELECT symbol, ts, round(a.y + 2 * atr.y, 6) AS upper, round(a.y - 2 * atr.y, 6) AS lower FROM d LEFT JOIN a USING (symbol, k) LEFT JOIN atr USING (symbol, k)",
    "atr_ratio": f"""WITH RECURSIVE {_D}, {ATR_SQL}, m AS (SELECT symbol, ts, y, quantile_cont(y, 0.5) OVER {over(-73, -14)} AS med, count(y) OVER {over(-10000000)} AS n FROM d LEFT JOIN atr USING (symbol, k))
      SELECT symbol, ts, round(CASE WHEN n >= 19 AND med > 0 THEN y / med ELSE 1 END, 6) AS atr_ratio FROM m""",
    "atr_at_window": f"""WITH {_D}, w AS (SELECT symbol, ts, list(tr) OVER {over(-19)} AS t, list((h - l)::DOUBLE) OVER {over(-19)} AS r FROM d), x AS (SELECT symbol, ts, list_concat([r[1]], t[2:]) AS t FROM w)
      SELECT symbol, ts, CASE WHEN len(t) >= 14 THEN round(list_reduce(list_concat([list_sum(t[1:14]) / 14], t[15:]), lambda a, b: (a * 13 + b) / 14), 6) END AS atr FROM x""",
    "rsi_wilder": f"""WITH {_D}, w AS (SELECT symbol, ts, k, (list(diff) OVER {over(-18)}) AS t FROM d),
      g AS (SELECT symbol, ts, k, [greatest(x, 0)::DOUBLE for x in t] AS u, [greatest(-x, 0)::DOUBLE for x in t] AS v FROM w),
      s AS (SELECT symbol, ts, k, list_reduce(list_concat([list_sum(u[1:14]) / 14], u[15:]), lambda a, b: (a * 13 + b) / 14) AS gain, list_reduce(list_concat([list_sum(v[1:14]) / 14], v[15:]), lambda a, b: (a * 13 + b) / 14) AS loss FROM g)
      SELECT symbol, ts, CASE WHEN k >= 20 THEN round(CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END, 6) END AS rsi FROM s""",
}
