"""D: indicators over trailing frames, on daily bars unless a session is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions import indicators as I
from barlab.operators import resample
from barlab.queries.sql import DAILY, HOURLY, K, lag, over
from barlab.sources import fixtures

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def r6(x: Column) -> Column:
    return F.round(x, 6)


def _register(name: str, build, sql: dict[str, str], bars: str = "daily", pre: str = "", table: str | None = None, columns=("symbol", "ts")) -> None:
    """build(bars) gives a frame with `columns` and the keys of `sql`."""

    def run(spark, sf_dir: str) -> DataFrame:
        source = fixtures.daily(spark, sf_dir) if bars == "daily" else fixtures.intraday(spark, sf_dir)
        return build(source).select(*columns, *sql)

    QUERIES[name] = run
    with_ = DAILY if bars == "daily" else HOURLY
    body = ", ".join([*columns, *(f"{x} AS {k}" for k, x in sql.items())])
    ORACLE_SQL[name] = f"WITH {with_}{', ' + pre if pre else ''} SELECT {body} FROM {table or bars}"


def _columns(name: str, made, sql: dict[str, str], **more) -> None:
    """made() gives the columns; Columns need a session, so they are made when the query runs."""
    _register(name, lambda df: df.withColumns(made()), sql, **more)


PREV = f"prevs AS (SELECT *, {lag('c')} AS prev, {lag('h')} AS prev_h, {lag('l')} AS prev_l, c - {lag('c')} AS diff, {lag('c')} IS NOT NULL AS has, avg(v) OVER {over(-49)} AS v50, CASE WHEN c::DOUBLE / nullif({lag('c')}, 0) > 0 THEN ln(c::DOUBLE / {lag('c')}) END AS ret, {K} AS k FROM daily)"


def with_previous(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"prev": I.back("c", 1), "prev_h": I.back("h", 1), "prev_l": I.back("l", 1), "v50": F.avg("v").over(I.frame(-49)), "ret": I.log_return()}
    ).withColumn("diff", F.col("c") - F.col("prev"))


def _previous(name: str, made, sql: dict[str, str]) -> None:
    _register(name, lambda df: with_previous(df).withColumns(made()), sql, pre=PREV, table="prevs")


TR = f"greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')}))"
_columns("true_range", lambda: {"tr": I.true_range()}, {"tr": TR})
_columns("sma", lambda: {"sma20": r6(I.sma(20)), "sma50": r6(I.sma(50))}, {f"sma{p}": f"CASE WHEN {K} >= {p} THEN round(avg(c) OVER {over(1 - p)}, 6) END" for p in (20, 50)})
STD = lambda p: f"CASE WHEN {K} >= {p} THEN stddev_pop(c) OVER {over(1 - p)} END"
_columns("rolling_std", lambda: {"std20": r6(I.rolling_std(20))}, {"std20": f"round({STD(20)}, 6)"})
_columns("zscore", lambda: {"z20": r6(I.zscore(20))}, {"z20": f"round((c - avg(c) OVER {over(-19)}) / nullif({STD(20)}, 0), 6)"})
_previous("log_returns", lambda: {"ret8": F.round("ret", 8), "pct": F.round(I.pct_return(), 8), "vol60": r6(I.annual_vol(60)), "vol252": r6(I.annual_vol(252))}, {
    "ret8": "round(ret, 8)", "pct": "round(c::DOUBLE / nullif(prev, 0) - 1, 8)", **{f"vol{p}": f"CASE WHEN k > {p} THEN round(stddev_pop(ret) OVER {over(1 - p)} * sqrt(252), 6) END" for p in (60, 252)}})
_columns("roc", lambda: {f"roc{n}": F.round(I.roc(n), 8) for n in (5, 20, 60)}, {f"roc{n}": f"round(c::DOUBLE / {lag('c', n)} - 1, 8)" for n in (5, 20, 60)})
_columns("rvol", lambda: {"rvol": F.round(I.rvol(), 8)}, {"rvol": f"CASE WHEN {K} >= 23 THEN round(avg(v) OVER {over(-2)} / nullif(avg(v) OVER {over(-22, -3)}, 0), 8) END"})
_columns("donchian", lambda: {"high20": I.donchian_high(20), "low20": I.donchian_low(20)}, {"high20": f"CASE WHEN {K} > 20 THEN max(h) OVER {over(-20, -1)} END", "low20": f"CASE WHEN {K} > 20 THEN min(l) OVER {over(-20, -1)} END"})
_columns("range_position", lambda: {f"pos{p}": r6(I.range_position(p)) for p in (20, 50, 252)}, {
    f"pos{p}": f"CASE WHEN {K} >= {p} THEN round((c - min(l) OVER {over(1 - p)}) * 100.0::DOUBLE / nullif(max(h) OVER {over(1 - p)} - min(l) OVER {over(1 - p)}, 0), 6) END" for p in (20, 50, 252)})
_columns("bollinger", lambda: dict(zip(("upper", "lower", "bandwidth"), map(r6, I.bollinger(20, 2.0)), strict=True)), {
    "upper": f"round(avg(c) OVER {over(-19)} + 2 * {STD(20)}, 6)", "lower": f"round(avg(c) OVER {over(-19)} - 2 * {STD(20)}, 6)", "bandwidth": f"round(4 * {STD(20)} / avg(c) OVER {over(-19)}, 6)"})
_register("bandwidth_rank", lambda df: df.withColumn("bandwidth", r6(I.bollinger(30, 2.25)[2])).withColumn("rank", r6(I.bandwidth_rank())),
    {"rank": f"CASE WHEN count(bw) OVER {over(-125, -20)} >= 20 THEN round(len(list_filter(list(bw) OVER {over(-125, -20)}, lambda x: x > bw))::DOUBLE / count(bw) OVER {over(-125, -20)}, 6) END"},
    pre=f"widths AS (SELECT *, round(4.5 * {STD(30)} / avg(c) OVER {over(-29)}, 6) AS bw FROM daily)", table="widths")
_columns("rolling_vwap", lambda: {"vwap20": r6(I.rolling_vwap())}, {"vwap20": f"round(coalesce((sum((h + l + c) * v) OVER {over(-19)}) / 3.0::DOUBLE / nullif(sum(v) OVER {over(-19)}, 0), (h + l + c) / 3.0::DOUBLE), 6)"})
SESSIONS = """days AS (SELECT *, ts::DATE AS day, coalesce(min(CASE WHEN hour(ts) * 60 + minute(ts) >= 570 THEN ts END) OVER (PARTITION BY symbol, ts::DATE), min(ts) OVER (PARTITION BY symbol, ts::DATE)) AS opened FROM hourly)"""
_register("session_anchor", lambda df: df.withColumn("opened", I.session_open()), {"opened": "opened"}, bars="hourly", pre=SESSIONS, table="days")
_register("session_vwap", lambda df: df.withColumn("opened", I.session_open()).withColumn("vwap", r6(I.session_vwap())),
    {"vwap": "round(sum(CASE WHEN ts >= opened THEN (h + l + c) * v END) OVER w / 3.0::DOUBLE / nullif(sum(CASE WHEN ts >= opened THEN v END) OVER w, 0), 6)"},
    bars="hourly", pre=SESSIONS, table="days WINDOW w AS (PARTITION BY symbol, day ORDER BY ts ROWS UNBOUNDED PRECEDING)")


def _opening(df: DataFrame) -> DataFrame:
    high, low = I.opening_range(60)
    return df.withColumn("opened", I.session_open()).withColumns({"or_high": high, "or_low": low})


_register("opening_range", _opening, {k: f"{f}(CASE WHEN ts BETWEEN opened AND opened + INTERVAL 60 MINUTE THEN {x} END) OVER (PARTITION BY symbol, day)" for k, f, x in (("or_high", "max", "h"), ("or_low", "min", "l"))}, bars="hourly", pre=SESSIONS, table="days")
_columns("volume_confirm", lambda: {"confirmed": I.volume_confirm(1.2)}, {"confirmed": f"({K} <= 20 OR avg(v) OVER {over(-20, -1)} <= 0 OR v >= 1.2::DOUBLE * avg(v) OVER {over(-20, -1)})"})
_columns("volume_exhaustion", lambda: {"exhausted": I.volume_exhaustion()}, {"exhausted": f"v <= 1.3::DOUBLE * avg(v) OVER {over(-3, -1)}"})
_columns("volume_declining", lambda: {"declining": I.volume_declining(12)}, {"declining": f"coalesce(avg(v) OVER {over(-5)} <= 1.1::DOUBLE * avg(v) OVER {over(-11, -6)}, true)"})
_columns("volume_touch", lambda: {"touch": r6(I.touch_volume())}, {"touch": f"round(avg(v) OVER {over(-2, 2)}, 6)"})
_columns("higher_lows", lambda: {"rising": I.higher_lows(), "falling": I.lower_highs()}, {
    "rising": f"CASE WHEN {K} >= 10 THEN min(l) OVER {over(-4)} > min(l) OVER {over(-9, -5)} AND min(l) OVER {over(-2)} > min(l) OVER {over(-9, -7)} END",
    "falling": f"CASE WHEN {K} >= 10 THEN max(h) OVER {over(-4)} < max(h) OVER {over(-9, -5)} AND max(h) OVER {over(-2)} < max(h) OVER {over(-9, -7)} END"})
_columns("range_squeeze", lambda: {"squeeze": F.round(I.range_squeeze(), 9)}, {"squeeze": f"CASE WHEN {K} >= 20 THEN round(avg(h - l) OVER {over(-4)} / nullif(avg(h - l) OVER {over(-19, -5)}, 0), 9) END"})
_previous("acc_dist_days", lambda: dict(zip(("acc", "dist"), I.acc_dist_days(10), strict=True)), {
    f: f"coalesce(len(list_filter(list({{'v': v, 'up': c > prev}}) FILTER (has) OVER {over(-9)}, lambda x: x.v > v50 AND {c})), 0)" for f, c in (("acc", "x.up"), ("dist", "NOT x.up"))})
_previous("volume_bias", lambda: {"bias": r6(I.volume_bias())}, {"bias": f"CASE WHEN k > 20 THEN round(avg(CASE WHEN c > prev THEN v END) OVER {over(-19)} / avg(CASE WHEN c < prev THEN v END) OVER {over(-19)}, 6) END"})
_previous("hh_hl_structure", lambda: I.structure_counts(), {k: f"(count(*) FILTER ({x}) OVER {over(-4)})" for k, x in (("hh", "h > prev_h"), ("lh", "h < prev_h"), ("hl", "l > prev_l"), ("ll", "l < prev_l"))})
_columns("momentum_character", lambda: {"character": I.momentum_character(I.roc(21), I.roc(63))}, {
    "character": f"CASE WHEN nullif({lag('c', 63)}, 0) IS NULL OR nullif({lag('c', 21)}, 0) IS NULL THEN NULL WHEN c::DOUBLE / {lag('c', 21)} - 1 < 0 THEN 'declining' WHEN c::DOUBLE / {lag('c', 21)} - 1 > (c::DOUBLE / {lag('c', 63)} - 1) / 3 THEN 'accelerating' ELSE 'decelerating' END"})
_VOLS = f"round(stddev_pop(ret) OVER {over(-59)} / nullif(stddev_pop(ret) OVER {over(-251)}, 0), 8)"
_previous("vol_regime_label", lambda: {"label": I.vol_regime_label(F.round(F.try_divide(I.annual_vol(60), I.annual_vol(252)), 8))}, {
    "label": f"CASE WHEN k > 252 THEN CASE WHEN {_VOLS} < 0.7 THEN 'compressed' WHEN {_VOLS} > 1.4 THEN 'expanded' WHEN {_VOLS} IS NOT NULL THEN 'normal' END END"})
_previous("rsi_simple", lambda: {"rsi": r6(I.rsi_simple())}, {
    "rsi": f"CASE WHEN k > 14 THEN CASE WHEN sum(greatest(-diff, 0)) OVER {over(-13)} = 0 THEN 100 ELSE round(100 - 100 / (1 + sum(greatest(diff, 0)) OVER {over(-13)}::DOUBLE / sum(greatest(-diff, 0)) OVER {over(-13)}), 6) END END"})
_columns("range_mean_atr", lambda: {"atr": r6(I.range_mean_atr())}, {"atr": f"CASE WHEN {K} >= 14 THEN round(avg(h - l) OVER {over(-13)}, 6) END"})
_columns("swing_highs_lows", lambda: {"is_high": I.swing_high(3), "is_low": I.swing_low(3)}, {
    "is_high": f"h > max(h) OVER {over(-3, -1)} AND h > max(h) OVER {over(1, 3)}", "is_low": f"l < min(l) OVER {over(-3, -1)} AND l < min(l) OVER {over(1, 3)}"})


def technical_snapshot(bars: DataFrame) -> DataFrame:
    """The last bar of each series with its indicators."""
    made = {
        "change": F.round(I.pct_return() * 100, 6), "atr": r6(I.range_mean_atr()), "sma20": r6(I.sma(20)), "sma50": r6(I.sma(50)), "sma200": r6(I.sma(200)),
        "high252": F.max("h").over(I.frame(-251)), "low252": F.min("l").over(I.frame(-251)), "rest": F.row_number().over(Window.partitionBy("symbol", "tf").orderBy(F.desc("ts"))),
    }
    return bars.withColumns(made).where("rest = 1").withColumns({"from_high": F.round((F.col("c") / F.col("high252") - 1) * 100, 6), "from_low": F.round((F.col("c") / F.col("low252") - 1) * 100, 6)})


_SNAP = f"""snap AS (SELECT *, round((c::DOUBLE / {lag('c')} - 1) * 100, 6) AS change, round(avg(h - l) OVER {over(-13)}, 6) AS atr, round(avg(c) OVER {over(-19)}, 6) AS sma20,
  round(avg(c) OVER {over(-49)}, 6) AS sma50, round(avg(c) OVER {over(-199)}, 6) AS sma200, max(h) OVER {over(-251)} AS high252, min(l) OVER {over(-251)} AS low252,
  row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rest FROM daily)"""
_register("technical_snapshot", technical_snapshot, {
    "c": "c", "change": "change", "atr": "atr", "sma20": "sma20", "sma50": "sma50", "sma200": "sma200", "high252": "high252", "low252": "low252",
    "from_high": "round((c::DOUBLE / high252 - 1) * 100, 6)", "from_low": "round((c::DOUBLE / low252 - 1) * 100, 6)"}, pre=_SNAP, table="snap WHERE rest = 1")


def nr7(bars: DataFrame) -> DataFrame:
    """Whether the session's range is the least of 7."""
    days = resample.daily_range(bars)
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-6, 0)
    return days.withColumn("nr7", (F.count("*").over(w) == 7) & (F.col("range") == F.min("range").over(w)))


_register("nr7", nr7, {"nr7": "nr7"}, bars="hourly", columns=("symbol", "day"), table="z",
    pre="d AS (SELECT symbol, ts::DATE AS day, max(h) - min(l) AS rg FROM hourly GROUP BY ALL), z AS (SELECT *, count(*) OVER w = 7 AND rg = min(rg) OVER w AS nr7 FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING))")


def _streaks(keyed: DataFrame, order: list[str], value: str) -> DataFrame:
    """Signed run length of rises and falls of `value`; a tie ends a run."""
    w = Window.partitionBy("symbol").orderBy(*order)
    sign = F.coalesce(F.signum(F.col(value) - F.lag(value).over(w)), F.lit(0.0)).cast("long")
    runs = keyed.withColumn("sign", sign).withColumn("new", F.when(F.col("sign") == F.lag("sign").over(w), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("streak", F.col("sign") * F.row_number().over(Window.partitionBy("symbol", "run").orderBy(*order)))


def _streak_sql(table: str, order: str, value: str) -> str:
    return f"""a AS (SELECT *, coalesce(sign({value} - lag({value}) OVER (PARTITION BY symbol ORDER BY {order})), 0)::BIGINT AS sg FROM {table}),
 b AS (SELECT *, CASE WHEN sg = lag(sg) OVER (PARTITION BY symbol ORDER BY {order}) THEN 0 ELSE 1 END AS nw FROM a),
 r AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM b),
 z AS (SELECT *, sg * row_number() OVER (PARTITION BY symbol, run ORDER BY {order}) AS streak FROM r)"""


_register("weekly_streak", lambda df: _streaks(resample.weekly_close(df), ["year", "week"], "close"), {"streak": "streak"}, columns=("symbol", "year", "week"),
    pre=f"wk AS (SELECT symbol, isoyear(ts)::BIGINT AS year, week(ts)::BIGINT AS week, arg_max(c, ts) AS close FROM daily GROUP BY ALL), {_streak_sql('wk', 'year, week', 'close')}", table="z")
_register("up_down_streak", lambda df: _streaks(df, ["ts"], "c"), {"streak": "streak"}, pre=_streak_sql("daily", "ts", "c"), table="z")


def gap(bars: DataFrame) -> DataFrame:
    """First open of a day against the last close of the calendar day before, in percent."""
    days = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min_by("o", "ts").alias("open"), F.max_by("c", "ts").alias("close"))
    before = days.select("symbol", F.date_add("day", 1).alias("day"), F.col("close").alias("prev_close"))
    return days.join(before, ["symbol", "day"]).withColumn("gap", F.round((F.col("open") / F.col("prev_close") - 1) * 100, 6))


_register("gap", gap, {"gap": "gap"}, bars="hourly", columns=("symbol", "day"), table="z",
    pre="d AS (SELECT symbol, ts::DATE AS day, arg_min(o, ts) AS op, arg_max(c, ts) AS cl FROM hourly GROUP BY ALL), z AS (SELECT a.symbol, a.day, round((a.op::DOUBLE / b.cl - 1) * 100, 6) AS gap FROM d a JOIN d b ON a.symbol = b.symbol AND b.day = (a.day - INTERVAL 1 DAY)::DATE)")
