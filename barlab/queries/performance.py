"""K: performance analytics over closed trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators import perf
from barlab.queries.sql import CLOSED
from barlab.sources import bars as store
from barlab.sources import fixtures

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(store.history_union(fixtures.trades(spark, sf_dir), fixtures.TRADE_TIES))
    ORACLE_SQL[name] = f"WITH {CLOSED} {sql}"


_WHOLE = ["n", "wins", "losses", "flats", "total", "best", "worst"]


def _shown(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *_WHOLE, *(F.round(m, 6).alias(m) for m in ("wr", "avg_win", "avg_loss", "pf", "expectancy")))


def _sql(keys: dict[str, str]) -> str:
    names, body = ", ".join(f"{x} AS {k}" for k, x in keys.items()), f"{', '.join(keys)}, " if keys else ""
    return f"""SELECT {body}n, wins, losses, flats, total, best, worst, round(wr, 6) AS wr, round(aw, 6) AS avg_win, round(al, 6) AS avg_loss, round(CASE WHEN pain > 0 THEN gain / pain WHEN gain > 0 THEN 99 ELSE 0 END, 6) AS pf, round(wr * aw - (1 - wr) * al, 6) AS expectancy
      FROM (SELECT *, wins::DOUBLE / n AS wr, coalesce(gain / nullif(wins, 0), 0) AS aw, coalesce(pain / nullif(losses, 0), 0) AS al FROM (SELECT {names + ', ' if names else ''}count(*) AS n, count(*) FILTER (r_milli > 0) AS wins, count(*) FILTER (r_milli < 0) AS losses,
        count(*) FILTER (r_milli = 0) AS flats, sum(r_milli)::BIGINT AS total, max(r_milli) AS best, min(r_milli) AS worst, coalesce(sum(r_milli) FILTER (r_milli > 0), 0)::DOUBLE AS gain, coalesce(sum(-r_milli) FILTER (r_milli < 0), 0)::DOUBLE AS pain FROM closed {'GROUP BY ALL' if keys else ''}))"""


_add("performance_summary", lambda t: _shown(perf.performance(t)), _sql({}))
_add("pattern_attribution", lambda t: _shown(perf.performance(t, "pattern_name"), "pattern_name"), _sql({"pattern_name": "pattern_name"}))
_add("symbol_stats", lambda t: _shown(perf.performance(t, "symbol"), "symbol"), _sql({"symbol": "symbol"}))
_add("bias_stats", lambda t: _shown(perf.performance(t, "bias"), "bias"), _sql({"bias": "bias"}))
_add("time_of_day", lambda t: _shown(perf.performance(t.withColumn("hour", F.hour(F.coalesce("detected_at", "entered_at")).cast("long")), "hour"), "hour"), _sql({"hour": "hour(coalesce(detected_at, entered_at))"}))
_add("regime_stats", lambda t: _shown(perf.performance(t.withColumn("regime", F.coalesce(F.when(F.col("regime") != 3, F.concat(F.lit("r"), F.col("regime").cast("string"))), F.lit("unknown"))), "regime"), "regime"),
    _sql({"reg": "CASE WHEN regime <> 3 THEN concat('r', regime) ELSE 'unknown' END"}).replace("SELECT reg, n", "SELECT reg AS regime, n", 1))
_add("equity_curve", perf.equity_curve, "SELECT closed_at::DATE AS day, sum(r_milli)::BIGINT AS r, count(*) AS n, (sum(sum(r_milli)) OVER (ORDER BY closed_at::DATE))::BIGINT AS equity FROM closed GROUP BY 1")
_EQ = ", e AS (SELECT closed_at::DATE AS day, (sum(sum(r_milli)) OVER (ORDER BY closed_at::DATE))::BIGINT AS equity FROM closed GROUP BY 1), p AS (SELECT *, greatest(0, max(equity) OVER (ORDER BY day)) AS peak FROM e)"
_add("drawdown_series", lambda t: perf.drawdown(t).select("day", "equity", "peak", "drawdown"), f"{_EQ} SELECT day, equity, peak, peak - equity AS drawdown FROM p")
_add("max_drawdown", lambda t: perf.drawdown(t).agg(F.max("drawdown").alias("max_drawdown"), F.max_by("drawdown", "day").alias("current"), F.max_by("day", F.struct("drawdown", -F.datediff("day", F.lit("1970-01-01")))).alias("day")),
    f"{_EQ}, d AS (SELECT day, peak - equity AS dd FROM p) SELECT max(dd) AS max_drawdown, arg_max(dd, day) AS current, min(day) FILTER (dd = (SELECT max(dd) FROM d)) AS day FROM d")


def _calendar(t: DataFrame, first, step: str, name: str) -> DataFrame:
    sums = t.groupBy(first.alias(name)).agg(F.sum("r_milli").alias("r"), F.count("*").alias("n"))
    return perf.zero_filled(sums, F.lit("1995-01-02").cast("date"), F.lit("1998-12-28").cast("date"), step, name)


_add("daily_pnl", lambda t: _calendar(t, F.to_date("closed_at"), "1 DAY", "day"), "SELECT g.d::DATE AS day, coalesce(sum(r_milli), 0)::BIGINT AS r, count(r_milli) AS n FROM range(DATE '1995-01-02', DATE '1998-12-29', INTERVAL 1 DAY) g(d) LEFT JOIN closed ON closed_at::DATE = g.d::DATE GROUP BY 1")
_add("weekly_pnl", lambda t: _calendar(t, F.trunc("closed_at", "week"), "7 DAY", "week"), "SELECT g.d::DATE AS week, coalesce(sum(r_milli), 0)::BIGINT AS r, count(r_milli) AS n FROM range(DATE '1995-01-02', DATE '1998-12-29', INTERVAL 7 DAY) g(d) LEFT JOIN closed ON date_trunc('week', closed_at)::DATE = g.d::DATE GROUP BY 1")
_add("monthly_pnl", lambda t: t.groupBy(F.date_format("closed_at", "yyyy-MM").alias("month")).agg(F.sum("r_milli").alias("r"), F.count("*").alias("n")), "SELECT strftime(closed_at, '%Y-%m') AS month, sum(r_milli)::BIGINT AS r, count(*) AS n FROM closed GROUP BY 1")
_RUNS = """, s AS (SELECT closed_at, id, r_milli, sign(r_milli) AS sg FROM closed), f AS (SELECT *, CASE WHEN sg = lag(sg) OVER (ORDER BY closed_at::DATE, closed_at, id) AND sg <> 0 THEN 0 ELSE 1 END AS nw FROM s),
  u AS (SELECT *, sum(nw) OVER (ORDER BY closed_at::DATE, closed_at, id ROWS UNBOUNDED PRECEDING) AS run FROM f), runs AS (SELECT run, any_value(sg)::INT AS sg, count(*) AS length, sum(r_milli)::BIGINT AS total, min(closed_at)::DATE AS a, max(closed_at)::DATE AS b FROM u GROUP BY 1)"""
_add("streak_runs", lambda t: perf.streak_runs(t).select("sign", "length", "total", "first_day", "last_day"), f'{_RUNS} SELECT sg AS "sign", length, total, a AS first_day, b AS last_day FROM runs')
_add("streaks", perf.streaks, f"{_RUNS} SELECT coalesce(max(length) FILTER (sg > 0), 0) AS best_win, coalesce(max(length) FILTER (sg < 0), 0) AS worst_loss, arg_max(sg * length, run) AS current FROM runs")
_hours = lambda: F.timestamp_diff("HOUR", F.col("entered_at").cast("timestamp"), F.col("closed_at").cast("timestamp"))
_add("hold_time", lambda t: t.withColumn("h", _hours()).groupBy("pattern_name").agg(F.round(F.avg(F.when(F.col("r_milli") > 0, F.col("h"))), 6).alias("win_hours"), F.round(F.avg(F.when(F.col("r_milli") < 0, F.col("h"))), 6).alias("loss_hours"), F.expr("try_element_at(array_sort(collect_list(h)), CAST(floor(count(*) / 2) + 1 AS INT))").alias("upper_median")),
    "SELECT pattern_name, round(avg(h) FILTER (r_milli > 0), 6) AS win_hours, round(avg(h) FILTER (r_milli < 0), 6) AS loss_hours, list_sort(list(h))[count(*) // 2 + 1] AS upper_median FROM (SELECT *, datediff('hour', entered_at, closed_at) AS h FROM closed) GROUP BY 1")
_add("best_worst", lambda t: perf.best_worst(t).select("side", "id", "r_milli"), "SELECT * FROM (SELECT 'best' AS side, id, r_milli FROM closed ORDER BY r_milli DESC, id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'worst', id, r_milli FROM closed ORDER BY r_milli, id LIMIT 20)")
_add("trade_timeline", lambda t: fixtures.running_total(t.withColumn("one", F.lit(1)), ["one"], F.to_date("closed_at"), ["closed_at", "id"], F.col("r_milli"), "running").select("id", "closed_at", "r_milli", "running"),
    "SELECT id, closed_at, r_milli, (sum(r_milli) OVER (ORDER BY closed_at, id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM closed")
_add("equity_daily_delta", lambda t: perf.equity_curve(t).select("day", (F.col("equity") - F.coalesce(F.lag("equity").over(Window.orderBy("day")), F.lit(0))).alias("delta")), f"{_EQ} SELECT day, equity - coalesce(lag(equity) OVER (ORDER BY day), 0) AS delta FROM p")
_add("day_summary", lambda t: t.groupBy(F.to_date("closed_at").alias("day")).agg(F.count("*").alias("setups"), F.count_if(F.col("r_milli") > 0).alias("w"), F.count_if(F.col("r_milli") < 0).alias("l"), F.count_if(F.col("r_milli") == 0).alias("be"), F.count_if(F.col("outcome").isin("win", "partial_win")).alias("t1"), F.count_if(F.col("outcome") == "win").alias("t2"), F.sum("r_milli").alias("r"), F.count_distinct("pattern_name").alias("patterns")),
    "SELECT closed_at::DATE AS day, count(*) AS setups, count(*) FILTER (r_milli > 0) AS w, count(*) FILTER (r_milli < 0) AS l, count(*) FILTER (r_milli = 0) AS be, count(*) FILTER (outcome IN ('win', 'partial_win')) AS t1, count(*) FILTER (outcome = 'win') AS t2, sum(r_milli)::BIGINT AS r, count(DISTINCT pattern_name) AS patterns FROM closed GROUP BY 1")
_add("active_by_pattern", lambda t: t.where("closed_at >= TIMESTAMP_NTZ'1998-11-01 00:00:00'").groupBy("pattern_name").agg(F.count("*").alias("n"), F.round(F.avg("r_milli"), 6).alias("mean_r"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols")),
    "SELECT pattern_name, count(*) AS n, round(avg(r_milli), 6) AS mean_r, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM closed WHERE closed_at >= '1998-11-01' GROUP BY 1")
