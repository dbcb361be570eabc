"""J: outcome statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators import stats
from barlab.queries.sql import CLOSED
from barlab.sources import bars as store
from barlab.sources import fixtures

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(store.history_union(fixtures.trades(spark, sf_dir), fixtures.TRADE_TIES))
    ORACLE_SQL[name] = sql


_METRICS = ["n", "win", "partial_win", "loss", "timeout", "wr", "pf", "expectancy", "avg_r", "best", "worst"]


def _shown(df: DataFrame, *keys: str, more=()) -> DataFrame:
    whole = {"n", "win", "partial_win", "loss", "timeout", "best", "worst"}
    return df.select(*keys, *(F.col(m) if m in whole else F.round(m, 9).alias(m) for m in _METRICS), *more)


def stats_cte(name: str, source: str, keys: str, win: str = "outcome IN ('win', 'partial_win')") -> str:
    return f"""{name}_0 AS (SELECT {keys}, count(*) AS n, count(*) FILTER (outcome = 'win') AS win, count(*) FILTER (outcome = 'partial_win') AS partial_win, count(*) FILTER (outcome = 'loss') AS loss,
      count(*) FILTER (outcome = 'timeout') AS timeout, count(*) FILTER ({win})::DOUBLE / count(*) AS wr, coalesce(sum(r_milli) FILTER ({win}), 0)::DOUBLE AS gain, coalesce(sum(abs(r_milli)) FILTER (outcome = 'loss'), 0)::DOUBLE AS pain,
      coalesce(avg(r_milli / 1000.0::DOUBLE) FILTER ({win}), 0) AS aw, coalesce(avg(abs(r_milli / 1000.0::DOUBLE)) FILTER (outcome = 'loss'), 0) AS al, avg(r_milli) / 1000 AS avg_r, max(r_milli) AS best, min(r_milli) AS worst, stddev_pop(r_milli / 1000.0::DOUBLE) AS std
      FROM {source} GROUP BY {keys}),
      {name} AS (SELECT *, CASE WHEN pain > 0 THEN least(99, gain / pain) WHEN gain > 0 THEN 99 ELSE 0 END AS pf, wr * aw - (1 - wr) * al AS expectancy FROM {name}_0)"""


_SHOW = "n, win, partial_win, loss, timeout, round(wr, 9) AS wr, round(pf, 9) AS pf, round(expectancy, 9) AS expectancy, round(avg_r, 9) AS avg_r, best, worst"
clip = lambda x: f"greatest(0, least(100, {x}))"
_CORE = f"0.30::DOUBLE * {clip('(wr - 0.35::DOUBLE) / 0.35::DOUBLE * 100')} + 0.25::DOUBLE * {clip('(pf - 0.5::DOUBLE) / 2.5::DOUBLE * 100')} + 0.20::DOUBLE * {clip('(expectancy + 0.5::DOUBLE) / 1.5::DOUBLE * 100')}"
EDGE = f"{_CORE} + 0.15::DOUBLE * {clip('n / 50.0::DOUBLE * 100')} + 0.10::DOUBLE * {clip('(3 - CASE WHEN n > 1 THEN std ELSE 2 END) / 3 * 100')}"
HOT = f"{_CORE} + 0.15::DOUBLE * {clip('n / 30.0::DOUBLE * 100')} + 0.10::DOUBLE * {clip('50.0::DOUBLE + 10 * streak')}"
ALT = "least(100, 0.4::DOUBLE * wr * 100 + 10 * least(pf, 5) + 20 * least(expectancy, 1) + least(n, 20))"
GRADE = "CASE WHEN edge >= 70 AND n >= 20 THEN 'A' WHEN edge >= 55 AND n >= 10 THEN 'B' WHEN edge >= 40 THEN 'C' WHEN edge >= 25 THEN 'D' ELSE 'F' END"
_P = f"WITH {CLOSED}, {stats_cte('s', 'closed', 'pattern_name')}"
_SP = f"WITH {CLOSED}, {stats_cte('s', 'closed', 'symbol, pattern_name')}"

_add("pattern_stats", lambda t: _shown(stats.pattern_stats(t, "pattern_name"), "pattern_name"), f"{_P} SELECT pattern_name, {_SHOW} FROM s")
_add("symbol_pattern_stats", lambda t: _shown(stats.pattern_stats(t, "symbol", "pattern_name"), "symbol", "pattern_name"), f"{_SP} SELECT symbol, pattern_name, {_SHOW} FROM s")
_add("edge_score", lambda t: stats.pattern_stats(t, "pattern_name").select("pattern_name", F.round(stats.edge_score(), 6).alias("edge")), f"{_P} SELECT pattern_name, round({EDGE}, 6) AS edge FROM s")
_add("symbol_analytics", lambda t: stats.symbol_analytics(t).select("symbol", "pattern_name", "n", "edge", F.col("rank").cast("long").alias("rank")),
    f"{_SP}, r AS (SELECT symbol, pattern_name, n, round({ALT}, 6) AS edge FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY edge DESC, pattern_name) AS rank FROM r) SELECT * FROM k WHERE rank <= 5")
_add("symbol_summary", lambda t: t.groupBy("symbol").agg(F.count("*").alias("signals"), F.count_if(F.col("outcome").isin("win", "partial_win")).alias("wins")).withColumn("wr", F.round(F.col("wins") / F.col("signals"), 6)),
    f"WITH {CLOSED} SELECT symbol, count(*) AS signals, count(*) FILTER (outcome IN ('win', 'partial_win')) AS wins, round(count(*) FILTER (outcome IN ('win', 'partial_win'))::DOUBLE / count(*), 6) AS wr FROM closed GROUP BY 1")
_add("run_summary", lambda t: t.rollup("pattern_name").agg(F.count("*").alias("n"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("win", "partial_win", "loss", "timeout"))),
    f"WITH {CLOSED} SELECT pattern_name, count(*) AS n, {', '.join(f'''count(*) FILTER (outcome = '{o}') AS {o}''' for o in ('win', 'partial_win', 'loss', 'timeout'))} FROM closed GROUP BY ROLLUP (pattern_name)")


def _grades(t: DataFrame) -> DataFrame:
    graded = stats.pattern_stats(t, "pattern_name").where("n >= 3").withColumn("edge", F.round(stats.edge_score(), 6))
    graded = graded.withColumn("grade", stats.grade(F.col("edge"), F.col("n")))
    return graded.groupBy("grade").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("pattern_name")), ",").alias("names"))


_add("grade_table", _grades, f"{_P}, g AS (SELECT pattern_name, n, round({EDGE}, 6) AS edge FROM s WHERE n >= 3), h AS (SELECT pattern_name, {GRADE} AS grade FROM g) SELECT grade, count(*) AS n, string_agg(pattern_name, ',' ORDER BY pattern_name) AS names FROM h GROUP BY 1")
_add("grade", lambda t: stats.pattern_stats(t, "symbol", "pattern_name").withColumn("edge", F.round(stats.edge_score(), 6)).select("symbol", "pattern_name", stats.grade(F.col("edge"), F.col("n")).alias("grade")),
    f"{_SP}, g AS (SELECT symbol, pattern_name, n, round({EDGE}, 6) AS edge FROM s) SELECT symbol, pattern_name, {GRADE} AS grade FROM g")
_LAST = f"{CLOSED}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern_name ORDER BY closed_at DESC, id DESC) AS back FROM closed) WHERE back <= 60)"
_ROLL = f"{_LAST}, {stats_cte('s', 'last', 'pattern_name', '''outcome = 'win' ''')}"
_add("rolling_metrics", lambda t: _shown(stats.rolling_metrics(t), "pattern_name"), f"WITH {_ROLL} SELECT pattern_name, {_SHOW} FROM s WHERE n >= 3")
_STREAK = """kinds AS (SELECT pattern_name, back, CASE outcome WHEN 'win' THEN 1 WHEN 'loss' THEN -1 ELSE 0 END AS kind FROM last),
  heads AS (SELECT *, first(kind) OVER (PARTITION BY pattern_name ORDER BY back) AS newest FROM kinds),
  st AS (SELECT pattern_name, (any_value(newest) * (coalesce(min(back) FILTER (kind <> newest), count(*) + 1) - 1))::BIGINT AS streak FROM heads GROUP BY 1)"""
_add("recent_streak", stats.recent_streak, f"WITH {_LAST}, {_STREAK} SELECT pattern_name, streak FROM st")
_HOT = f"{_ROLL}, {_STREAK}, hot AS (SELECT pattern_name, n, round({HOT}, 6) AS hot FROM s JOIN st USING (pattern_name) WHERE n >= 3)"
_add("hot_score", lambda t: stats.hot_scores(t).select("pattern_name", "hot"), f"WITH {_HOT} SELECT pattern_name, hot FROM hot")
_add("hot_top_n", lambda t: stats.hot_scores(t).orderBy(F.desc("hot"), "pattern_name").limit(10).select("pattern_name", "hot"), f"WITH {_HOT} SELECT pattern_name, hot FROM hot ORDER BY hot DESC, pattern_name LIMIT 10")
_add("hot_types", lambda t: stats.hot_scores(t).groupBy((F.regexp_extract("pattern_name", r"(\d+)$", 1).cast("long") % 4).alias("strategy_type")).agg(F.count("*").alias("n"), F.round(F.avg("hot"), 5).alias("hot")),
    f"WITH {_HOT} SELECT regexp_extract(pattern_name, '([0-9]+)$', 1)::BIGINT % 4 AS strategy_type, count(*) AS n, round(avg(hot), 5) AS hot FROM hot GROUP BY 1")
_add("strategy_score", lambda t: stats.strategy_score(t.select("pattern_name").distinct().union(t.sparkSession.createDataFrame([("none such",)], "pattern_name string")), stats.hot_scores(t)).select("pattern_name", "score"),
    f"WITH {_HOT}, w AS (SELECT DISTINCT pattern_name FROM closed UNION ALL SELECT 'none such') SELECT w.pattern_name, round(coalesce(least(1.0::DOUBLE, n / 10.0::DOUBLE) * hot + (1 - least(1.0::DOUBLE, n / 10.0::DOUBLE)) * 50, 50), 6) AS score FROM w LEFT JOIN hot USING (pattern_name)")
_add(
    "edge_lookup",
    # the edge of a trade's pattern on either side: every trade is looked up, and every trade counts on its side
    lambda t: t.select("id", "pattern_name", "bias").join(
        stats.pattern_stats(t, "pattern_name", "bias").select("pattern_name", "bias", F.round(stats.edge_score(), 6).alias("edge")).hint("merge"), ["pattern_name", "bias"], "left"
    ),
    f"WITH {CLOSED}, {stats_cte('s', 'closed', 'pattern_name, bias')} SELECT pattern_name, bias, id, round({EDGE}, 6) AS edge FROM closed LEFT JOIN s USING (pattern_name, bias)",
)
_add(
    "backtest_vs_live",
    # the backtest has all trades closed before 1996, the live record those after; a pattern may lack on either side
    lambda t: stats.backtest_vs_live(t.where("closed_at < TIMESTAMP_NTZ'1996-01-01 00:00:00'"), t.where("closed_at >= TIMESTAMP_NTZ'1996-01-01 00:00:00'")),
    f"WITH {CLOSED}, bt AS (SELECT * FROM closed WHERE closed_at < '1996-01-01'), lv AS (SELECT * FROM closed WHERE closed_at >= '1996-01-01'), "
    f"{stats_cte('a', 'bt', 'pattern_name')}, {stats_cte('b', 'lv', 'pattern_name')} "
    "SELECT pattern_name, a.n AS n_bt, round(a.wr, 6) AS wr_bt, round(a.expectancy, 6) AS exp_bt, b.n AS n_live, round(b.wr, 6) AS wr_live, round(b.expectancy, 6) AS exp_live, "
    "round(round(b.expectancy, 6) - round(a.expectancy, 6), 5) AS gap FROM a FULL JOIN b USING (pattern_name)",
)
_add("compare_runs", lambda t: t.groupBy("pattern_name").pivot("regime", [0, 1, 2, 3]).agg(F.sum("r_milli")).select("pattern_name", *(F.col(str(k)).alias(f"run{k}") for k in range(4))),
    f"WITH {CLOSED} SELECT pattern_name, {', '.join(f'(sum(r_milli) FILTER (regime = {k}))::BIGINT AS run{k}' for k in range(4))} FROM closed GROUP BY 1")
_add("kelly_fraction", lambda t: stats.pattern_stats(t, "pattern_name").where("n >= 10").select("pattern_name", F.round(stats.clip(F.try_divide("wr", "avg_loss") - F.try_divide(1 - F.col("wr"), F.col("avg_win")), 0.0, 0.25), 6).alias("kelly")),
    f"{_P} SELECT pattern_name, round(greatest(0, least(0.25, wr / al - (1 - wr) / aw)), 6) AS kelly FROM s WHERE n >= 10")
_add("edge_assessment", lambda t: stats.pattern_stats(t, "symbol").withColumn("e", F.round("expectancy", 6)).select("symbol", F.when(F.col("e") >= 0.20, "strong").when(F.col("e") >= 0.05, "moderate").when(F.col("e") >= 0, "marginal").when(F.col("e") >= -0.05, "weak").otherwise("negative").alias("label")),
    f"WITH {CLOSED}, {stats_cte('s', 'closed', 'symbol')} SELECT symbol, CASE WHEN round(expectancy, 6) >= 0.2 THEN 'strong' WHEN round(expectancy, 6) >= 0.05 THEN 'moderate' WHEN round(expectancy, 6) >= 0 THEN 'marginal' WHEN round(expectancy, 6) >= -0.05 THEN 'weak' ELSE 'negative' END AS label FROM s")
