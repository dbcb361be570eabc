"""Statistics of trade outcomes: by pattern, by symbol, rolling, graded and compared. R is in thousandths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _mean(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def pattern_stats(outcomes: DataFrame, *keys: str, partial_wins: bool = True) -> DataFrame:
    """Counts, win rate, profit factor, expectancy and extremes by key: one aggregation with partial sums."""
    r = F.col("r_milli") / 1000.0
    win = F.col("outcome").isin("win", "partial_win") if partial_wins else F.col("outcome") == "win"
    lost, n = F.col("outcome") == "loss", F.count("*")
    out = outcomes.groupBy(*keys).agg(
        n.alias("n"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("win", "partial_win", "loss", "timeout")),
        (F.count_if(win) / n).alias("wr"),
        F.sum(F.when(win, F.col("r_milli")).otherwise(0)).alias("gain"),
        F.sum(F.when(lost, F.abs("r_milli")).otherwise(0)).alias("pain"),
        _mean(F.avg(F.when(win, r))).alias("avg_win"), _mean(F.avg(F.when(lost, F.abs(r)))).alias("avg_loss"),
        (F.sum("r_milli") / n / 1000.0).alias("avg_r"), F.max("r_milli").alias("best"), F.min("r_milli").alias("worst"), F.stddev_pop(r).alias("std"),
    )
    pf = F.when(F.col("pain") > 0, F.least(F.lit(99.0), F.col("gain") / F.col("pain"))).when(F.col("gain") > 0, 99.0).otherwise(0.0)
    return out.withColumn("pf", pf).withColumn("expectancy", F.col("wr") * F.col("avg_win") - (1 - F.col("wr")) * F.col("avg_loss"))


def edge_score() -> Column:
    """30 % win rate, 25 % profit factor, 20 % expectancy, 15 % sample, 10 % consistency, each from 0 to 100."""
    std = F.when(F.col("n") > 1, F.col("std")).otherwise(2.0)
    return (
        0.30 * clip((F.col("wr") - 0.35) / 0.35 * 100) + 0.25 * clip((F.col("pf") - 0.5) / 2.5 * 100) + 0.20 * clip((F.col("expectancy") + 0.5) / 1.5 * 100)
        + 0.15 * clip(F.col("n") / 50.0 * 100) + 0.10 * clip((3 - std) / 3 * 100)
    )


def alternative_edge() -> Column:
    return F.least(F.lit(100.0), 0.4 * F.col("wr") * 100 + 10 * F.least(F.col("pf"), F.lit(5.0)) + 20 * F.least(F.col("expectancy"), F.lit(1.0)) + F.least(F.col("n"), F.lit(20)))


def grade(edge: Column, n: Column) -> Column:
    return F.when((edge >= 70) & (n >= 20), "A").when((edge >= 55) & (n >= 10), "B").when(edge >= 40, "C").when(edge >= 25, "D").otherwise("F")


def symbol_analytics(outcomes: DataFrame, top: int = 5) -> DataFrame:
    """The best patterns of each symbol by the alternative edge."""
    stats = pattern_stats(outcomes, "symbol", "pattern_name").withColumn("edge", F.round(alternative_edge(), 6))
    ranked = stats.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("edge"), "pattern_name")))
    return ranked.where(F.col("rank") <= top)


def last_outcomes(outcomes: DataFrame, last: int = 60) -> DataFrame:
    """Each pattern's last outcomes in arrival order, position 1 the newest."""
    order = [F.desc("closed_at"), F.desc("id")]
    return outcomes.withColumn("back", F.row_number().over(Window.partitionBy("pattern_name").orderBy(*order))).where(F.col("back") <= last)


def rolling_metrics(outcomes: DataFrame, last: int = 60) -> DataFrame:
    return pattern_stats(last_outcomes(outcomes, last), "pattern_name", partial_wins=False).where("n >= 3")


def recent_streak(outcomes: DataFrame, last: int = 60) -> DataFrame:
    """Signed run of wins or losses from the newest outcome back; anything else ends it."""
    kind = F.when(F.col("outcome") == "win", 1).when(F.col("outcome") == "loss", -1).otherwise(0)
    newest = F.first("kind").over(Window.partitionBy("pattern_name").orderBy("back"))
    marked = last_outcomes(outcomes, last).withColumn("kind", kind).withColumn("newest", newest)
    ended = F.min(F.when(F.col("kind") != F.col("newest"), F.col("back")))
    out = marked.groupBy("pattern_name").agg(F.first("newest").alias("sign"), F.coalesce(ended, F.count("*") + 1).alias("end"))
    return out.select("pattern_name", (F.col("sign") * (F.col("end") - 1)).cast("long").alias("streak"))


def hot_score(streak: Column) -> Column:
    return (
        0.30 * clip((F.col("wr") - 0.35) / 0.35 * 100) + 0.25 * clip((F.col("pf") - 0.5) / 2.5 * 100) + 0.20 * clip((F.col("expectancy") + 0.5) / 1.5 * 100)
        + 0.15 * clip(F.col("n") / 30.0 * 100) + 0.10 * clip(50.0 + 10 * streak)
    )


def hot_scores(outcomes: DataFrame) -> DataFrame:
    joined = rolling_metrics(outcomes).join(recent_streak(outcomes).hint("merge"), "pattern_name")
    return joined.withColumn("hot", F.round(hot_score(F.col("streak")), 6))


def strategy_score(wanted: DataFrame, hot: DataFrame) -> DataFrame:
    """The hot score drawn towards 50 by a small sample; 50 without one."""
    weight = F.least(F.lit(1.0), F.col("n") / 10.0)
    score = F.coalesce(weight * F.col("hot") + (1 - weight) * 50, F.lit(50.0))
    return wanted.join(hot.select("pattern_name", "hot", "n"), "pattern_name", "left").withColumn("score", F.round(score, 6))


def backtest_vs_live(backtest: DataFrame, live: DataFrame) -> DataFrame:
    """The same metrics of both sides by pattern, and their gap."""
    side = lambda df, s: pattern_stats(df, "pattern_name").select("pattern_name", F.col("n").alias(f"n_{s}"), F.round("wr", 6).alias(f"wr_{s}"), F.round("expectancy", 6).alias(f"exp_{s}"))
    return side(backtest, "bt").join(side(live, "live"), "pattern_name", "full").withColumn("gap", F.round(F.col("exp_live") - F.col("exp_bt"), 5))
