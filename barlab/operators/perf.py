"""Performance of closed trades. Global running sums run over day or trade-run tables, never raw rows. R in thousandths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(*keys: str):
    """Aggregates of one group of trades."""
    r = F.col("r_milli")
    return [
        F.count("*").alias("n"), F.count_if(r > 0).alias("wins"), F.count_if(r < 0).alias("losses"), F.count_if(r == 0).alias("flats"), F.sum(r).alias("total"),
        F.sum(F.when(r > 0, r).otherwise(0)).alias("gain"), F.sum(F.when(r < 0, -r).otherwise(0)).alias("pain"), F.max(r).alias("best"), F.min(r).alias("worst"),
    ]


def rates(df: DataFrame) -> DataFrame:
    wr = F.col("wins") / F.col("n")
    avg_win, avg_loss = F.coalesce(F.try_divide("gain", "wins"), F.lit(0.0)), F.coalesce(F.try_divide("pain", "losses"), F.lit(0.0))
    pf = F.when(F.col("pain") > 0, F.col("gain") / F.col("pain")).when(F.col("gain") > 0, 99.0).otherwise(0.0)
    return df.withColumns({"wr": wr, "avg_win": avg_win, "avg_loss": avg_loss, "pf": pf, "expectancy": wr * avg_win - (1 - wr) * avg_loss, "avg": F.col("total") / F.col("n")})


def performance(trades: DataFrame, *keys: str) -> DataFrame:
    return rates(trades.groupBy(*keys).agg(*totals()))


def equity_curve(trades: DataFrame) -> DataFrame:
    """Daily R and count, and the running total over the short table of days."""
    days = trades.groupBy(F.to_date("closed_at").alias("day")).agg(F.sum("r_milli").alias("r"), F.count("*").alias("n"))
    return days.withColumn("equity", F.sum("r").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def drawdown(trades: DataFrame) -> DataFrame:
    """Drawdown from the running peak, which starts at 0."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    curve = equity_curve(trades).withColumn("peak", F.greatest(F.lit(0), F.max("equity").over(w)))
    return curve.withColumn("drawdown", F.col("peak") - F.col("equity"))


def zero_filled(df: DataFrame, start: Column, stop: Column, step: str, on: str) -> DataFrame:
    """Every calendar step of a range, with zeros where there is no row."""
    grid = df.sparkSession.range(1).select(F.explode(F.sequence(start, stop, F.expr(f"INTERVAL {step}"))).alias(on))
    return grid.join(df.hint("merge"), on, "left").fillna(0)


def streak_runs(trades: DataFrame) -> DataFrame:
    """Runs of wins and losses in closing order: kind, length, sum, first and last time. A flat ends a run.

    Rows are cut into days; a day's inner runs are final, and only its first and last runs, a short table, are
    joined across days. So no task sees the whole history. `at` (day and place in it) orders the runs by their ends.
    """
    sign = F.signum("r_milli").cast("int")
    day = Window.partitionBy("day").orderBy("closed_at", "id")
    rows = trades.select(F.to_date("closed_at").alias("day"), "closed_at", "id", "r_milli", sign.alias("sign"))
    rows = rows.withColumn("new", F.when((F.col("sign") == F.lag("sign").over(day)) & (F.col("sign") != 0), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    local = rows.groupBy("day", "run", "sign").agg(F.count("*").alias("length"), F.sum("r_milli").alias("total"))
    local = local.withColumn("last", F.max("run").over(Window.partitionBy("day")))
    edge = (F.col("run") == 1) | (F.col("run") == F.col("last"))
    inner = local.where(~edge).select("sign", "length", "total", F.col("day").alias("first_day"), F.col("day").alias("last_day"), F.struct("day", "run").alias("at"))
    order = Window.orderBy("day", "run")
    goes_on = (F.col("sign") == F.lag("sign").over(order)) & (F.col("sign") != 0) & (F.col("day") != F.lag("day").over(order))
    joined = local.where(edge).withColumn("new", F.when(goes_on, 0).otherwise(1))
    joined = joined.withColumn("number", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    across = joined.groupBy("number", "sign").agg(F.sum("length").alias("length"), F.sum("total").alias("total"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max(F.struct("day", "run")).alias("at"))
    return inner.unionByName(across.drop("number"))


def streaks(trades: DataFrame) -> DataFrame:
    """Best win run, worst loss run, and the current one, signed."""
    runs = streak_runs(trades)
    return runs.agg(
        F.coalesce(F.max(F.when(F.col("sign") > 0, F.col("length"))), F.lit(0)).alias("best_win"),
        F.coalesce(F.max(F.when(F.col("sign") < 0, F.col("length"))), F.lit(0)).alias("worst_loss"),
        F.max_by(F.col("sign") * F.col("length"), "at").alias("current"),
    )


def best_worst(trades: DataFrame, n: int = 20) -> DataFrame:
    top = trades.orderBy(F.desc("r_milli"), "id").limit(n).withColumn("side", F.lit("best"))
    return top.unionByName(trades.orderBy("r_milli", "id").limit(n).withColumn("side", F.lit("worst")))
