"""Universe of symbols and the quality of stored bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators.news import symbol_valid

LEAST_PRICE, LEAST_VOLUME = 500, 500_000


def skip_reason():
    """Why a symbol is left out; the first reason counts."""
    return F.when(~symbol_valid(F.col("symbol")), "bad_symbol").when(F.col("px").isNull(), "no_price").when(F.col("px") < LEAST_PRICE, "low_price").when(F.col("volume") < LEAST_VOLUME, "low_volume")


def top_symbols(universe: DataFrame, n: int) -> DataFrame:
    ok = universe.where(skip_reason().isNull()).withColumn("value", F.col("px") * F.col("volume"))
    return ok.orderBy(F.desc("value"), "symbol").limit(n)


def skip_reasons(universe: DataFrame) -> DataFrame:
    return universe.groupBy(F.coalesce(skip_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def daily_universe(bars: DataFrame, excluded: list[str], n: int) -> DataFrame:
    """The n symbols of each day with the largest 20-day mean of close times volume; all if n is 0."""
    value = F.avg(F.col("c") * F.col("v")).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-19, 0))
    ranked = bars.where(~F.col("symbol").isin(excluded)).withColumn("value", value).withColumn("rank", F.dense_rank().over(Window.partitionBy("ts").orderBy(F.desc("value"))))
    return ranked.where((F.col("rank") <= n) | F.lit(n == 0))


def hot_list(*sources: DataFrame) -> DataFrame:
    """Union by priority, each symbol at its first source."""
    each = [s.select("symbol", F.lit(i).alias("priority")) for i, s in enumerate(sources)]
    out = each[0]
    for s in each[1:]:
        out = out.unionByName(s)
    return out.groupBy("symbol").agg(F.min("priority").alias("priority"))


def verify_square(bars: DataFrame) -> DataFrame:
    """By timeframe: symbols, least, median and most bars, first and last day."""
    per = bars.groupBy("tf", "symbol").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return per.groupBy("tf").agg(F.count("*").alias("symbols"), F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"), F.min("a").alias("first"), F.max("b").alias("last"))


def missing_symbols(bars: DataFrame, reference: str) -> DataFrame:
    """Symbols of the reference timeframe that another timeframe lacks."""
    tfs = [r["tf"] for r in bars.where(F.col("tf") != reference).select("tf").distinct().collect()]  # a handful of timeframes
    have = bars.groupBy("symbol").agg(F.collect_set("tf").alias("have")).where(F.array_contains("have", reference))
    every = F.array(*map(F.lit, tfs)).cast("array<string>")
    return have.select(F.explode(F.array_except(every, F.col("have"))).alias("tf"), "symbol")


def verify_coverage(bars: DataFrame, target: str, share: float = 0.95) -> DataFrame:
    per = bars.groupBy("tf", "symbol").agg(F.max("ts").alias("b"))
    out = per.groupBy("tf").agg((F.count_if(F.col("b") >= F.lit(target).cast("timestamp_ntz")) / F.count("*")).alias("covered"))
    return out.withColumn("ok", F.col("covered") >= share)


def symbols_with_history(bars: DataFrame, least: int) -> DataFrame:
    return bars.groupBy("symbol", "tf").agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("v")).alias("value")).where(F.col("n") >= least)
