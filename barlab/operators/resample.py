"""Bars from ticks and from shorter bars. All are one hash aggregation with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(ts: str, minutes: int) -> Column:
    """Start of the bucket of `minutes` within the day; a wall-clock timestamp stays one."""
    return F.expr(
        f"timestampadd(MINUTE, CAST(floor((hour({ts}) * 60 + minute({ts})) / {minutes}) * {minutes} AS INT), CAST(to_date({ts}) AS TIMESTAMP_NTZ))"
    )


def ticks_to_bars(ticks: DataFrame, minutes: int) -> DataFrame:
    """symbol, ts, o, h, l, c, v, vwap, n from (symbol, ts, event_id, px, qty)."""
    order = F.struct("ts", "event_id")
    return (
        ticks.groupBy("symbol", bucket("ts", minutes).alias("bucket"))
        .agg(
            F.min_by("px", order).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", order).alias("c"),
            F.sum("qty").alias("v"), (F.sum(F.col("px") * F.col("qty")) / F.sum("qty")).alias("vwap"), F.count("*").alias("n"),
        )
        .withColumnRenamed("bucket", "ts")
    )


def resample_ohlcv(bars: DataFrame, minutes: int) -> DataFrame:
    """Longer bars from bars whose `ts` are unique within a symbol."""
    return (
        bars.groupBy("symbol", bucket("ts", minutes).alias("bucket"))
        .agg(F.min_by("o", "ts").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "ts").alias("c"), F.sum("v").alias("v"))
        .withColumnRenamed("bucket", "ts")
    )


def multi_tf_bars(ticks: DataFrame, minutes: tuple[int, ...] = (5, 15, 60, 1440)) -> DataFrame:
    """All timeframes: the shortest from ticks, each longer one from the one before, so ticks shuffle once."""
    short = ticks_to_bars(ticks, minutes[0]).select("symbol", "ts", "o", "h", "l", "c", "v")
    out = short.withColumn("minutes", F.lit(minutes[0]))
    for m in minutes[1:]:
        short = resample_ohlcv(short, m)
        out = out.unionByName(short.withColumn("minutes", F.lit(m)))
    return out


def daily_range(bars: DataFrame) -> DataFrame:
    """Session high, low and range."""
    return bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max("h").alias("high"), F.min("l").alias("low")).withColumn("range", F.col("high") - F.col("low"))


def weekly_close(bars: DataFrame) -> DataFrame:
    """Last close of each ISO week."""
    return bars.groupBy("symbol", F.extract(F.lit("YEAROFWEEK"), "ts").cast("long").alias("year"), F.weekofyear("ts").cast("long").alias("week")).agg(F.max_by("c", "ts").alias("close"))


def store_stats(bars: DataFrame) -> DataFrame:
    """Symbols, bars, oldest and newest by timeframe, with a total row (tf null)."""
    by_symbol = bars.groupBy("tf", "symbol").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return by_symbol.rollup("tf").agg(F.count_distinct("symbol").alias("symbols"), F.sum("n").alias("bars"), F.min("a").alias("oldest"), F.max("b").alias("newest"))


def bar_count(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "tf").agg(F.count("*").alias("bars"))


def with_index(bars: DataFrame) -> DataFrame:
    """Bar number k in its series, from 0."""
    return bars.withColumn("k", F.row_number().over(Window.partitionBy("symbol", "tf").orderBy("ts")) - 1)
