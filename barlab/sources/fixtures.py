"""The shapes that the operators take, bound to the test tables. Prices are whole cents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab import ship
from barlab.operators.resample import ticks_to_bars

DAY = 1440


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def running_total(df: DataFrame, keys: list[str], day, order: list[str], value, name: str) -> DataFrame:
    """Running sum of `value` by key in order, in two levels: sums by day, totals before each day, then
    within the day. So a key's long history is dealt out over its days."""
    with_day = df.withColumns({"__day": day, "__value": value})
    before = (
        with_day.groupBy(*keys, "__day")
        .agg(F.sum("__value").alias("__sum"))
        .withColumn("__base", F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("__sum")
    )
    within = Window.partitionBy(*keys, "__day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = with_day.join(before, [*keys, "__day"])
    return joined.withColumn(name, F.col("__base") + F.sum("__value").over(within)).drop("__day", "__value", "__base")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, event_id, px, qty: intraday."""
    cents = F.round(F.col("value") * 100).cast("long")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", cents.alias("cents"))
    walked = running_total(events, ["symbol"], F.to_date("ts"), ["ts", "event_id"], F.col("cents") % 41 - 20, "walk")
    return walked.select("symbol", "ts", "event_id", (F.col("walk") + 10000).alias("px"), (F.col("cents") % 500 + 1).alias("qty"))


_DAILY_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def daily_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, event_id (order within a day), px, qty: many years of days."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    step = F.round(F.col("l_extendedprice") * 100).cast("long") % 401 - 200
    some = lines.select(F.col("p_type").alias("symbol"), *_DAILY_ORDER, "l_quantity", step.alias("step"))
    walked = running_total(some, ["symbol"], F.to_date("l_shipdate"), _DAILY_ORDER[1:], F.col("step"), "walk")
    return walked.select(
        "symbol",
        F.col("l_shipdate").alias("ts"),
        F.struct(*_DAILY_ORDER[1:]).alias("event_id"),
        (F.col("walk") + 100000).alias("px"),
        (F.col("l_quantity").cast("long") * 100).alias("qty"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: symbol, tf, ts, o, h, l, c, v."""
    return ticks_to_bars(daily_ticks(spark, sf_dir), DAY).select("symbol", F.lit("1d").alias("tf"), "ts", "o", "h", "l", "c", "v")


def intraday(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    name = {5: "5min", 15: "15min", 60: "1h"}[minutes]
    return ticks_to_bars(ticks(spark, sf_dir), minutes).select("symbol", F.lit(name).alias("tf"), "ts", "o", "h", "l", "c", "v")


#: Columns that order the trades of one id.
TRADE_TIES = ("l_partkey", "l_suppkey")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades with duplicate ids; R in thousandths."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    r = ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 29) % 81 - 36) * 50
    return lines.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("p_brand").alias("pattern_name"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"),
        F.when(F.col("l_linenumber") % 2 == 0, "long").otherwise("short").alias("bias"),
        r.alias("r_milli"),
        F.when(r >= 1500, "win").when(r > 0, "partial_win").when(r == 0, "timeout").otherwise("loss").alias("outcome"),
        F.col("l_shipdate").alias("closed_at"),
        (F.col("l_shipdate") - F.make_dt_interval(hours=F.col("l_quantity").cast("int"))).alias("entered_at"),
        (F.col("l_shipdate") - F.make_dt_interval(hours=F.col("l_quantity").cast("int") + 1)).alias("detected_at"),
        (F.col("l_orderkey") % 4).alias("regime"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("src_rank"),
        "l_partkey",
        "l_suppkey",
    )


def signals(bars: DataFrame, every: int = 6) -> DataFrame:
    """Every sixth bar of a series: entry at the close, stop and targets 300 and 600 cents away."""
    k = F.row_number().over(Window.partitionBy("symbol", "tf").orderBy("ts")) - 1
    long = F.col("k") % 2 == 0
    sign = F.when(long, 1).otherwise(-1)
    return (
        bars.withColumn("k", k)
        .where(F.col("k") % every == 0)
        .select(
            "symbol", "tf", "k", F.when(long, "long").otherwise("short").alias("bias"), F.col("c").alias("entry"),
            (F.col("c") - sign * 300).alias("stop"), (F.col("c") + sign * 300).alias("t1"), (F.col("c") + sign * 600).alias("t2"),
        )
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """headline, text, source, published, symbol, provider, tickers, sentiment."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    name = lambda c: F.concat(F.lit("S"), (c % 50).cast("string"))
    i = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.element_at(F.split("text", "\n"), 1).alias("headline"),
        "text",
        "source",
        F.expr("timestampadd(MINUTE, doc_id * 7, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("published"),
        name(i).alias("symbol"),
        F.col("lang").alias("provider"),
        F.array_distinct(F.array(name(i), name(i * 3), name(i * 7))).alias("tickers"),
        F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("sentiment"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, px (cents), volume."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    sold = lines.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    letters = F.translate(F.col("p_partkey").cast("string"), "0123456789", "ABCDEFGHIJ")
    return part.join(sold, F.col("p_partkey") == F.col("l_partkey")).select(
        letters.alias("symbol"), F.round(F.col("p_retailprice") * 100).cast("long").alias("px"), (F.col("q") * 2000).alias("volume")
    )
