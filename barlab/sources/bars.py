"""Stores of bars and trades: reading, idempotent writing, merging, and clock-time filters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bars that the store keeps by timeframe.
CAPS = {"5min": 780, "15min": 260, "1h": 210, "1d": 2520}

_NUMBER = T.LongType()
JSON_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("timeframe", T.StringType()),
        T.StructField("bars", T.ArrayType(T.StructType([T.StructField("t", T.StringType()), *(T.StructField(x, _NUMBER) for x in "ohlcv")]))),
    ]
)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared place that the cluster names; where none is named, a local one in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base}/{uuid.uuid4().hex}"


def read_bars_json(spark: SparkSession, path: str) -> DataFrame:
    """One document for each series: {symbol, timeframe, bars: [{t, o, h, l, c, v}]}."""
    each = spark.read.schema(JSON_SCHEMA).json(path).select("symbol", F.col("timeframe").alias("tf"), F.explode("bars").alias("b"))
    return each.select("symbol", "tf", F.col("b.t").cast("timestamp_ntz").alias("ts"), "b.o", "b.h", "b.l", "b.c", "b.v")


def write_bars_json(bars: DataFrame, path: str) -> None:
    """A series' day is a document, so that no group holds a whole long series."""
    bar = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), "o", "h", "l", "c", "v")
    grouped = bars.groupBy("symbol", F.col("tf").alias("timeframe"), F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    grouped.drop("day").write.json(path)


def json_round_trip(bars: DataFrame) -> DataFrame:
    folder = scratch_folder(bars.sparkSession)
    write_bars_json(bars, folder)
    return read_bars_json(bars.sparkSession, folder)


def write_bars(bars: DataFrame, path: str) -> None:
    """Replace the (tf, date) partitions that `bars` has; others stay."""
    dated = bars.withColumn("date", F.to_date("ts"))
    dated.repartition("tf", "date").write.partitionBy("tf", "date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_bars(spark: SparkSession, path: str, tfs: tuple[str, ...] = (), since: str | None = None, until: str | None = None) -> DataFrame:
    """Bars of some timeframes and days (ends included), or all; only their partitions are listed and read."""
    bars = spark.read.parquet(path)
    if tfs:
        bars = bars.where(F.col("tf").isin(*tfs))
    for day, test in ((since, F.col("date") >= F.lit(since).cast("date")), (until, F.col("date") <= F.lit(until).cast("date"))):
        bars = bars.where(test) if day else bars
    return bars


def extend_series(path: str, fetched: DataFrame, until: str) -> DataFrame:
    """Append to the store at `path` what `fetched` has of its series from the day after their last bar up to `until`: (symbol, tf, added, status).

    Only series that the store has are extended, with regular hours alone but for daily bars. What is stored is neither read in whole nor written again,
    and a second run adds nothing. status: ok, or skip where nothing was added.
    """
    spark = fetched.sparkSession
    tails = materialised(spark.read.parquet(path).groupBy("symbol", "tf").agg(F.max("ts").alias("tail")))
    later = (F.to_date("ts") > F.to_date("tail")) & (F.to_date("ts") <= F.lit(until).cast("date"))
    open_ = (F.col("tf") == "1d") | ((minute_of_day() >= 570) & (minute_of_day() < 960))
    met = fetched.join(tails.hint("merge"), ["symbol", "tf"]).where(later & open_).dropDuplicates(["symbol", "tf", "ts"])
    new = materialised(met.select("symbol", "tf", "ts", "o", "h", "l", "c", "v").withColumn("date", F.to_date("ts")))
    new.repartition("tf", "date").write.partitionBy("tf", "date").mode("append").parquet(path)
    added = new.groupBy("symbol", "tf").agg(F.count("*").alias("added"))
    report = tails.select("symbol", "tf").join(added.hint("merge"), ["symbol", "tf"], "left").withColumn("added", F.coalesce("added", F.lit(0).cast("long")))
    return report.withColumn("status", F.when(F.col("added") > 0, "ok").otherwise("skip"))


def upsert_bars(stored: DataFrame, fresh: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """Stored bars win over new ones of the same time; the newest of each series stay, up to its cap."""
    both = stored.withColumn("src", F.lit(0)).unionByName(fresh.withColumn("src", F.lit(1)))
    one = both.groupBy("symbol", "tf", "ts").agg(F.min_by(F.struct(*[c for c in stored.columns if c not in ("symbol", "tf", "ts")]), "src").alias("x"))
    cap = F.coalesce(*(F.when(F.col("tf") == tf, n) for tf, n in caps.items()))
    ranked = one.select("symbol", "tf", "ts", "x.*").withColumn("r", F.row_number().over(Window.partitionBy("symbol", "tf").orderBy(F.desc("ts"))))
    return ranked.where(cap.isNull() | (F.col("r") <= cap)).drop("r")


def bars_since(stored: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of `source` after the last stored time of their series."""
    seen = stored.groupBy("symbol", "tf").agg(F.max("ts").alias("top"))
    return source.join(seen.hint("merge"), ["symbol", "tf"], "left").where(F.col("top").isNull() | (F.col("ts") > F.col("top"))).drop("top")


def minute_of_day(ts: str = "ts"):
    return F.hour(ts) * 60 + F.minute(ts)


def regular_hours(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.where((minute_of_day(ts) >= 570) & (minute_of_day(ts) < 960))


def market_hours(df: DataFrame, text: str) -> DataFrame:
    """09:30 to 16:00, ends included, of timestamps given as text; what is no timestamp stays."""
    at = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return df.where(F.coalesce((F.hour(at) * 60 + F.minute(at)).between(570, 960), F.lit(True)))


def utc_to_session(raw: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Milliseconds since the epoch to wall-clock time of the exchange, regular hours only."""
    utc = F.expr("timestampadd(MICROSECOND, ms * 1000, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return regular_hours(raw.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)))


def materialised(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back, so that several readers do not work them out again."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def chart_export(bars: DataFrame, last: int = 120) -> DataFrame:
    ranked = bars.withColumn("r", F.row_number().over(Window.partitionBy("symbol", "tf").orderBy(F.desc("ts")))).where(F.col("r") <= last)
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return ranked.select("symbol", seconds.alias("time"), "o", "h", "l", "c", "v")


def today_or_late_yesterday(df: DataFrame, as_of: str) -> DataFrame:
    today = F.lit(as_of).cast("date")
    day = F.to_date("ts")
    return df.where((day == today) | ((day == F.date_sub(today, 1)) & (minute_of_day() >= 930)))


def point_in_time(bars: DataFrame, as_of: str) -> DataFrame:
    """Each series' last bar up to a date."""
    rest = [c for c in bars.columns if c not in ("symbol", "tf")]
    seen = bars.where(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz"))
    return seen.groupBy("symbol", "tf").agg(F.max_by(F.struct(*rest), "ts").alias("x")).select("symbol", "tf", "x.*")


def history_union(trades: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row for each id, from the first of its stores, then by `ties`; a missing id is unlike any other. Only closed trades with a result."""
    order = F.struct("src_rank", *(x for x in ties if x in trades.columns), "closed_at", "r_milli")
    known = trades.where("id is not null")
    rest = [c for c in trades.columns if c != "id"]
    one = known.groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("x")).select("id", "x.*")
    return one.unionByName(trades.where("id is null").select(*one.columns)).where("closed_at is not null and r_milli is not null")


def archive_closed(closed: DataFrame, path: str) -> None:
    """Closed trades by closing day; the days given replace those of the archive, the rest stay. Rows of a day come from few files each."""
    dated = closed.withColumn("closed_date", F.to_date("closed_at"))
    dated.repartition("closed_date").write.partitionBy("closed_date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
