"""A and C: bars, their stores, and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.operators import resample
from barlab.queries.sql import CLOSED, DAILY, FIVE, HOURLY, TICKS, bars_of
from barlab.sources import bars as store
from barlab.sources import fixtures

BAR = ["symbol", "ts", "o", "h", "l", "c", "v"]


def resample_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample_ohlcv(fixtures.intraday(spark, sf_dir, 5), 60).select(*BAR)


def ticks_to_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.ticks_to_bars(fixtures.ticks(spark, sf_dir), 5).select(*BAR, F.round("vwap", 6).alias("vwap"), "n")


def multi_tf_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.multi_tf_bars(fixtures.ticks(spark, sf_dir)).select(F.col("minutes").cast("long").alias("minutes"), *BAR)


def upsert_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored bars are all but the last day; the new ones overlap them with other closes."""
    bars = fixtures.intraday(spark, sf_dir)
    stored = bars.where("ts < TIMESTAMP_NTZ'2024-01-20 00:00:00'")
    fresh = bars.where("ts >= TIMESTAMP_NTZ'2024-01-15 00:00:00'").withColumn("c", F.col("c") + 1)
    return store.upsert_bars(stored, fresh).select(*BAR)


def bars_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = fixtures.intraday(spark, sf_dir)
    return store.bars_since(bars.where("hour(ts) < 12 AND ts < TIMESTAMP_NTZ'2024-01-20 00:00:00'"), bars).select(*BAR)


def utc_to_session_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.ticks(spark, sf_dir).select("symbol", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "px")
    return store.utc_to_session(raw).select("symbol", "event_id", "ts", "px")


def chart_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.chart_export(fixtures.daily(spark, sf_dir))


def read_bars_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as one JSON document for each series and read back."""
    return store.json_round_trip(fixtures.daily(spark, sf_dir)).select(*BAR)


def write_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as Parquet by timeframe and date, twice, and read back with a date filter that prunes."""
    bars = fixtures.intraday(spark, sf_dir)
    folder = store.scratch_folder(spark)
    store.write_bars(bars, folder)
    store.write_bars(bars.where("to_date(ts) = DATE'2024-01-10'"), folder)
    return store.read_bars(spark, folder, until="2024-01-15").select(*BAR)


def extend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of the bars up to the 12th extended by all others up to the 25th, twice; the second run adds nothing."""
    bars = fixtures.intraday(spark, sf_dir)
    folder = store.scratch_folder(spark)
    store.write_bars(bars.where("to_date(ts) <= DATE'2024-01-12'"), folder)
    for _ in range(2):
        store.extend_series(folder, bars, "2024-01-25")
    return store.read_bars(spark, folder).select(*BAR)


def history_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = fixtures.trades(spark, sf_dir)
    return store.history_union(trades, fixtures.TRADE_TIES).select("id", "pattern_name", "symbol", "r_milli", "closed_at")


def partition_closed_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All closed trades archived by day, read back for a range of days that prunes the rest."""
    folder = store.scratch_folder(spark)
    store.archive_closed(store.history_union(fixtures.trades(spark, sf_dir), fixtures.TRADE_TIES), folder)
    return spark.read.parquet(folder).where("closed_date between DATE'1995-01-01' and DATE'1996-12-31'").groupBy("closed_date").agg(F.count("*").alias("n"), F.sum("r_milli").alias("r_milli"))


def daily_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.daily_range(fixtures.intraday(spark, sf_dir))


def weekly_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.weekly_close(fixtures.daily(spark, sf_dir))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.store_stats(fixtures.daily(spark, sf_dir).unionByName(fixtures.intraday(spark, sf_dir)))


def bar_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bar_count(fixtures.daily(spark, sf_dir).unionByName(fixtures.intraday(spark, sf_dir)))


def rth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.regular_hours(fixtures.ticks(spark, sf_dir)).select("symbol", "ts", "event_id", "px")


def market_hours_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed interval on text timestamps; a text that is no timestamp stays."""
    text = F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return store.market_hours(fixtures.ticks(spark, sf_dir).withColumn("at", text), "at").select("event_id", "at")


def today_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.today_or_late_yesterday(fixtures.ticks(spark, sf_dir), "2024-01-17").select("event_id", "ts")


def available_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.intraday(spark, sf_dir).where("symbol = 'view'").select(F.to_date("ts").alias("day")).distinct()


def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.point_in_time(fixtures.daily(spark, sf_dir), "1995-06-15").select(*BAR)


QUERIES = {
    f.__name__: f
    for f in (
        resample_ohlcv, ticks_to_bars, multi_tf_bars, upsert_bars, bars_since, utc_to_session_ts, chart_export, read_bars_json, write_bars, extend_series, history_union,
        partition_closed_by_day, daily_range, weekly_close, store_stats, bar_count, rth_filter, market_hours_filter, today_filter, available_dates, point_in_time,
    )
}

_B = "symbol, ts, o, h, l, c, v"
ORACLE_SQL = {
    "resample_ohlcv": f"WITH {HOURLY} SELECT {_B} FROM hourly",
    "ticks_to_bars": f"WITH {FIVE} SELECT {_B}, round(vwap, 6) AS vwap, n FROM five",
    "multi_tf_bars": f"WITH {TICKS}, " + ", ".join(bars_of("ticks", m, f"b{m}") for m in (5, 15, 60, 1440)) + " " + " UNION ALL ".join(f"SELECT {m}::BIGINT AS minutes, {_B} FROM b{m}" for m in (5, 15, 60, 1440)),
    "upsert_bars": f"""WITH {HOURLY}, both_ AS (SELECT {_B}, 0 AS src FROM hourly WHERE ts < '2024-01-20' UNION ALL SELECT symbol, ts, o, h, l, c + 1 AS c, v, 1 FROM hourly WHERE ts >= '2024-01-15'),
      one AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY src) AS a FROM both_), last AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS b FROM one WHERE a = 1) SELECT {_B} FROM last WHERE b <= 210""",
    "bars_since": f"WITH {HOURLY}, seen AS (SELECT symbol, max(ts) AS top FROM hourly WHERE hour(ts) < 12 AND ts < '2024-01-20' GROUP BY 1) SELECT {_B} FROM hourly LEFT JOIN seen USING (symbol) WHERE top IS NULL OR ts > top",
    "utc_to_session_ts": f"WITH {TICKS}, t AS (SELECT symbol, event_id, timezone('America/New_York', timezone('UTC', date_trunc('millisecond', ts))) AS ts, px FROM ticks) SELECT * FROM t WHERE hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 960",
    "chart_export": f"WITH {DAILY} SELECT symbol, epoch(ts)::BIGINT AS time, o, h, l, c, v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM daily) WHERE r <= 120",
    "read_bars_json": f"WITH {DAILY} SELECT {_B} FROM daily",
    "write_bars": f"WITH {HOURLY} SELECT {_B} FROM hourly WHERE ts < '2024-01-16'",
    "extend_series": f"WITH {HOURLY} SELECT {_B} FROM hourly WHERE ts < '2024-01-13' OR (ts < '2024-01-26' AND hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 960)",
    "history_union": f"WITH {CLOSED} SELECT id, pattern_name, symbol, r_milli, closed_at FROM closed",
    "partition_closed_by_day": f"WITH {CLOSED} SELECT closed_at::DATE AS closed_date, count(*) AS n, sum(r_milli)::BIGINT AS r_milli FROM closed WHERE closed_at::DATE BETWEEN '1995-01-01' AND '1996-12-31' GROUP BY 1",
    "daily_range": f'WITH {HOURLY} SELECT symbol, ts::DATE AS day, max(h) AS high, min(l) AS low, max(h) - min(l) AS "range" FROM hourly GROUP BY ALL',
    "weekly_close": f"WITH {DAILY} SELECT symbol, isoyear(ts)::BIGINT AS year, week(ts)::BIGINT AS week, arg_max(c, ts) AS close FROM daily GROUP BY ALL",
    "store_stats": f"WITH {DAILY}, {HOURLY}, b AS (SELECT '1d' AS tf, * FROM daily UNION ALL SELECT '1h', * FROM hourly) SELECT tf, count(DISTINCT symbol) AS symbols, count(*) AS bars, min(ts) AS oldest, max(ts) AS newest FROM b GROUP BY ROLLUP (tf)",
    "bar_count": f"WITH {DAILY}, {HOURLY} SELECT symbol, '1d' AS tf, count(*) AS bars FROM daily GROUP BY ALL UNION ALL SELECT symbol, '1h', count(*) FROM hourly GROUP BY ALL",
    "rth_filter": f"WITH {TICKS} SELECT symbol, ts, event_id, px FROM ticks WHERE hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 960",
    "market_hours_filter": f"WITH {TICKS} SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS \"at\" FROM ticks WHERE event_id % 97 = 0 OR hour(ts) * 60 + minute(ts) BETWEEN 570 AND 960",
    "today_filter": f"WITH {TICKS} SELECT event_id, ts FROM ticks WHERE ts::DATE = '2024-01-17' OR (ts::DATE = '2024-01-16' AND hour(ts) * 60 + minute(ts) >= 930)",
    "available_dates": f"WITH {HOURLY} SELECT DISTINCT ts::DATE AS day FROM hourly WHERE symbol = 'view'",
    "point_in_time": f"WITH {DAILY} SELECT {_B} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM daily WHERE ts <= '1995-06-15') WHERE r = 1",
}
