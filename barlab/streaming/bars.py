"""The operators on Structured Streaming. Wall-clock times become instants at the head of each stream,
since watermarks need them; the session's time zone is UTC. Sinks are tables in the shared folder."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barlab.operators.outcomes import eod_close
from barlab.sources.bars import scratch_folder

LATE = "10 minutes"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files: int = 64) -> DataFrame:
    """A test table as a stream of its file, or of its files where the table is a folder. A pattern finds both; a plain path would have to be a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def ticks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (instant), event_id, px (cents), qty: the raw value stands for the price, since a walk has no end state here."""
    cents = F.round(F.col("value") * 100).cast("long")
    events = stream_table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (cents % 2000 + 9000).alias("px"), (cents % 500 + 1).alias("qty"))


def tick_bars(ticks: DataFrame, minutes: int = 5) -> DataFrame:
    """Tumbling bars with a watermark."""
    order = F.struct("ts", "event_id")
    windowed = ticks.withWatermark("ts", LATE).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "symbol")
    out = windowed.agg(F.min_by("px", order).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", order).alias("c"), F.sum("qty").alias("v"))
    return out.select("symbol", F.col("w.start").alias("ts"), "o", "h", "l", "c", "v")


def dedup_bars(bars: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """The first version of each bar; later ones within the watermark are dropped. `keys` tell one bar from another; ticks need more than their time."""
    return bars.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(list(keys))


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run what there is to its end and read the result."""
    spark = stream.sparkSession
    out, state = scratch_folder(spark), scratch_folder(spark)
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number:06d}")
        done.append(number)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if not done:  # nothing came
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/{done[-1]:06d}")


METRICS = "pattern string, n long, wins long, total long, win_rate double, expectancy double, profit_factor double, streak long"


def _metrics(rs: list[int]) -> tuple:
    """n, wins, sum of R, win rate, expectancy, profit factor (null without losses) and the signed run at the end."""
    gained, lost = sum(x for x in rs if x > 0), -sum(x for x in rs if x <= 0)
    won = [x > 0 for x in rs]
    run = next((i for i, w in enumerate(reversed(won)) if w != won[-1]), len(won))
    factor = round(gained / lost, 6) if gained and lost else None
    return len(rs), sum(won), gained - lost, round(sum(won) / len(rs), 6), round((gained - lost) / len(rs), 6), factor, run if won[-1] else -run


def running_metrics(outcomes: DataFrame, last: int = 60) -> DataFrame:
    """Metrics of each pattern's last outcomes, kept in a bounded list per pattern; those of a batch go by time, then by R."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, new = list(state.get[0]) if state.exists else [], []
        for frame in frames:  # of a batch no more than the last ones are kept, however many come
            new = sorted([*new, *zip(frame["at"], frame["r_milli"].astype(int))])[-last:]
        held = (held + [r for _, r in new])[-last:]
        state.update((held,))
        yield pd.DataFrame([(key[0], *_metrics(held))], columns=[x.split()[0] for x in METRICS.split(", ")])

    return outcomes.groupBy("pattern").applyInPandasWithState(run, METRICS, "held array<long>", "update", GroupStateTimeout.NoTimeout)


def refresh_prices(ticks: DataFrame, trades: DataFrame) -> DataFrame:
    """Last price by symbol, joined to a static table of open trades."""
    last = ticks.groupBy("symbol").agg(F.max_by("px", F.struct("ts", "event_id")).alias("last"))
    return last.join(trades.hint("merge"), "symbol")


def freshness(ticks: DataFrame, as_of: str) -> DataFrame:
    newest = ticks.groupBy("symbol").agg(F.max("ts").alias("newest"))
    return newest.withColumn("age_minutes", F.timestamp_diff("MINUTE", F.col("newest"), F.lit(as_of).cast("timestamp")))


class Freshness(StreamingQueryListener):
    """Keeps, by query, when its last batch ended, how many rows that had, and how far its watermark had come; `table` shows it with each query's lag.

    Register it with spark.streams.addListener. It holds one row for each query.
    """

    def __init__(self):
        self._seen: dict[str, tuple] = {}
        self._lock = threading.Lock()

    def _note(self, key: str, name: str | None, state: str, at: datetime, batch: int = -1, rows: int = 0, watermark: str | None = None) -> None:
        with self._lock:
            old = self._seen.get(key)
            # a batch without rows keeps the time of the last one that had some
            newest = at if rows or not old else old[4]
            last = (max(batch, old[3]), newest, rows or old[5], watermark or old[6]) if old else (batch, newest, rows, watermark)
            self._seen[key] = (key, name, state, *last)

    def onQueryStarted(self, event) -> None:
        self._note(str(event.id), event.name, "running", _instant(event.timestamp))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._note(str(p.id), p.name, "running", _instant(p.timestamp), p.batchId, p.numInputRows, (p.eventTime or {}).get("watermark"))

    def onQueryIdle(self, event) -> None:
        self._note(str(event.id), self._seen.get(str(event.id), (None, None))[1], "idle", _instant(event.timestamp))

    def onQueryTerminated(self, event) -> None:
        self._note(str(event.id), self._seen.get(str(event.id), (None, None))[1], "failed" if event.exception else "ended", datetime.now(timezone.utc))

    def table(self, spark: SparkSession, as_of: datetime, stale_after: float) -> DataFrame:
        """query_id, name, state, batch, rows, newest, lag_seconds, stale of all queries seen; `as_of` is an instant in UTC."""
        with self._lock:
            rows = [(k, n, s, b, r, t.replace(tzinfo=None), w, (as_of - t).total_seconds()) for k, n, s, b, t, r, w in self._seen.values()]
        out = spark.createDataFrame(rows, "query_id string, name string, state string, batch long, rows long, newest timestamp_ntz, watermark string, lag_seconds double")
        return out.withColumn("stale", (F.col("state") != "ended") & (F.col("lag_seconds") > stale_after))


def _instant(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


#: Kinds of alerts and the events of a setup that each is sent for.
ALERT_KINDS = {"new_setup": ("OPENED",), "entry": ("ACTIVE",), "target": ("AT_T1", "AT_T2"), "stop": ("STOPPED", "EXPIRED"), "day_end": ("CLOSED", "OVERNIGHT")}


def trade_alerts(events: DataFrame, enabled: dict[str, bool]) -> DataFrame:
    """id, kind, alert of a tracker's events whose kind is not switched off; kinds that `enabled` does not name are on."""
    kind = F.coalesce(*(F.when(F.col("status").isin(*states), name) for name, states in ALERT_KINDS.items()))
    on = [name for name in ALERT_KINDS if enabled.get(name, True)]
    side = F.when(F.col("bias") > 0, "long").otherwise("short")
    text = F.format_string("%s %s %s %s %+.2fR", "symbol", F.coalesce("pattern", F.lit("setup")), side, "status", F.col("r_milli") / 1000.0)
    return events.withColumn("kind", kind).where(F.col("kind").isin(*on)).select(F.concat_ws("-", "symbol", F.col("setup_id").cast("string"), "status").alias("id"), "kind", "at", text.alias("alert"))


def event_summary(events: DataFrame) -> DataFrame:
    """By day and timeframe of a tracker's events: setups opened, ended, winners, losers, even, targets, held overnight, and R of the ended ones."""
    status, r = F.col("status"), F.col("r_milli")
    ended = status.isin("EXPIRED", "STOPPED", "AT_T2", "CLOSED")
    count = lambda when: F.count_if(when)
    return events.groupBy(F.to_date("at").alias("day"), "tf").agg(
        count(status == "OPENED").alias("opened"), count(ended).alias("ended"), count(ended & (r > 0)).alias("winners"), count(ended & (r < 0)).alias("losers"),
        count((status == "STOPPED") & (r == 0)).alias("even"), count(status == "AT_T1").alias("first_targets"), count(status == "AT_T2").alias("second_targets"),
        count(status == "OVERNIGHT").alias("overnight"), F.coalesce(F.sum(F.when(ended, r)), F.lit(0)).alias("total_r_milli"),
    )


def alerts(scored: DataFrame, least: float) -> DataFrame:
    """Text of the rows worth an alert; delivery is the sink's matter."""
    return scored.where(F.col("score") >= least).select("id", F.format_string("%s scored %.2f", "id", "score").alias("alert"))


def news_windows(news: DataFrame, minutes: int = 10) -> DataFrame:
    return news.withWatermark("published", LATE).groupBy(F.window("published", f"{minutes} minutes").alias("w"), "symbol").agg(F.count("*").alias("n")).select("symbol", F.col("w.start").alias("start"), "n")


def in_play(news: DataFrame, minutes: int = 30) -> DataFrame:
    """By window of `minutes`: the symbols that made news in it, in order, and how much; a list is fresh until its window ends."""
    windowed = news.withWatermark("published", LATE).groupBy(F.window("published", f"{minutes} minutes").alias("w"))
    listed = windowed.agg(F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"), F.count("*").alias("n"))
    return listed.select(F.col("w.start").alias("start"), F.col("w.end").alias("fresh_until"), "symbols", "n")


def end_of_day(ticks: DataFrame, trades: DataFrame, minute: int = 990) -> DataFrame:
    """Open trades (symbol, day, bias, entry, stop, t1, ...) at each day's close: closed at the day's last price up to `minute`, or kept
    overnight where most of the way to the next target is done. A day is one event-time window, final once the watermark has passed it."""
    open_hours = ticks.withWatermark("ts", LATE).where(F.hour("ts") * 60 + F.minute("ts") < minute)
    last = open_hours.groupBy(F.window("ts", "1 day").alias("w"), "symbol").agg(F.max_by("px", F.struct("ts", "event_id")).alias("last"))
    closing = last.select("symbol", F.to_date(F.col("w.start")).alias("day"), "last")
    return eod_close(closing.join(trades.hint("merge"), ["symbol", "day"])).withColumn("overnight", F.col("action") == "gap_risk")


def day_summary(ended: DataFrame) -> DataFrame:
    """By day: trades, those closed, winners, losers, those kept overnight, and the sum of R."""
    return ended.groupBy("day").agg(
        F.count("*").alias("trades"), F.count_if(F.col("action") == "closed").alias("closed"), F.count_if(F.col("r") > 0).alias("winners"), F.count_if(F.col("r") < 0).alias("losers"),
        F.count_if("overnight").alias("overnight"), F.round(F.sum("r"), 6).alias("total_r"),
    )


def detect_each_batch(ticks: DataFrame, minutes: int, detect, out: str, state: str, look_back_days: int = 60) -> None:
    """After each batch: add its bars to a store, and append what `detect` finds at bars that the batch touched.

    The store has the batches' bars by day, with what it takes to merge the parts of one bar; a batch reads the days that the
    detector looks back from its first tick, not the whole history. A batch that is run again replaces its own folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = F.struct("ts", "event_id")
        parts = batch.groupBy("symbol", F.window("ts", f"{minutes} minutes")["start"].cast("timestamp_ntz").alias("start")).agg(
            F.min_by("px", at).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", at).alias("c"), F.sum("qty").alias("v"), F.min(at).alias("first_at"), F.max(at).alias("last_at")
        )
        parts.withColumn("day", F.to_date("start")).write.mode("overwrite").partitionBy("day").parquet(f"{out}/bars/batch={number:06d}")
        mine = spark.read.parquet(f"{out}/bars/batch={number:06d}")
        begin = mine.agg(F.date_sub(F.min("day"), look_back_days).alias("d")).first()["d"]
        if begin is None:
            return
        seen = spark.read.parquet(f"{out}/bars").where((F.col("day") >= F.lit(begin)) & (F.col("batch") <= number))
        since = mine.groupBy("symbol").agg(F.min("start").alias("since"))
        history = seen.join(since.select("symbol").hint("merge"), "symbol", "left_semi")
        bars = history.groupBy("symbol", F.col("start").alias("ts")).agg(F.min_by("o", "first_at").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "last_at").alias("c"), F.sum("v").alias("v"))
        bars = bars.select("symbol", F.lit(f"{minutes}min").alias("tf"), "ts", "o", "h", "l", "c", "v")
        found = detect(bars).join(since.hint("merge"), "symbol").where(F.col("ts") >= F.col("since")).drop("since")
        found.write.mode("overwrite").parquet(f"{out}/signals/batch={number:06d}")

    ticks.writeStream.foreachBatch(run).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
