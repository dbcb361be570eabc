"""From signals to outcomes: barrier joins, slippage, final R, and which candidates are taken. Prices in cents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions import folds
from barlab.functions import indicators as I

#: Minutes of a bar, bars between scans, and bars of warm-up by timeframe.
BAR_MINUTES = {"5min": 5, "15min": 15, "1h": 60, "1d": 390}
SCAN_EVERY = {"5min": 6, "15min": 4, "1h": 2, "1d": 1}
SCAN_EVERY_LONG = {"5min": 12, "15min": 6, "1h": 2, "1d": 1}
WARM_UP = {"5min": 60, "15min": 40, "1h": 20, "1d": 60}
DEFAULT_COOLDOWN, DEFAULT_HOLD = 120, 600
COST, R_CAP = 0.02, 10.0


def by_tf(values: dict[str, int], tf: str = "tf") -> Column:
    return F.coalesce(*(F.when(F.col(tf) == k, v) for k, v in values.items()))


def scan_schedule(bars: DataFrame, days: int = 30) -> DataFrame:
    """The bars (with number k) that a scan evaluates: every s-th one after warm-up, of series with ten bars more."""
    every = by_tf(SCAN_EVERY_LONG if days >= 60 else SCAN_EVERY)
    n = F.count("*").over(Window.partitionBy("symbol", "tf"))
    return bars.withColumn("n", n).where((F.col("n") >= by_tf(WARM_UP) + 10) & (F.col("k") >= by_tf(WARM_UP)) & ((F.col("k") - by_tf(WARM_UP)) % every == 0)).drop("n")


def bars_for(minutes: Column) -> Column:
    """Bars that a time span takes, one at least."""
    return F.greatest(F.lit(1), F.floor(minutes / by_tf(BAR_MINUTES))).cast("long")


def apply_slippage(signals: DataFrame, share: float = 0.05) -> DataFrame:
    """Entry moved against the trade by a share of the ATR; risk measured anew; targets stay."""
    sign = F.when(F.col("bias") == "long", 1).otherwise(-1)
    return signals.withColumn("entry", F.col("entry") + sign * share * F.col("atr")).withColumn("risk", F.abs(F.col("entry") - F.col("stop")))


def with_window_atr(bars: DataFrame) -> DataFrame:
    """Bars with `window_atr`, the ATR that starts anew on the last 20 bars; 0 where there are too few."""
    ranged = bars.withColumns({"__tr": I.true_range().cast("double"), "__hl": (F.col("h") - F.col("l")).cast("double")})
    last = F.transform(F.collect_list(F.struct("__tr", "__hl")).over(I.frame(-19)), lambda x, i: F.when(i == 0, x["__hl"]).otherwise(x["__tr"]))
    listed = ranged.withColumn("__list", last)
    return listed.withColumn("window_atr", F.coalesce(folds.windowed_atr(F.col("__list")), F.lit(0.0))).drop("__tr", "__hl", "__list")


def _touched(side: Column, price: str, against: bool) -> Column:
    """Whether a bar reaches a price on the losing or the winning side."""
    low, high = F.col("b.l") <= F.col(price), F.col("b.h") >= F.col(price)
    return F.when(side, low if against else high).otherwise(high if against else low)


def _following(signals: DataFrame, bars: DataFrame, hold: int | Column) -> DataFrame:
    """Signals with the bars after them up to `hold`: an equi join on the series and a bucket of bar numbers.

    A signal goes to the buckets that its span of bars touches, so no bar meets a signal far from it.
    """
    width = 128
    hold = F.lit(hold) if isinstance(hold, int) else hold
    spans = signals.withColumn("hold", hold).withColumn("__span", F.explode(F.sequence(F.floor((F.col("k") + 1) / width), F.floor((F.col("k") + F.col("hold")) / width))))
    right = bars.select("symbol", "tf", F.col("k").alias("bk"), "h", "l", "c", F.floor(F.col("k") / width).alias("__span")).alias("b")
    joined = spans.alias("s").join(right.hint("merge"), ["symbol", "tf", "__span"])
    return joined.where((F.col("bk") > F.col("k")) & (F.col("bk") <= F.col("k") + F.col("hold")))


def first_touch_label(signals: DataFrame, bars: DataFrame, hold: int = 99) -> DataFrame:
    """Target or stop, whichever comes first within `hold` bars; the stop on a tie. R is the reward or -1."""
    long = F.col("bias") == "long"
    met = _following(signals, bars, hold)
    key = ["symbol", "tf", "k", "bias", "entry", "stop", "t2"]
    first = met.groupBy(*key).agg(F.min(F.when(_touched(long, "stop", True), F.col("bk"))).alias("k_stop"), F.min(F.when(_touched(long, "t2", False), F.col("bk"))).alias("k_target"))
    hit = F.col("k_target").isNotNull() & (F.col("k_stop").isNull() | (F.col("k_target") < F.col("k_stop")))
    reward = F.abs(F.col("t2") - F.col("entry")) / F.abs(F.col("entry") - F.col("stop"))
    label = F.when(hit, "win").when(F.col("k_stop").isNotNull(), "loss").otherwise("open")
    return first.withColumn("label", label).withColumn("r", F.when(label == "win", reward).when(label == "loss", -1.0))


def barrier_resolve(signals: DataFrame, bars: DataFrame, hold: int | Column, splits: tuple[float, float, float] | str = (0.5, 0.3, 0.2), keep: tuple[str, ...] = ()) -> DataFrame:
    """Exits of each signal in two phases.

    First the stop and the first target race, the stop winning ties. After the target the stop stands at the entry,
    from the next bar on, and races the second target, which can be hit on the bar of the first. What is left runs
    to the entry or to the close of the last bar in the span. Legs are rounded to 3 places and weighted. `splits` are the
    weights, or the array column that has them; `keep` names more columns of the signals that the result has.
    """
    long = F.col("bias") == "long"
    key = ["symbol", "tf", "k", "bias", "entry", "stop", "t1", "t2", "hold", *keep, *([splits] if isinstance(splits, str) else [])]
    met = _following(signals, bars, hold)
    first = met.groupBy(*key).agg(
        F.min(F.when(_touched(long, "stop", True), F.col("bk"))).alias("k_stop"), F.min(F.when(_touched(long, "t1", False), F.col("bk"))).alias("k_t1"),
        F.max("bk").alias("k_last"), F.max_by("c", "bk").alias("c_last"),
        F.array_sort(F.collect_list(F.when(_touched(long, "entry", True), F.col("bk")))).alias("back"),
        F.array_sort(F.collect_list(F.when(_touched(long, "t2", False), F.col("bk")))).alias("far"),
    )
    got1 = F.col("k_t1").isNotNull() & (F.col("k_stop").isNull() | (F.col("k_t1") < F.col("k_stop")))
    later = lambda name, test: F.get(F.filter(name, test), 0)
    second = first.withColumns(
        {"got1": got1, "k_back": later("back", lambda x: x > F.col("k_t1")), "k_far": later("far", lambda x: x >= F.col("k_t1"))}
    )
    got2 = F.col("got1") & F.col("k_far").isNotNull() & (F.col("k_back").isNull() | (F.col("k_far") < F.col("k_back")))
    risk = F.abs(F.col("entry") - F.col("stop"))
    leg = lambda price: F.round(F.when(long, price - F.col("entry")).otherwise(F.col("entry") - price) / risk, 3)
    a, b, c = (F.col(splits)[i] for i in range(3)) if isinstance(splits, str) else map(F.lit, splits)
    done = b + a >= 0.99
    rest = F.when(F.col("k_back").isNotNull(), F.lit(0.0)).otherwise(leg(F.col("c_last")))
    raw = (
        F.when(F.col("got1") & F.col("got2"), a * leg(F.col("t1")) + b * leg(F.col("t2")) + F.when(done, 0.0).otherwise(c * rest))
        .when(F.col("got1"), a * leg(F.col("t1")) + (b + c) * rest)
        .when(F.col("k_stop").isNotNull(), leg(F.col("stop")))
        .otherwise(leg(F.col("c_last")))
    )
    ended = (
        F.when(F.col("got1") & F.col("got2") & done, F.col("k_far"))
        .when(F.col("got1"), F.coalesce("k_back", "k_last"))
        .otherwise(F.coalesce("k_stop", "k_last"))
    )
    out = second.withColumn("got2", got2).withColumns({"raw_r": raw, "k_exit": ended})
    return out.drop("back", "far", "k_last", "c_last", "k_back", "k_far")


def finalize_r(resolved: DataFrame) -> DataFrame:
    """R clipped, less costs, and the outcome's name."""
    r = F.round(F.greatest(F.lit(-R_CAP), F.least(F.lit(R_CAP), F.col("raw_r"))) - COST, 3)
    outcome = F.when(F.col("got1") & F.col("got2"), "win").when(F.col("got1"), "partial_win").when(F.col("k_stop").isNull() & (r > 0), "timeout").otherwise("loss")
    return resolved.withColumn("r", r).withColumn("outcome", outcome)


def select_non_overlapping(candidates: DataFrame, cooldown: str = "cooldown", by: str = "pattern") -> DataFrame:
    """Candidates that a trader with one open trade per pattern takes, in bar order, best confidence first.

    Exits are known for all candidates, so only this short fold over the candidates of a (series, pattern) is
    sequential. A trade that closes on bar i frees bar i; only taken trades start a cooldown.
    """
    schema = candidates.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "confidence", "bias", "bucket"], ascending=[True, False, True, True], kind="stable")
        open_until, fired, keep = -1, {}, []
        for k, bias, bucket, exit_, wait in zip(pdf["k"], pdf["bias"], pdf["bucket"], pdf["k_exit"], pdf[cooldown]):
            ok = open_until <= k and k - fired.get((bias, bucket), -(10**9)) >= wait
            keep.append(ok)
            if ok:
                open_until = exit_
                fired[(bias, bucket)] = k
        return pdf[keep]

    return candidates.groupBy("symbol", "tf", by).applyInPandas(run, schema)


def next_open_entry(signals: DataFrame, bars: DataFrame, least: float = 1.5) -> DataFrame:
    """Entry at the next bar's open; none if that is beyond the stop or leaves under `least` R to the first target."""
    nxt = bars.select("symbol", "tf", (F.col("k") - 1).alias("k"), F.col("o").alias("fill"))
    joined = signals.join(nxt.hint("merge"), ["symbol", "tf", "k"])
    sign = F.when(F.col("bias") == "long", 1).otherwise(-1)
    risk, reward = sign * (F.col("fill") - F.col("stop")), sign * (F.col("t2") - F.col("fill"))
    return joined.withColumns({"risk": risk, "reward": reward}).where((F.col("risk") > 0) & (F.col("reward") >= least * F.col("risk")))


def first_detection(signals: DataFrame, since: int) -> DataFrame:
    """Earliest firing of each (symbol, bias) from bar `since` on."""
    w = Window.partitionBy("symbol", "tf", "bias").orderBy("k")
    return signals.where(F.col("k") >= since).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def recent_dedup(fresh: DataFrame, trades: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Fresh (symbol, pattern) pairs without a trade closed in the last `days`."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    recent = trades.where((F.col("closed_at") >= limit) & (F.col("closed_at") <= F.lit(as_of).cast("timestamp_ntz")))
    return fresh.join(recent, ["symbol", "pattern_name"], "left_anti")


def trade_lifecycle(signals: DataFrame, bars: DataFrame, hold: int = 60) -> DataFrame:
    """Status of each signal after the bars of its span, one transition a bar: stop first, then T1, then T2.

    After T1 the stop stands at the entry; after T2 it trails the best close by the first risk.
    """
    long = F.col("bias") == "long"
    bar = F.struct(F.col("bk"), F.col("h"), F.col("l"), F.col("c"))
    met = _following(signals, bars, hold).groupBy("symbol", "tf", "k", "bias", "entry", "stop", "t1", "t2").agg(F.array_sort(F.collect_list(bar)).alias("path"))
    risk = F.abs(F.col("entry") - F.col("stop"))

    def step(s: Column, b: Column) -> Column:
        alive = ~s["status"].isin("STOPPED", "CLOSED")
        worst, best = F.when(long, b["l"]).otherwise(-b["h"]), F.when(long, b["h"]).otherwise(-b["l"])
        sign = F.when(long, 1).otherwise(-1)
        stopped = worst <= sign * s["stop"]
        t1 = (s["status"] == "ACTIVE") & (best >= sign * F.col("t1"))
        t2 = (s["status"] == "AT_T1") & (best >= sign * F.col("t2"))
        trail = F.greatest(sign * s["stop"], sign * b["c"] - risk) * sign
        status = F.when(~alive, s["status"]).when(stopped, "STOPPED").when(t1, "AT_T1").when(t2, "TRAILING").otherwise(s["status"])
        stop = F.when(~alive | stopped, s["stop"]).when(t1, F.col("entry")).when(s["status"] == "TRAILING", trail).otherwise(s["stop"])
        at = F.when(alive & stopped, b["bk"]).otherwise(s["at"])
        peak = F.when(alive, F.greatest(s["peak"], (best - sign * F.col("entry")).cast("long"))).otherwise(s["peak"])
        return F.struct(status.alias("status"), stop.cast("long").alias("stop"), at.alias("at"), peak.alias("peak"))

    begin = F.struct(F.lit("ACTIVE").alias("status"), F.col("stop").cast("long").alias("stop"), F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("peak"))
    return met.withColumn("x", F.aggregate("path", begin, step)).select("symbol", "tf", "k", "bias", "x.status", F.col("x.stop").alias("last_stop"), F.col("x.at").alias("stopped_at"), F.col("x.peak").alias("peak"))


#: States of a tracked trade; the last three are ends.
STATES = ("PENDING", "ACTIVE", "AT_T1", "AT_T2", "TRAILING", "STOPPED", "CLOSED", "EXPIRED")


def track_trades(signals: DataFrame, bars: DataFrame, hold: int = 60) -> DataFrame:
    """Where each signal's trade stands after the closes of its span, one transition a bar, with the R that it made and saw.

    A pending trade is entered once a close reaches the entry and expires if one reaches the stop first. After the first target the stop stands
    at the entry. At the second target a trail starts `trail_by` ATRs behind the close, or at the entry where a bar has no ATR; from then on it
    only moves with the trade, and the trade is closed at the trail. Peak and trough are the best and worst R at a close, 0 at first,
    up to the one that ends the trade. signals: symbol, tf, k, bias, entry, stop, t1, t2, trail_by; bars: symbol, tf, k, c, atr.
    """
    width = 128
    spans = signals.withColumn("__span", F.explode(F.sequence(F.floor((F.col("k") + 1) / width), F.floor((F.col("k") + hold) / width))))
    right = bars.select("symbol", "tf", F.floor(F.col("k") / width).alias("__span"), F.struct(F.col("k").alias("bk"), F.col("c").cast("double").alias("c"), F.coalesce(F.col("atr").cast("double"), F.lit(0.0)).alias("atr")).alias("bar"))
    met = spans.join(right.hint("merge"), ["symbol", "tf", "__span"]).where((F.col("bar.bk") > F.col("k")) & (F.col("bar.bk") <= F.col("k") + hold))
    key = ["symbol", "tf", "k", "bias", "entry", "stop", "t1", "t2", "trail_by"]
    paths = met.groupBy(*key).agg(F.array_sort(F.collect_list("bar")).alias("path"))  # a span's bars
    sign = F.when(F.col("bias") == "long", 1.0).otherwise(-1.0)
    # prices measured in the trade's direction, so that one set of rules serves both sides
    entry, stop, t1, t2 = (sign * F.col(x) for x in ("entry", "stop", "t1", "t2"))
    risk = entry - stop
    r = lambda x: F.when(F.abs(risk) > 0, F.round((x - entry) / F.abs(risk), 3))

    def step(s: Column, b: Column) -> Column:
        price, status = sign * b["c"], s["status"]
        over = status.isin("STOPPED", "CLOSED", "EXPIRED")
        trailing = status.isin("AT_T2", "TRAILING")
        started = F.when(b["atr"] > 0, price - b["atr"] * F.col("trail_by")).otherwise(entry)
        trail = F.when(b["atr"] > 0, F.greatest(s["trail"], price - b["atr"] * F.col("trail_by"))).otherwise(s["trail"])
        closed = trailing & (b["atr"] > 0) & (price <= trail)
        now = (
            F.when(status == "PENDING", F.when(price >= entry, "ACTIVE").when(price <= stop, "EXPIRED").otherwise("PENDING"))
            .when(status == "ACTIVE", F.when(price <= stop, "STOPPED").when(price >= t1, "AT_T1").otherwise("ACTIVE"))
            .when(status == "AT_T1", F.when(price <= entry, "STOPPED").when(price >= t2, "AT_T2").otherwise("AT_T1"))
            .when(trailing, F.when(closed, "CLOSED").otherwise("TRAILING"))
            .otherwise(status)
        )
        realised = F.when(over, s["realised"]).when(closed, r(trail)).when((status == "ACTIVE") & (now == "STOPPED"), F.coalesce(r(stop), F.lit(-1.0))).when((status == "AT_T1") & (now == "STOPPED"), 0.0)
        seen = F.coalesce(r(price), F.lit(0.0))
        return F.struct(
            now.alias("status"),
            F.when(over, s["trail"]).when((status == "AT_T1") & (now == "AT_T2"), started).when(trailing, trail).alias("trail"),
            F.when(~over & now.isin("STOPPED", "CLOSED", "EXPIRED"), b["bk"]).otherwise(s["ended"]).alias("ended"),
            F.when((status == "PENDING") & (now == "ACTIVE"), b["bk"]).otherwise(s["entered"]).alias("entered"),
            realised.alias("realised"), F.when(over, s["peak"]).otherwise(F.greatest(s["peak"], seen)).alias("peak"), F.when(over, s["trough"]).otherwise(F.least(s["trough"], seen)).alias("trough"),
        )

    nothing = {"trail": "double", "ended": "bigint", "entered": "bigint", "realised": "double"}
    begin = F.struct(F.lit("PENDING").alias("status"), *(F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()), F.lit(0.0).alias("peak"), F.lit(0.0).alias("trough"))
    done = paths.withColumn("x", F.aggregate("path", begin, step))
    trail = F.when(F.col("x.trail").isNotNull(), sign * F.col("x.trail"))
    moved = (F.col("x.status") == "AT_T1") | ((F.col("x.status") == "STOPPED") & (F.col("x.realised") == 0))
    stands = F.when(moved, F.col("entry")).when(F.col("x.status").isin("AT_T2", "TRAILING", "CLOSED"), trail).otherwise(F.col("stop"))
    return done.select("symbol", "tf", "k", "bias", "x.status", stands.cast("double").alias("stop_at"), F.col("x.entered").alias("entered_at"), F.col("x.ended").alias("ended_at"), F.col("x.realised").alias("realised_r"), F.col("x.peak").alias("peak_r"), F.col("x.trough").alias("trough_r"))


def eod_close(open_trades: DataFrame) -> DataFrame:
    """Open trades at the day's end: closed at the last price unless most of the way to the next target."""
    sign = F.when(F.col("bias") == "long", 1).otherwise(-1)
    way = F.try_divide(sign * (F.col("last") - F.col("entry")), sign * (F.col("t1") - F.col("entry")))
    return open_trades.withColumn("action", F.when(way >= 0.7, "gap_risk").otherwise("closed")).withColumn("r", F.when(way < 0.7, sign * (F.col("last") - F.col("entry")) / F.abs(F.col("entry") - F.col("stop"))))


def param_sweep(signals: DataFrame, bars: DataFrame, grid: list[tuple[int, int]]) -> DataFrame:
    """Signals resolved for each (stop, target) distance of a short grid; score = expectancy * min(1, sqrt(n / 100))."""
    spark = signals.sparkSession
    cells = F.broadcast(spark.createDataFrame(grid, "stop_d long, target_d long"))  # the grid is a short list
    sign = F.when(F.col("bias") == "long", 1).otherwise(-1)
    each = signals.drop("stop", "t1", "t2").join(cells).withColumns({"stop": F.col("entry") - sign * F.col("stop_d"), "t2": F.col("entry") + sign * F.col("target_d")})
    out = first_touch_label(each, bars, 60).withColumns({"stop_d": F.abs(F.col("entry") - F.col("stop")), "target_d": F.abs(F.col("t2") - F.col("entry"))})
    stats = out.groupBy("stop_d", "target_d").agg(F.count("r").alias("n"), F.count_if(F.col("label") == "win").alias("wins"), F.sum(F.when(F.col("label") == "win", F.col("target_d") / F.col("stop_d")).when(F.col("label") == "loss", -1.0)).alias("total"))
    return stats.withColumn("score", F.col("total") / F.col("n") * F.least(F.lit(1.0), F.sqrt(F.col("n") / 100.0)))
