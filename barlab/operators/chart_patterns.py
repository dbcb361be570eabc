"""The alternative detector set: chart patterns over the last visible swings, opening ranges, news bars.

A swing is visible once its confirm bar has passed. The last three swings of each kind, with the extremes between them,
are worked out once per swing and carried forward to the bars; no bar keeps a growing list.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions import folds
from barlab.functions import indicators as I
from barlab.operators.detect import setup_gate
from barlab.operators.structures import level_starts

#: Bars on either side of a swing by timeframe, and the price tick added to entries and stops.
ORDER = {"5min": 3, "15min": 4, "1h": 3, "1d": 5}
TICK = 2
# Fixed values in the patterns below: shares of price, bar counts and confidences.
SIGNAL = ("pattern", "bias", "entry", "stop", "target", "confidence")


def _swings(marked: DataFrame, kind: str, order: int) -> DataFrame:
    """By confirm bar: the swing and the two before it (p, price), and the far side's extreme between neighbours (neck)."""
    price, far, extreme, pick = ("h", "l", F.min, F.least) if kind == "high" else ("l", "h", F.max, F.greatest)
    w = I.series()
    rows = marked.withColumn("seg", F.count_if(F.col(f"is_{kind}")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    segments = rows.groupBy("symbol", "tf", "seg").agg(extreme(far).alias("far"))
    pivots = rows.where(F.col(f"is_{kind}")).select("symbol", "tf", "seg", "ts", F.col("k").alias("p"), F.col(price).alias("price"), F.col(far).alias("own_far"), "left_rim", "next_p", "next_price")
    chain = pivots.join(segments.withColumn("seg", F.col("seg") + 1).withColumnRenamed("far", "before").hint("merge"), ["symbol", "tf", "seg"], "left").withColumn("neck", pick("before", "own_far"))
    made = {f"{x}{n}": F.lag(x, n).over(w) for x in ("p", "price") for n in (1, 2)} | {"neck1": F.lag("neck", 1).over(w)}
    chain = chain.withColumns(made)
    fields = ["p", "price", "neck", "p1", "price1", "neck1", "p2", "price2", "left_rim", "next_p", "next_price"]
    return chain.select("symbol", "tf", (F.col("p") + order).alias("k"), F.struct(*fields).alias(f"new_{kind}"))


def with_visible_swings(bars: DataFrame, order: int) -> DataFrame:
    """Bars (with k) and structs `low` and `high` of the last swings visible at each."""
    w = I.series()
    marked = bars.withColumns({"is_high": F.coalesce(I.swing_high(order), F.lit(False)), "is_low": F.coalesce(I.swing_low(order), F.lit(False))})
    # from the last bar back: a frame that only grows, where one of all later bars would be worked out anew at every bar
    after = Window.partitionBy("symbol", "tf").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = lambda flag, price: F.last(F.when(F.col(flag), F.struct(F.col("k").alias("p"), F.col(price).alias("x"))), ignorenulls=True).over(after)
    marked = marked.withColumns({"after_low": nxt("is_high", "h"), "after_high": nxt("is_low", "l"), "left_rim": F.max("h").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    out = bars
    for kind in ("low", "high"):
        side = marked.withColumns({"next_p": F.col(f"after_{kind}.p"), "next_price": F.col(f"after_{kind}.x")})
        out = out.join(_swings(side, kind, order).hint("merge"), ["symbol", "tf", "k"], "left")
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"low": F.last("new_low", ignorenulls=True).over(seen), "high": F.last("new_high", ignorenulls=True).over(seen), "ls": F.collect_list("l").over(I.frame(-29)), "hs": F.collect_list("h").over(I.frame(-29)), "h_lately": F.max("h").over(I.frame(-order))})
    run = Window.partitionBy("symbol", "tf", F.col("low.p")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("right_rim", F.greatest(F.max("h").over(run), F.first("h_lately").over(run)))


def _candidate(name: str, bias: str, when: Column, entry: Column, stop: Column, target: Column, confidence: float | Column) -> Column:
    conf = F.lit(confidence) if isinstance(confidence, float) else confidence
    risk = entry - stop if bias == "long" else stop - entry
    values = (F.lit(name), F.lit(bias), entry.cast("double"), stop.cast("double"), target.cast("double"), conf.cast("double"))
    return F.when(when & (risk > 0), F.struct(*(x.alias(k) for k, x in zip(SIGNAL, values, strict=True))))


def _last(xs: str, n: Column) -> Column:
    return F.slice(xs, F.greatest(F.size(xs) - n.cast("int") + 1, F.lit(1)), F.greatest(n.cast("int"), F.lit(1)))


def chart_patterns(bars: DataFrame, order: int) -> DataFrame:
    """Double bottoms and tops, flags, head and shoulders, triangles, cup with handle: at every bar that completes one."""
    df = with_visible_swings(bars, order)
    c, k, n = F.col("c"), F.col("k"), F.col("k") + 1
    low, high = (lambda f: F.col(f"low.{f}")), (lambda f: F.col(f"high.{f}"))
    floor, roof = F.least(low("price"), low("price1")), F.greatest(high("price"), high("price1"))
    near = lambda a, b, share: F.abs(a - b) <= a * share
    out = [
        _candidate("double_bottom", "long", (n >= 30) & near(low("price1"), low("price"), 0.015) & (c >= low("neck")), low("neck") + TICK, floor - TICK, 2 * low("neck") + TICK - floor, 0.65),
        _candidate("double_top", "short", (n >= 30) & near(high("price1"), high("price"), 0.015) & (c <= high("neck")), high("neck") - TICK, roof + TICK, 2 * high("neck") - TICK - roof, 0.63),
    ]
    seen = lambda side: side("next_p").isNotNull() & (side("next_p") + order <= k)
    length = lambda side: k - side("next_p") + 1
    up, flag_low = low("next_price") - low("price"), F.array_min(_last("ls", length(low)))
    down, flag_high = high("price") - high("next_price"), F.array_max(_last("hs", length(high)))
    out.append(_candidate("bull_flag", "long", (n >= 20) & seen(low) & (up / low("price") >= 0.02) & length(low).between(3, 30) & (low("next_price") - flag_low <= 0.5 * up), low("next_price") * 1.001, flag_low * 0.998, low("next_price") * 1.001 + up, 0.60))
    out.append(_candidate("bear_flag", "short", (n >= 20) & seen(high) & (down / high("price") >= 0.02) & length(high).between(3, 30) & (flag_high - high("next_price") <= 0.5 * down), high("next_price") * 0.999, flag_high * 1.002, high("next_price") * 0.999 - down, 0.58))
    neck = F.least(high("neck"), high("neck1"))
    out.append(_candidate("head_and_shoulders", "short", (n >= 40) & (high("price1") > high("price2")) & (high("price1") > high("price")) & near(high("price2"), high("price"), 0.03) & (c <= neck), neck - TICK, high("price") + TICK, 2 * neck - TICK - high("price1"), 0.68))
    neck = F.greatest(low("neck"), low("neck1"))
    out.append(_candidate("inverse_head_and_shoulders", "long", (n >= 40) & low("price2").isNotNull() & (low("price1") < low("price2")) & (low("price1") < low("price")) & near(low("price2"), low("price"), 0.03) & (c >= neck), neck + TICK, low("price") - TICK, 2 * neck + TICK - low("price1"), 0.68))
    top, bottom = (high("price") + high("price1")) / 2, (low("price") + low("price1")) / 2
    out.append(_candidate("ascending_triangle", "long", (n >= 25) & (F.abs(high("price") - high("price1")) <= top * 0.01) & (low("price") > low("price1")) & (c >= top), top + TICK, low("price") - TICK, 2 * top + TICK - low("price"), 0.62))
    out.append(_candidate("descending_triangle", "short", (n >= 25) & (F.abs(low("price") - low("price1")) <= bottom * 0.01) & (high("price") < high("price1")) & (c <= bottom), bottom - TICK, high("price") + TICK, 2 * bottom - TICK - high("price"), 0.60))
    rim = F.least(low("left_rim"), F.col("right_rim"))
    since = k - low("p") - 4
    handle = F.array_min(_last("ls", F.least(since, F.lit(10))))
    back = F.try_divide(rim - handle, F.nullif(rim - low("price"), F.lit(0)))
    out.append(_candidate("cup_with_handle", "long", (n >= 40) & low("left_rim").isNotNull() & (rim > low("price")) & (since >= 3) & back.between(0.10, 0.50) & (c >= rim), rim + TICK, handle - TICK, 2 * rim + TICK - low("price"), 0.65))
    return df.select("symbol", "tf", "ts", F.inline(F.array_compact(F.array(*out))))


def breaking_news(bars: DataFrame) -> DataFrame:
    """A bar of three times the volume and twice the range of the ten before the last one."""
    df = bars.withColumns({"n": I.bars_so_far(), "vol": F.avg("v").over(I.frame(-11, -2)), "span": F.avg(F.col("h") - F.col("l")).over(I.frame(-11, -2))})
    c, o, h, l, v = (F.col(x) for x in "cohlv")  # noqa: E741
    loud = (F.col("n") >= 12) & (F.col("vol") > 0) & (v >= 3 * F.col("vol")) & (F.col("span") > 0) & (h - l >= 2 * F.col("span"))
    conf = F.least(F.lit(0.85), 0.45 + F.when(v > 5 * F.col("vol"), 0.15).otherwise(0.0) + F.when(h - l > 3 * F.col("span"), 0.10).otherwise(0.0))
    up, down = l - TICK, h + TICK
    out = [_candidate("breaking_news", "long", loud & (c > o), c, up, 3 * c - 2 * up, conf), _candidate("breaking_news", "short", loud & (c <= o), c, down, 3 * c - 2 * down, conf)]
    return df.select("symbol", "tf", "ts", F.inline(F.array_compact(F.array(*out))))


def opening_range_break(bars: DataFrame, minutes: int) -> DataFrame:
    """The first close outside the opening range within 29 bars of its end, with a risk of at most the range."""
    df = bars.withColumn("opened", I.session_open())
    high, low = I.opening_range(minutes)
    day = Window.partitionBy("symbol", "tf", F.to_date("ts"))
    inside = (F.col("ts") >= F.col("opened")) & (F.col("ts") <= F.col("opened") + F.make_dt_interval(mins=F.lit(minutes)))
    df = df.withColumns({"or_high": high, "or_low": low, "or_vol": F.avg(F.when(inside, F.col("v"))).over(day), "or_close": F.min_by("c", F.when(inside, F.col("ts"))).over(day)})
    later = df.where(F.col("ts") > F.col("opened") + F.make_dt_interval(mins=F.lit(minutes))).withColumn("i", F.row_number().over(day.orderBy("ts"))).where("i <= 29")
    span, c = F.col("or_high") - F.col("or_low"), F.col("c")
    up, down = F.col("or_high") + TICK, F.col("or_low") - TICK
    conf = 0.50 + F.when(F.col("v") > 1.5 * F.col("or_vol"), 0.15).otherwise(0.0) + F.when(span < 0.02 * F.col("or_close"), 0.05).otherwise(0.0)
    name = f"orb_{minutes}"
    long = _candidate(name, "long", (span > 0) & (c > F.col("or_high")) & (up - (F.col("l") - TICK) <= span), up, F.col("l") - TICK, up + 2 * span, conf)
    short = _candidate(name, "short", (span > 0) & (c < F.col("or_low")) & (F.col("h") + TICK - down <= span), down, F.col("h") + TICK, down - 2 * span, 0.55)
    hits = later.withColumn("x", F.coalesce(long, short)).where("x is not null")
    return hits.groupBy("symbol", "tf", F.to_date("ts").alias("day")).agg(F.min_by(F.struct("ts", "x.*"), "ts").alias("s")).select("symbol", "tf", "s.*")


def ema_vwap_cross(wide: DataFrame) -> DataFrame:
    """Bars of a session where the rising 9-bar EMA comes up through a flat VWAP. Needs ema9 and vwap."""
    w = I.series()
    df = wide.withColumns({"e1": F.lag("ema9", 1).over(w), "e3": F.lag("ema9", 3).over(w), "w1": F.lag("vwap", 1).over(w), "w5": F.lag("vwap", 5).over(w), "so_far": F.row_number().over(I.session()), "day_low": F.min("l").over(I.session())})
    crossed = (F.col("e1") < F.col("w1")) & (F.col("ema9") >= F.col("vwap")) & (F.col("ema9") > F.col("e3")) & (F.col("vwap") - F.col("w5") <= 0.001 * F.col("vwap"))
    return df.where(crossed & (F.col("so_far") > 10))


def fashionably_late(wide: DataFrame) -> DataFrame:
    """Entry at the crossing's VWAP; a measured move from the day's low up, a third of it at risk."""
    df = ema_vwap_cross(wide).where("so_far >= 20")
    move, at = F.col("vwap") - F.col("day_low"), F.col("vwap")
    conf = F.least(F.lit(0.90), 0.65 + F.when(I.minute_of_day().between(600, 645), 0.10).otherwise(0.0))
    return df.select("symbol", "tf", "ts", F.inline(F.array_compact(F.array(_candidate("fashionably_late", "long", move > 0, at, at - move / 3, at + move, conf)))))


def spencer(bars: DataFrame) -> DataFrame:
    """The day's first break of a quiet 20-bar base in the upper third of the day's range."""
    before = I.frame(-20, -1)
    df = bars.withColumns(
        {"so_far": F.row_number().over(I.session()), "top": F.max("h").over(I.session()), "bottom": F.min("l").over(I.session()), "c_high": F.max("h").over(before), "c_low": F.min("l").over(before), "vol": F.avg("v").over(before), "dev": F.stddev_pop("v").over(before), "v1": F.lag("v").over(I.series())}
    )
    span, base = F.col("top") - F.col("bottom"), F.col("c_high") - F.col("c_low")
    when = (F.col("so_far") >= 26) & (span > 0) & (F.col("c_low") >= F.col("bottom") + span * 2 / 3) & (base <= 0.35 * span) & (F.col("dev") <= 0.8 * F.col("vol")) & (F.col("h") > F.col("c_high"))
    conf = 0.50 + F.when(F.col("v1") < 0.7 * F.col("vol"), 0.10).otherwise(0.0) + F.when(base < 0.20 * span, 0.10).otherwise(0.0)
    hit = df.withColumn("x", _candidate("spencer", "long", when, F.col("c_high") + TICK, F.col("c_low") - TICK, F.col("c_high") + TICK + 2 * base, conf)).where("x is not null")
    return hit.groupBy("symbol", "tf", F.to_date("ts").alias("day")).agg(F.min_by(F.struct("ts", "x.*"), "ts").alias("s")).select("symbol", "tf", "s.*")


def neckline(pivots: DataFrame, share: float = 0.015) -> DataFrame:
    """Mean of each series' given lows where none is further than `share` from it."""
    lows = pivots.where("kind = 'low'")
    means = lows.groupBy("symbol", "tf").agg(F.avg("price").alias("mean"), F.max("price").alias("top"), F.min("price").alias("bottom"))
    return means.where(F.greatest(F.col("top") - F.col("mean"), F.col("mean") - F.col("bottom")) <= share * F.col("mean")).select("symbol", "tf", F.col("mean").alias("neckline"))


def tidal_wave(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """Falling bounces from a support that the last close has broken on volume: at each series' last bar, gated; needs atr.

    The level is the one with most touches, three at least, the lower of equals. A bounce opens when a low comes within 0.3 ATR of it
    and takes in the bars above it; bounces are runs, so this short fold goes over one series' bars and its one level. There is no
    signal in series of under 30 bars, in those without such a level, or where a bounce is missing: three are needed, over 15 bars.
    """
    import pandas as pd

    pick = levels.where("type in ('support', 'both') and touches >= 3").groupBy("symbol", "tf").agg(F.max_by("price", F.struct(F.col("touches"), -F.col("price"))).alias("level"))
    df = bars.withColumn("confirmed", I.volume_confirm(1.3)).join(pick.hint("merge"), ["symbol", "tf"]).select("symbol", "tf", "ts", "h", "l", "c", "atr", "level", "confirmed")
    fields = {"symbol": "string", "tf": "string", "ts": "timestamp_ntz", "bounces": "long", "bias": "string"} | dict.fromkeys(("entry", "stop", "target", "target_1", "target_2", "price", "atr", "confidence"), "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        last = pdf.iloc[-1]
        level, atr, price = float(last["level"]), float(last["atr"]), float(last["c"])
        heights, first, opened = [], -1, False
        for i, (h, low) in enumerate(zip(pdf["h"], pdf["l"], strict=True)):
            if opened and low > level - 0.3 * atr:
                heights[-1] = max(heights[-1], h - level)
                continue
            opened = abs(low - level) < 0.3 * atr
            if opened:
                heights.append(h - level)
                first = i if first < 0 else first
        if len(pdf) < 30 or len(heights) < 3 or heights[-1] >= heights[0] or len(pdf) - 1 - first < 15 or price >= level or not last["confirmed"] or not atr > 0:
            return pd.DataFrame(columns=list(fields))
        entry, mean = level - 0.1 * atr, sum(heights) / len(heights)
        less = 1 - heights[-1] / heights[0] if heights[0] > 0 else 0.0
        conf = 0.55 + min(0.08, (len(heights) - 3) * 0.03) + less * 0.10
        row = (last["symbol"], last["tf"], last["ts"], len(heights), "short", entry, level + heights[0] + 0.2 * atr, entry - mean, entry - mean / 2, entry - mean, price, atr, conf)
        return pd.DataFrame([row], columns=list(fields))

    found = df.groupBy("symbol", "tf").applyInPandas(run, ", ".join(f"{k} {v}" for k, v in fields.items()))
    return setup_gate(found).select("symbol", "tf", "ts", "bounces", "bias", "entry", "stop", "t1", "t2", "rr", "confidence")


_WAVE = {"symbol": "string", "tf": "string", "ts": "timestamp_ntz", "k": "long", "bounces": "long", "bias": "string"}
_WAVE |= dict.fromkeys(("entry", "stop", "target", "target_1", "target_2", "price", "atr", "confidence"), "double")


def tidal_waves(bars: DataFrame, every: dict[str, int] | None = None, warm_up: int = 30, tolerance: float = 0.008) -> DataFrame:
    """Falling bounces from a support that the close breaks on volume, at every bar of the scan, gated; needs atr.

    As of a bar, its levels are those of the zigzag swings confirmed by then, and the bounces those of all bars so far. every: bars between scans by
    timeframe; others are scanned at every bar. One series is a group: levels are formed anew only once a swing is confirmed, and bounces are
    counted only at scan bars on volume below a level.
    """
    df = bars.withColumn("confirmed", F.coalesce(I.volume_confirm(1.3), F.lit(False))).select("symbol", "tf", "ts", "h", "l", "c", "atr", "confirmed")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        symbol, tf = pdf["symbol"].iloc[0], pdf["tf"].iloc[0]
        h, l, c, atr = (pdf[x].to_numpy(dtype=np.float64) for x in ("h", "l", "c", "atr"))  # noqa: E741
        pivots = folds.zigzag(h, l, folds.ZIGZAG.get(tf, folds.ZIGZAG["1d"]))
        confirms = np.array([p[1] for p in pivots], dtype=np.int64)
        scan = np.arange(warm_up - 1, len(pdf), (every or {}).get(tf, 1))
        rows, level, formed = [], None, -1
        for k in scan[pdf["confirmed"].to_numpy()[scan] & (atr[scan] > 0)].tolist():
            seen = int(np.searchsorted(confirms, k, side="right"))
            if seen != formed:
                level, formed = support_of(pivots[:seen], tolerance), seen
            if level is None or c[k] >= level:
                continue
            heights, first = bounces_from(h[: k + 1], l[: k + 1], level, 0.3 * atr[k])
            if len(heights) < 3 or heights[-1] >= heights[0] or k - first < 15:
                continue
            entry, mean = level - 0.1 * atr[k], float(heights.mean())
            less = 1 - heights[-1] / heights[0] if heights[0] > 0 else 0.0
            conf = 0.55 + min(0.08, (len(heights) - 3) * 0.03) + less * 0.10
            rows.append((symbol, tf, pdf["ts"][k], k, len(heights), "short", entry, level + heights[0] + 0.2 * atr[k], entry - mean, entry - mean / 2, entry - mean, c[k], atr[k], conf))
        return pd.DataFrame(rows, columns=list(_WAVE))

    found = df.groupBy("symbol", "tf").applyInPandas(run, ", ".join(f"{k} {v}" for k, v in _WAVE.items()))
    return setup_gate(found).select("symbol", "tf", "ts", "k", "bounces", "bias", "entry", "stop", "t1", "t2", "rr", "confidence")


def support_of(pivots: list[tuple[int, int, float, str]], tolerance: float, touches: int = 3) -> float | None:
    """Of the levels that hold lows, the one with most touches, `touches` at least, and of equals the lower; its mean price."""
    price, low = (np.array(x) for x in zip(*sorted((p[2], p[3] == "low") for p in pivots), strict=True)) if pivots else (np.empty(0), np.empty(0))
    if not len(price):
        return None
    starts = level_starts(price, tolerance)
    n = np.diff(np.append(starts, len(price)))
    held = np.flatnonzero((np.add.reduceat(low.astype(np.int64), starts) > 0) & (n >= touches))
    if not len(held):
        return None
    best = held[n[held].argmax()]
    return float(np.add.reduceat(price, starts)[best] / n[best])


def bounces_from(h: np.ndarray, l: np.ndarray, level: float, reach: float) -> tuple[np.ndarray, int]:  # noqa: E741
    """Heights of the bounces in order, and the bar of the first touch. A bounce goes from a low within `reach` of the level to the last bar before one below it."""
    inside, touch = l > level - reach, np.abs(l - level) < reach
    run = np.cumsum(~inside)  # bars of one run share a number
    at = np.flatnonzero(touch)
    if not len(at):
        return np.empty(0), -1
    starts = at[np.append(True, run[at][1:] != run[at][:-1])]
    # a run ends before its first bar below; the pieces between are left out of the maxima
    below = np.append(np.flatnonzero(~inside), len(h))
    ends = below[np.searchsorted(below, starts)]
    tops = np.maximum.reduceat(np.append(h, -np.inf), np.stack([starts, ends], axis=1).ravel())[::2]
    return tops - level, int(starts[0])


def _session_base(bars: DataFrame) -> DataFrame:
    """Bars with their place in the session (from 0), its open, extremes so far, the close before it, and the last 20 bars as arrays."""
    first = lambda x: F.first(x).over(I.session())
    df = bars.withColumn("prev", F.lag("c", 1).over(I.series()))
    return df.withColumns(
        {
            "i": F.row_number().over(I.session()) - 1, "first_o": first("o"), "first_h": first("h"), "before": first("prev"), "top": F.max("h").over(I.session()), "bottom": F.min("l").over(I.session()),
            **{f"{x}20": F.collect_list(x).over(I.frame(-20, -1)) for x in "hlv"},
        }
    )


def hitch_hiker(bars: DataFrame) -> DataFrame:
    """A drive off the open, 5 to 20 quiet bars in the upper third of the day, and a bar above them."""
    df = _session_base(bars).withColumn("drive", F.min(F.when(F.col("i").between(3, 9) & (F.col("c") > 1.005 * F.col("first_o")), F.col("i"))).over(I.session()))
    n = F.col("i") - 1 - F.col("drive")
    c_high, c_low = F.array_max(_last("h20", n)), F.array_min(_last("l20", n))
    span = F.col("top") - F.col("bottom")
    mean = F.try_divide(F.aggregate(_last("v20", n), F.lit(0.0), lambda a, x: a + x), F.nullif(n, F.lit(0)))
    when = n.between(5, 20) & (span > 0) & (c_high - c_low < 0.40 * span) & (c_low >= F.col("bottom") + span * 2 / 3) & (F.col("h") > c_high)
    conf = F.least(F.lit(0.90), 0.50 + F.when(F.col("v") > 1.3 * mean, 0.10).otherwise(0.0) + F.when(I.minute_of_day().between(570, 599), 0.10).otherwise(0.0) + F.when(c_low > F.col("first_h"), 0.05).otherwise(0.0))
    entry, stop = c_high + TICK, c_low - TICK
    return df.select("symbol", "tf", "ts", F.inline(F.array_compact(F.array(_candidate("hitch_hiker", "long", when, entry, stop, entry + 1.9 * (entry - stop), conf)))))


def gap_give_and_go(bars: DataFrame) -> DataFrame:
    """A gap up that drops, rests for 3 to 7 bars in half of the drop, and breaks out with 1 R up to the open."""
    df = _session_base(bars).withColumn("drop", F.max(F.when(F.col("i").between(1, 5) & (F.col("l") < 0.995 * F.col("first_o")), F.col("i"))).over(I.session()))
    n = F.col("i") - F.col("drop")
    c_high, c_low = F.array_max(_last("h20", n)), F.array_min(_last("l20", n))
    fall = F.col("first_o") - c_low
    entry, stop = c_high + TICK, c_low - TICK
    gap = F.col("first_o") / F.col("before") - 1 >= 0.005
    when = gap & n.between(3, 7) & (fall > 0) & (c_high - c_low <= 0.5 * fall) & (F.col("h") > c_high) & (F.col("first_o") - entry >= entry - stop)
    conf = F.least(F.lit(0.85), 0.50 + F.when(I.minute_of_day().between(570, 585), 0.10).otherwise(0.0))
    return df.select("symbol", "tf", "ts", F.inline(F.array_compact(F.array(_candidate("gap_give_and_go", "long", when, entry, stop, F.col("first_o"), conf)))))


def session_scalps(wide: DataFrame) -> DataFrame:
    """Rubber band and back side at every bar that completes one; needs atr, vwap and ema9.

    Both go by the session's low so far and the bars after it. A session is bounded, so it is one small group, read once
    as arrays with a running low.
    """
    fields = ["symbol", "tf", "ts", "o", "h", "l", "c", "v", "atr", "vwap", "ema9", "n", "e2"]
    df = wide.withColumns({"n": I.bars_so_far(), "e2": F.lag("ema9", 2).over(I.series())}).select(*fields, F.to_date("ts").alias("day"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        day = {x: pdf[x].to_numpy(dtype=np.float64) for x in fields[3:]}
        day["at"] = (pdf["ts"].dt.hour * 60 + pdf["ts"].dt.minute).to_numpy()
        # the first bar of the lowest low so far
        fresh = np.append(True, day["l"][1:] < np.minimum.accumulate(day["l"])[:-1])
        lows = np.maximum.accumulate(np.where(fresh, np.arange(len(pdf)), 0))
        found = [(i, signal) for i, low in enumerate(lows.tolist()) for make in (rubber_band, back_side) if (signal := make(day, i, low))]
        return pd.DataFrame([(*pdf.loc[i, ["symbol", "tf", "ts"]], *signal) for i, signal in found], columns=["symbol", "tf", "ts", *SIGNAL])

    kinds = "symbol string, tf string, ts timestamp_ntz, pattern string, bias string, entry double, stop double, target double, confidence double"
    return df.groupBy("symbol", "tf", "day").applyInPandas(run, kinds)


def rubber_band(day: dict[str, np.ndarray], i: int, low: int) -> tuple | None:
    """A fall of an ATR or more that speeds up, and a rising bar that clears two highs: at that bar, while below the VWAP."""
    o, h, l, c, v = (day[x] for x in "ohlcv")  # noqa: E741
    atr, at = day["atr"][i], int(day["at"][i])
    if day["n"][i] < 20 or not day["vwap"][i] > c[i] or not atr > 0 or not (low < i <= low + 9 and low >= 5) or c[i] <= o[i]:
        return None
    clears = lambda k: (h[k] > h[max(low, k - 5) : k]).sum() >= 2 and c[k] > o[k]
    reach, mid = (o[0] - l[low]) / atr, low // 2
    slow, fast = (h[:mid] - l[:mid]).mean(), (h[mid:low] - l[mid:low]).mean()
    if not clears(i) or any(clears(k) for k in range(low + 1, i)) or reach < 1 or fast < 1.2 * slow:
        return None
    entry, stop = float(h[i] + TICK), float(l[low] - TICK)
    fifth = np.sort(v[: i + 1])[-min(5, i + 1)]
    conf = 0.45 + 0.15 * bool(reach >= 3) + 0.10 * bool(v[i] >= fifth) + 0.10 * bool(fast > 1.5 * slow) + (0.10 if 600 <= at <= 645 else 0.05 if 645 <= at <= 810 else 0.0)
    return ("rubber_band", "long", entry, stop, 3 * entry - 2 * stop, min(conf, 0.95)) if entry > stop else None


def back_side(day: dict[str, np.ndarray], i: int, low: int) -> tuple | None:
    """A higher high and a higher low after the day's low, above a rising 9-bar EMA, with 1 R up to the VWAP."""
    h, l, c, e = (day[x] for x in ("h", "l", "c", "ema9"))  # noqa: E741
    vwap = day["vwap"][i]
    if day["n"][i] < 25 or i + 1 < 15 or low < 3 or i + 1 - low < 8 or not l[low] < vwap or not e[i] > day["e2"][i] or c[i] < e[i]:
        return None
    tops, floors = _extremes(h[low : i + 1]), _extremes(-l[low : i + 1])
    higher = floors[l[low + floors] > l[low]]
    if not len(higher) or not (h[low + tops] > h[low]).any():
        return None
    entry, stop, target = float(h[i] + TICK), float(l[low + higher[-1]] - TICK), float(vwap)
    if entry <= stop or target - entry < entry - stop:
        return None
    held = (c[max(0, i - 7) : i + 1] > e[max(0, i - 7) : i + 1]).sum()
    conf = 0.48 + 0.10 * bool(held >= 6) + 0.10 * bool(600 <= int(day["at"][i]) <= 645)
    return "back_side", "long", entry, stop, target, min(conf, 0.85)


def _extremes(x: np.ndarray) -> np.ndarray:
    """Positions above both two neighbours on either side."""
    if len(x) < 5:
        return np.empty(0, dtype=np.int64)
    middle = x[2:-2]
    return 2 + np.flatnonzero((middle > x[:-4]) & (middle > x[1:-3]) & (middle > x[3:-1]) & (middle > x[4:]))


def level_scalps(bars: DataFrame, order: int) -> DataFrame:
    """Second chance and bouncing ball at every bar that completes one, by the swings visible at it. Needs k.

    The fold goes over one series, as the swings of all its past count as touches. Swings stand in an index by price, so a new one finds
    the levels it touches by bisection, and only those are looked at; what a level then waits for is found in the few bars after its touch.
    """

    marked = bars.withColumns({"is_high": F.coalesce(I.swing_high(order), F.lit(False)), "is_low": F.coalesce(I.swing_low(order), F.lit(False)), "vol5": F.avg("v").over(I.frame(-5, -1))})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        o = {x: pdf[x].to_numpy(dtype=np.float64) for x in (*"hlcv", "vol5")}
        found = (*second_chance(o, pdf["is_high"].to_numpy().nonzero()[0], order), *bouncing_ball(o, pdf["is_low"].to_numpy().nonzero()[0], order))
        rows = [(*pdf.loc[i, ["symbol", "tf", "ts"]], *x) for i, x in found]
        return pd.DataFrame(rows, columns=["symbol", "tf", "ts", *SIGNAL])

    kinds = "symbol string, tf string, ts timestamp_ntz, pattern string, bias string, entry double, stop double, target double, confidence double"
    return marked.select("symbol", "tf", "ts", *"ohlcv", "is_high", "is_low", "vol5").groupBy("symbol", "tf").applyInPandas(run, kinds)


#: Share of a level's first price within which later swings touch it.
NEAR = 0.003


class TouchedLevels:
    """Swings in order of time, each a level of its own that later swings near its price touch; `touches` yields each swing with the levels it touches."""

    def __init__(self, at: np.ndarray, price: np.ndarray):
        self.at, self.price = at, price
        self.count, self.total = np.ones(len(at), dtype=np.int64), price.astype(np.float64).copy()
        self.last = at.astype(np.int64).copy()

    def touches(self) -> Iterator[tuple[int, np.ndarray]]:
        """(swing, levels before it that it touches); their count, total and last touch change after the caller has looked."""
        prices: list[float] = []
        who: list[int] = []
        for k, p in enumerate(self.price.tolist()):
            # a little wider than the rule, which is then held exactly
            low, high = bisect_left(prices, p / (1 + NEAR) * (1 - 1e-9)), bisect_right(prices, p / (1 - NEAR) * (1 + 1e-9))
            near = np.array(who[low:high], dtype=np.int64)
            near = near[np.abs(self.price[near] - p) < self.price[near] * NEAR]
            yield k, near
            self.count[near] += 1
            self.total[near] += p
            self.last[near] = self.at[k]
            place = bisect_right(prices, p)
            prices.insert(place, p)
            who.insert(place, k)


def _first(hit: np.ndarray) -> np.ndarray:
    """By row the first position that holds, or the width."""
    return np.where(hit.any(axis=1), hit.argmax(axis=1), hit.shape[1])


def _window(x: np.ndarray, starts: np.ndarray, width: int, beyond: float) -> np.ndarray:
    """By row the `width` values from a start on; `beyond` past the end."""
    place = starts[:, None] + np.arange(width)
    return np.where(place < len(x), x[np.minimum(place, len(x) - 1)], beyond)


def _earliest(waiting: dict[int, tuple], now: int, level: int, signal: tuple) -> None:
    """Of the levels that give a signal at a bar, the first one counts."""
    if now not in waiting or level < waiting[now][0]:
        waiting[now] = (level, signal)


def second_chance(o: dict[str, np.ndarray], at: np.ndarray, order: int) -> Iterator[tuple[int, tuple]]:
    """A break above a resistance, a retest that comes back to it, and the next close above the retest's high.

    What a touch leads to is known at the touch: break, retest and signal are first bars after it. It holds unless a newer touch of the level is visible by then.
    """
    h, l, c, v = (o[x] for x in "hlcv")  # noqa: E741
    levels = TouchedLevels(at, h[at])
    due, pending, out = np.full(len(at), -1, dtype=np.int64), {}, {}
    for k, near in levels.touches():
        seen = int(at[k]) + order
        # a signal that was due before this swing is visible stands, others lapse
        for i in near[(due[near] >= 0) & (due[near] < seen)].tolist():
            _earliest(out, int(due[i]), i, pending.pop(i))
        due[near] = -1
        if not len(near):
            continue
        wall = ((levels.total[near] + h[at[k]]) / (levels.count[near] + 1))[:, None]
        starts = np.full(len(near), int(at[k]) + 1)
        gap = _first(_window(c, starts, 19, -np.inf) > wall * 1.002)
        broken = starts + gap
        back = broken + 1 + (gap_back := _first(_window(l, broken + 1, 14, np.inf) <= wall * 1.003))
        now = back + 1
        ok = (gap < 19) & (gap_back < 14) & (now >= max(29, seen)) & (now < len(c)) & (now - at[k] <= 36)
        ok &= c[np.minimum(now, len(c) - 1)] > h[np.minimum(back, len(c) - 1)]
        for i, b, t, n in zip(near[ok].tolist(), broken[ok].tolist(), back[ok].tolist(), now[ok].tolist(), strict=True):
            entry, stop, target = float(c[n]), float(l[t] - TICK), float(h[b : t + 1].max())
            if entry > stop and target - entry >= entry - stop:
                ratio = round((target - entry) / (entry - stop), 9)
                due[i], pending[i] = n, ("second_chance", "long", entry, stop, target, 0.45 + 0.15 * (v[t] < v[b] * 0.7) + 0.10 * (ratio >= 1.9))
    for i, signal in pending.items():
        if due[i] >= 0:
            _earliest(out, int(due[i]), i, signal)
    return ((now, out[now][1]) for now in sorted(out))


def bouncing_ball(o: dict[str, np.ndarray], at: np.ndarray, order: int) -> Iterator[tuple[int, tuple]]:
    """Three or more touches of a support with ever lower bounces, and the first close below it within nine bars."""
    h, l, c, v = (o[x] for x in "hlcv")  # noqa: E741
    levels, tops = TouchedLevels(at, l[at]), RangeMax(h)
    last_top, falling = np.full(len(at), np.inf), np.ones(len(at), dtype=bool)
    due, pending, out = np.full(len(at), -1, dtype=np.int64), {}, {}
    for k, near in levels.touches():
        here, seen = int(at[k]), int(at[k]) + order
        for i in near[(due[near] >= 0) & (due[near] < seen)].tolist():
            _earliest(out, int(due[i]), i, pending.pop(i))
        due[near] = -1
        if not len(near):
            continue
        top = tops.between(levels.last[near], np.full(len(near), here))
        falling[near] &= top < last_top[near]
        last_top[near] = top
        floor = l[at[near]]
        now = here + 1 + (gap := _first(_window(c, np.full(len(near), here + 1), 9, np.inf) < floor[:, None]))
        ok = (gap < 9) & falling[near] & (levels.count[near] >= 2) & (now >= max(29, seen)) & (now < len(c))
        for i, n, bounce, wall in zip(near[ok].tolist(), now[ok].tolist(), top[ok].tolist(), floor[ok].tolist(), strict=True):
            entry, stop = wall - TICK, bounce + TICK
            if stop > entry:
                conf = 0.55 + 0.10 + 0.10 * bool(o["vol5"][here] > 0 and v[n] > o["vol5"][here] * 1.3)
                due[i], pending[i] = n, ("bouncing_ball", "short", entry, stop, 3 * entry - 2 * stop, min(conf, 0.85))
    for i, signal in pending.items():
        if due[i] >= 0:
            _earliest(out, int(due[i]), i, signal)
    return ((now, out[now][1]) for now in sorted(out))


class RangeMax:
    """Maxima of ranges [a, b) of an array, from maxima over powers of two."""

    def __init__(self, x: np.ndarray):
        self.tables = [x]
        while 2 * (step := 1 << (len(self.tables) - 1)) <= len(x):
            self.tables.append(np.maximum(self.tables[-1][:-step], self.tables[-1][step:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a))
        level = np.log2(np.maximum(b - a, 1)).astype(np.int64)
        for n in np.unique(level):
            some = level == n
            out[some] = np.maximum(self.tables[n][a[some]], self.tables[n][b[some] - (1 << int(n))])
        return out
