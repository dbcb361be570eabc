"""Indicators over trailing frames of one series. `series()` orders a series; all frames share its one sort.

Each function gives a Column; short history gives null. Nothing looks ahead of the current bar.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

def series() -> WindowSpec:
    return Window.partitionBy("symbol", "tf").orderBy("ts")


def session() -> WindowSpec:
    return Window.partitionBy("symbol", "tf", F.to_date("ts")).orderBy("ts")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame(first: int, last: int = 0) -> WindowSpec:
    return series().rowsBetween(first, last)


def bars_so_far() -> Column:
    return F.row_number().over(series())


def back(x: Column | str, n: int) -> Column:
    return F.lag(x, n).over(series())


def mean(x: Column | str, first: int, last: int = 0) -> Column:
    """Mean over the whole frame, null until the frame is full."""
    return F.when(bars_so_far() >= 1 - first, F.avg(x).over(frame(first, last)))


def sma(p: int, x: Column | str = "c") -> Column:
    return mean(x, 1 - p)


def true_range() -> Column:
    prev = back("c", 1)
    return F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - prev), F.abs(F.col("l") - prev))


def rolling_std(p: int, x: Column | str = "c") -> Column:
    return F.when(bars_so_far() >= p, F.stddev_pop(x).over(frame(1 - p)))


def zscore(p: int) -> Column:
    return F.try_divide(F.col("c") - sma(p), F.nullif(rolling_std(p), F.lit(0.0)))


def pct_return(n: int = 1) -> Column:
    """Null where the close before is 0."""
    return F.try_divide(F.col("c"), back("c", n)) - 1


roc = pct_return


def log_return() -> Column:
    """Null where the ratio of the closes is not above 0, as its logarithm is undefined."""
    return F.ln(F.try_divide(F.col("c"), back("c", 1)))


def annual_vol(p: int, returns: str = "ret") -> Column:
    """Annualised standard deviation of a column of returns."""
    return F.when(bars_so_far() > p, F.stddev_pop(returns).over(frame(1 - p)) * F.sqrt(F.lit(252.0)))


def rvol() -> Column:
    """Mean volume of 3 bars over that of the 20 before them."""
    return F.try_divide(mean("v", -2), F.nullif(mean("v", -22, -3), F.lit(0.0)))


def donchian_high(p: int) -> Column:
    return F.when(bars_so_far() > p, F.max("h").over(frame(-p, -1)))


def donchian_low(p: int) -> Column:
    return F.when(bars_so_far() > p, F.min("l").over(frame(-p, -1)))


def range_position(p: int) -> Column:
    low, high = F.min("l").over(frame(1 - p)), F.max("h").over(frame(1 - p))
    return F.when(bars_so_far() >= p, F.try_divide((F.col("c") - low) * 100.0, F.nullif(high - low, F.lit(0))))


def bollinger(p: int, m: float) -> tuple[Column, Column, Column]:
    """Upper, lower, bandwidth."""
    mid, std = sma(p), rolling_std(p)
    return mid + m * std, mid - m * std, (2 * m * std) / mid


def bandwidth_rank(bandwidth: str = "bandwidth") -> Column:
    """Share of the bandwidths 20 to 125 bars ago that exceed today's; of 20 or more."""
    past = F.filter(F.collect_list(bandwidth).over(frame(-125, -20)), lambda x: x.isNotNull())
    return F.when(F.size(past) >= 20, F.size(F.filter(past, lambda x: x > F.col(bandwidth))) / F.size(past))


def typical() -> Column:
    return (F.col("h") + F.col("l") + F.col("c")) / 3.0


def rolling_vwap(p: int = 20) -> Column:
    f = frame(1 - p)
    return F.coalesce(F.try_divide(F.sum((F.col("h") + F.col("l") + F.col("c")) * F.col("v")).over(f) / 3.0, F.nullif(F.sum("v").over(f), F.lit(0))), typical())


def minute_of_day() -> Column:
    return F.hour("ts") * 60 + F.minute("ts")


def session_open() -> Column:
    """Time of the session's first bar at or after 09:30, else of its first bar."""
    day = session().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.min(F.when(minute_of_day() >= 570, F.col("ts"))).over(day), F.min("ts").over(day))


def session_vwap(opened: str = "opened") -> Column:
    """VWAP from the session's open on; `opened` is session_open()."""
    run = session().rowsBetween(Window.unboundedPreceding, 0)
    inside = F.col("ts") >= F.col(opened)
    value = F.sum(F.when(inside, (F.col("h") + F.col("l") + F.col("c")) * F.col("v"))).over(run)
    return F.try_divide(value / 3.0, F.nullif(F.sum(F.when(inside, F.col("v"))).over(run), F.lit(0)))


def opening_range(minutes: int, opened: str = "opened") -> tuple[Column, Column]:
    """High and low of the bars up to `minutes` after the open, ends included."""
    day = session().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = (F.col("ts") >= F.col(opened)) & (F.col("ts") <= F.col(opened) + F.make_dt_interval(mins=F.lit(minutes)))
    return F.max(F.when(inside, F.col("h"))).over(day), F.min(F.when(inside, F.col("l"))).over(day)


def volume_confirm(th: float) -> Column:
    base = F.avg("v").over(frame(-20, -1))
    return (bars_so_far() <= 20) | (base <= 0) | (F.col("v") >= th * base)


def volume_exhaustion() -> Column:
    return F.col("v") <= 1.3 * F.avg("v").over(frame(-3, -1))


def volume_declining(span: int) -> Column:
    """Mean volume of the later half of the last `span` bars at most 1.1 times that of the earlier; true under 6 bars."""
    half = span // 2
    later, earlier = F.avg("v").over(frame(1 - (span - half))), F.avg("v").over(frame(1 - span, half - span))
    return F.lit(True) if span < 6 else F.coalesce(later <= 1.1 * earlier, F.lit(True))


def touch_volume() -> Column:
    """Mean volume two bars around, read two bars later at the earliest."""
    return F.avg("v").over(frame(-2, 2))


def higher_lows() -> Column:
    halves = F.min("l").over(frame(-4)) > F.min("l").over(frame(-9, -5))
    return F.when(bars_so_far() >= 10, halves & (F.min("l").over(frame(-2)) > F.min("l").over(frame(-9, -7))))


def lower_highs() -> Column:
    halves = F.max("h").over(frame(-4)) < F.max("h").over(frame(-9, -5))
    return F.when(bars_so_far() >= 10, halves & (F.max("h").over(frame(-2)) < F.max("h").over(frame(-9, -7))))


def range_squeeze() -> Column:
    """Mean range of 5 bars over that of the 15 before."""
    r = F.col("h") - F.col("l")
    return F.try_divide(mean(r, -4), F.nullif(mean(r, -19, -5), F.lit(0.0)))


def acc_dist_days(w: int) -> tuple[Column, Column]:
    """Days among w with volume over today's 50-bar mean and an up close, or none: accumulation, distribution."""
    days = F.collect_list(F.when(F.col("prev").isNotNull(), F.struct(F.col("v").alias("v"), (F.col("c") > F.col("prev")).alias("up")))).over(frame(1 - w))
    count = lambda up: F.size(F.filter(days, lambda x: (x["v"] > F.col("v50")) & (x["up"] == up))).cast("long")
    return count(True), count(False)


def volume_bias() -> Column:
    """Mean volume of up days over that of down days among 20."""
    up, down = F.avg(F.when(F.col("c") > F.col("prev"), F.col("v"))), F.avg(F.when(F.col("c") < F.col("prev"), F.col("v")))
    return F.when(bars_so_far() > 20, F.try_divide(up.over(frame(-19)), down.over(frame(-19))))


def structure_counts() -> dict[str, Column]:
    """Higher and lower highs and lows among 5 bars."""
    f, one = frame(-4), lambda x: F.when(x, 1).otherwise(0)
    h, l = F.col("h"), F.col("l")  # noqa: E741
    return {
        "hh": F.sum(one(h > F.col("prev_h"))).over(f), "lh": F.sum(one(h < F.col("prev_h"))).over(f),
        "hl": F.sum(one(l > F.col("prev_l"))).over(f), "ll": F.sum(one(l < F.col("prev_l"))).over(f),
    }


def rsi_simple(p: int = 14, diff: str = "diff") -> Column:
    """From plain sums of gains and losses; 100 without losses. `diff` is the change of the close."""
    gain = F.sum(F.greatest(F.col(diff), F.lit(0))).over(frame(1 - p))
    loss = F.sum(F.greatest(-F.col(diff), F.lit(0))).over(frame(1 - p))
    return F.when(bars_so_far() > p, F.when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / loss)))


def range_mean_atr(p: int = 14) -> Column:
    return mean(F.col("h") - F.col("l"), 1 - p)


def momentum_character(month: Column, quarter: Column) -> Column:
    """One month's return against the quarter's monthly pace."""
    return F.when(month.isNull() | quarter.isNull(), None).when(month < 0, "declining").when(month > quarter / 3, "accelerating").otherwise("decelerating")


def vol_regime_label(ratio: Column) -> Column:
    return F.when(ratio < 0.70, "compressed").when(ratio > 1.40, "expanded").when(ratio.isNotNull(), "normal")


def swing_high(order: int) -> Column:
    """Strictly above `order` bars on either side; known `order` bars later."""
    return (F.col("h") > F.max("h").over(frame(-order, -1))) & (F.col("h") > F.max("h").over(frame(1, order)))


def swing_low(order: int) -> Column:
    return (F.col("l") < F.min("l").over(frame(-order, -1))) & (F.col("l") < F.min("l").over(frame(1, order)))
