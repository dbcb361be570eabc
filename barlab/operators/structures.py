"""Swings, trend lines, channels, price levels and breakouts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions import indicators as I

#: Bars between two pivots of one structure, by timeframe.
MIN_SPAN = {"5min": 20, "15min": 15, "1h": 10, "1d": 15}


def min_span_ok(first: Column, second: Column, tf: Column) -> Column:
    """Whether two pivots are far enough apart for their timeframe; 10 bars for one that is not listed."""
    least = F.coalesce(*(F.when(tf == name, n) for name, n in MIN_SPAN.items()), F.lit(10))
    return F.abs(second - first) >= least


def pivot_volumes(bars: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pivots with `vol`, the mean volume of the bars from two before to two after. Bars need k."""
    around = bars.withColumn("vol", F.avg("v").over(I.frame(-2, 2))).select("symbol", "tf", F.col("k").alias("pivot"), "vol")
    return pivots.join(around.hint("merge"), ["symbol", "tf", "pivot"])


def volume_touch_bonus(first: Column, second: Column) -> Column:
    """Confidence for a second touch on less volume than the first."""
    return F.when(first <= 0, 0.0).when(second < first * 0.85, 0.08).when(second < first, 0.04).otherwise(0.0)


def volume_hs_bonus(left: Column, head: Column, right: Column) -> Column:
    """Confidence for volume that falls from the left shoulder to the head and on to the right one."""
    bonus = F.when(head < left, 0.04).otherwise(0.0) + F.when(right < head, 0.04).otherwise(0.0) + F.when((left > head) & (head > right), 0.04).otherwise(0.0)
    return F.when(left <= 0, 0.0).otherwise(bonus)


def swing_pivots(bars: DataFrame, order: int) -> DataFrame:
    """symbol, tf, pivot, confirm, price, kind: strict local extremes, known `order` bars later. Needs k."""
    marked = bars.withColumns({"is_high": I.swing_high(order), "is_low": I.swing_low(order)})
    pivot = lambda kind, price: F.when(F.col(f"is_{kind}"), F.struct(F.lit(kind).alias("kind"), F.col(price).alias("price")))
    both = marked.select("symbol", "tf", F.col("k").alias("pivot"), (F.col("k") + order).alias("confirm"), F.inline(F.array_compact(F.array(pivot("high", "h"), pivot("low", "l")))))
    return both.select("symbol", "tf", "pivot", "confirm", "price", "kind")


def swing_helpers(pivots: DataFrame) -> DataFrame:
    """By series: counts, highest and lowest pivot, their range, and the last three pivots."""
    by = F.struct("pivot", "kind")
    return pivots.groupBy("symbol", "tf").agg(
        F.count_if(F.col("kind") == "high").alias("highs"), F.count_if(F.col("kind") == "low").alias("lows"), F.max(F.when(F.col("kind") == "high", F.col("price"))).alias("highest"),
        F.min(F.when(F.col("kind") == "low", F.col("price"))).alias("lowest"), F.max_by("price", by).alias("last_price"), (F.max("price") - F.min("price")).alias("price_range"),
    )


def pivots_between(pivots: DataFrame, first: Column | str, last: Column | str) -> DataFrame:
    """Pivots from bar `first` to bar `last`, both included."""
    return pivots.where((F.col("pivot") >= first) & (F.col("pivot") <= last))


def fit_trendline(points: DataFrame, *keys: str) -> DataFrame:
    """Least squares of price on bar number by key; r2 is 0 when flat."""
    return points.groupBy(*keys).agg(
        F.regr_slope("price", "pivot").alias("slope"), F.regr_intercept("price", "pivot").alias("intercept"), F.coalesce(F.regr_r2("price", "pivot"), F.lit(0.0)).alias("r2"),
        F.count("*").alias("points"), F.min("pivot").alias("start"), F.max("pivot").alias("end"),
    )


def last_pivots(pivots: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("symbol", "tf", "kind").orderBy(F.desc("pivot"))
    return pivots.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def channels(pivots: DataFrame, n: int = 4, least_r2: float = 0.6) -> DataFrame:
    """Lines through the last highs and lows of each series, if both fit and the upper ends above the lower; with its measures."""
    lines = fit_trendline(last_pivots(pivots, n), "symbol", "tf", "kind")
    side = lambda kind, p: lines.where((F.col("kind") == kind) & (F.col("points") >= 2) & (F.col("r2") >= least_r2)).select("symbol", "tf", *(F.col(x).alias(f"{p}_{x}") for x in ("slope", "intercept", "r2", "start", "end")))
    both = side("high", "u").join(side("low", "d").hint("merge"), ["symbol", "tf"])
    at = lambda p, x: F.col(f"{p}_slope") * x + F.col(f"{p}_intercept")
    start, end = F.greatest("u_start", "d_start"), F.greatest("u_end", "d_end")
    out = both.withColumns({"width_start": at("u", start) - at("d", start), "width_end": at("u", end) - at("d", end)}).where("width_end > 0")
    gap = F.col("d_slope") - F.col("u_slope")
    return out.withColumns(
        {
            "converging": F.col("width_end") < F.col("width_start"), "mid_slope": (F.col("u_slope") + F.col("d_slope")) / 2, "compression": F.try_divide("width_end", F.nullif("width_start", F.lit(0.0))),
            "bars_to_meet": F.when(gap > 0, F.col("width_end") / gap), "same_sign": F.signum("u_slope") == F.signum("d_slope"),
        }
    )


def level_starts(price: np.ndarray, tolerance: float) -> np.ndarray:
    """Starts of the levels of sorted prices: a level takes what lies within `tolerance` of its first price.

    A jump chain: each start points to the first price beyond its reach, found by bisection, so only starts are visited.
    """
    starts, i = [], 0
    while i < len(price):
        starts.append(i)
        reach = price[i] * tolerance
        after = int(np.searchsorted(price, price[i] + reach, side="right"))
        # the sum is rounded; the rule is on the difference
        while after < len(price) and price[after] - price[i] <= reach:
            after += 1
        while after > i + 1 and price[after - 1] - price[i] > reach:
            after -= 1
        i = max(after, i + 1)
    return np.array(starts, dtype=np.int64)


_LEVEL = "symbol string, tf string, price double, touches long, width double, type string"


def cluster_levels(pivots: DataFrame, tolerance: float = 0.008, least: int = 2) -> DataFrame:
    """Greedy price levels: in price order, a level takes what lies within `tolerance` of its first price.

    One series' pivots are a group, far fewer than its bars; the time goes with pivots times their logarithm.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["price", "pivot", "kind"])
        price, high = pdf["price"].to_numpy(dtype=np.float64), (pdf["kind"] == "high").to_numpy()
        starts = level_starts(price, tolerance)
        n = np.diff(np.append(starts, len(price)))
        center = np.add.reduceat(price, starts) / n
        width = np.sqrt(np.add.reduceat((price - np.repeat(center, n)) ** 2, starts) / n)
        highs = np.add.reduceat(high.astype(np.int64), starts)
        kind = np.where(highs == n, "resistance", np.where(highs == 0, "support", "both"))
        out = pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "tf": pdf["tf"].iloc[0], "price": center, "touches": n, "width": width, "type": kind})
        return out[out["touches"] >= least]

    return pivots.select("symbol", "tf", "price", "pivot", "kind").groupBy("symbol", "tf").applyInPandas(run, _LEVEL)


def horizontal_levels(pivots: DataFrame, tolerance: float = 0.005, least: int = 2) -> DataFrame:
    """symbol, tf, side, rank, price, touches, strength, low, high: levels as support and as resistance, those of both kinds in both lists.

    Ranked by touches, then by price; 15 points of strength a touch, 100 at most; low and high bound the level's zone.
    """
    levels = cluster_levels(pivots, tolerance, least)
    sides = F.when(F.col("type") == "both", F.array(F.lit("support"), F.lit("resistance"))).otherwise(F.array("type"))
    order = Window.partitionBy("symbol", "tf", "side").orderBy(F.desc("touches"), "price")
    listed = levels.withColumn("side", F.explode(sides)).withColumn("rank", F.row_number().over(order))
    strength = F.least(F.lit(100.0), F.col("touches") * 15.0)
    return listed.select("symbol", "tf", "side", "rank", "price", "touches", strength.alias("strength"), (F.col("price") - F.col("width")).alias("low"), (F.col("price") + F.col("width")).alias("high"))


def detect_breakouts(levels: DataFrame, bars: DataFrame, last: int = 3) -> DataFrame:
    """A close beyond a level's zone in the last bars, with a close on the other side in the five before; the first for each level."""
    w = I.frame(-5, -1)
    ends = F.max("k").over(Window.partitionBy("symbol", "tf"))
    recent = bars.withColumns({"before_max": F.max("c").over(w), "before_min": F.min("c").over(w), "end": ends}).where(F.col("k") > F.col("end") - last)
    met = levels.join(recent.select("symbol", "tf", "k", "c", "before_max", "before_min").hint("merge"), ["symbol", "tf"])  # `last` bars of a series
    up = (F.col("c") > F.col("price") + F.col("width")) & (F.col("before_min") < F.col("price"))
    down = (F.col("c") < F.col("price") - F.col("width")) & (F.col("before_max") > F.col("price"))
    hit = met.withColumn("side", F.when(up, "up").when(down, "down")).where("side is not null")
    return hit.groupBy("symbol", "tf", "price", "width").agg(F.min("k").alias("k"), F.min_by("side", "k").alias("side"))


def best_levels(points: DataFrame, levels: DataFrame, x: Column, wanted: dict[str, tuple[Column, bool, bool]]) -> DataFrame:
    """`points` with, for each name, the greatest value of all levels of the series on one side of the price `x`.

    wanted: name to (value of a level, whether levels above count rather than those below, whether one at `x` counts). Points
    and levels are put in price order once a side; the best so far is a running maximum, so no point meets all levels and no
    frame looks forward. Prices go in bands that grow with the price, and a band takes the best of the bands before from
    one row for each band, so that a series is not one group.
    """
    key = ["symbol", "tf"]
    none = [value.alias(name) for name, (value, _, _) in wanted.items()]
    b = levels.select(*key, F.col("price").cast("double").alias("__x"), F.lit(0).alias("__side"), *none)
    kinds = dict(b.dtypes)
    a = points.select(*key, x.cast("double").alias("__x"), F.lit(1).alias("__side"), *(F.lit(None).cast(kinds[n]).alias(n) for n in wanted), F.struct("*").alias("__row"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__band", F.floor(F.log2(F.greatest("__x", F.lit(1e-9))) * 64))
    best, ends = {}, {}
    for name, (_, up, at) in wanted.items():
        by, side = (F.desc("__x") if up else F.asc("__x")), (F.asc("__side") if at else F.desc("__side"))
        best[name] = F.max(name).over(Window.partitionBy(*key, "__band").orderBy(by, side).rowsBetween(Window.unboundedPreceding, -1))
        bands = Window.partitionBy(*key).orderBy(F.desc("__band") if up else F.asc("__band"))
        ends[name] = F.max(f"__end_{name}").over(bands.rowsBetween(Window.unboundedPreceding, -1))
    lasts = both.groupBy(*key, "__band").agg(*(F.max(n).alias(f"__end_{n}") for n in wanted)).withColumns({f"__end_{n}": e for n, e in ends.items()})
    found = both.withColumns({f"__best_{n}": e for n, e in best.items()}).where("__side = 1").join(lasts.hint("merge"), [*key, "__band"])
    return found.select("__row.*", *(F.greatest(f"__best_{n}", f"__end_{n}").alias(n) for n in wanted))


def nearest_level(points: DataFrame, levels: DataFrame, direction: str = "any") -> DataFrame:
    """symbol, tf, k, c, level: the level nearest to each point of its series, by distance, then price; `direction` above or below: beyond the point alone."""
    price = F.col("price").cast("double")
    found = best_levels(points.select("symbol", "tf", "k", "c"), levels, F.col("c"), {"below": (price, False, direction == "any"), "above": (-price, True, False)})
    above, below = -F.col("above"), F.col("below")
    nearer = F.when(above.isNull() | (F.col("c") - below <= above - F.col("c")), below).otherwise(above)
    level = {"any": nearer, "above": above, "below": below}[direction]
    return found.select("symbol", "tf", "k", "c", level.alias("level")).where("level is not null")


def level_targets(points: DataFrame, levels: DataFrame, least_rr: float = 1.0) -> DataFrame:
    """`points` (with c and atr) with target_long and target_short: of the levels that lie `least_rr` ATRs or more beyond the price, the one of most touches, then of the least price."""
    rank = F.struct("touches", (-F.col("price").cast("double")).alias("p"))
    away = F.when(F.col("atr") > 0, F.col("atr") * least_rr)
    out = points
    for name, sign in (("target_long", 1), ("target_short", -1)):
        found = best_levels(out, levels, F.col("c") + sign * away, {name: (rank, sign > 0, True)})
        # without an ATR there is no risk to weigh, and a level at the very price is no target
        out = found.withColumn(name, F.when(away.isNotNull() & (F.col(name)["p"] * -sign > sign * F.col("c")), -F.col(name)["p"]))
    return out


def zones_of(points: DataFrame, zones: DataFrame, width: float = 1 / 64) -> DataFrame:
    """Points (symbol, tf, k, c) with each zone (low, high) of their series that holds c: an equi join on the bands of a zone's prices.

    Bands grow with the price, so a zone as wide as a share of its price touches few of them.
    """
    band = lambda x: F.floor(F.log2(F.greatest(F.col(x).cast("double"), F.lit(1e-9))) / width)
    spread = zones.withColumn("band", F.explode(F.sequence(band("low"), band("high"))))
    met = points.withColumn("band", band("c")).join(spread.hint("merge"), ["symbol", "tf", "band"])
    return met.where(F.col("c").between(F.col("low"), F.col("high"))).drop("band")


def as_of_join(left: DataFrame, right: DataFrame, key: str, on: str, values: list[str], span: int = 1000) -> DataFrame:
    """For each left row the latest right row at or before it.

    Both sides go to (key, day) buckets, or to buckets of `span` units where `on` is a number; a bucket starts from the last right row of the days before it, which a window over
    one row for each day gives. So one key that all rows have is dealt by day, and no task sorts all of them.
    """
    day = F.to_date(F.col(on)) if dict(left.dtypes)[on].startswith(("timestamp", "date")) else F.floor(F.col(on) / span)
    order = Window.partitionBy(key, "__day").orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    nothing = [F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in left.columns if c not in (key, on)]
    a = left.select(key, on, *[c for c in left.columns if c not in (key, on)], F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__v"), F.lit(1).alias("__side"))
    b = right.select(key, on, *nothing, F.struct(*values).alias("__v"), F.lit(0).alias("__side"))
    both = a.unionByName(b).withColumn("__day", day)
    own = F.last("__v", ignorenulls=True).over(order)
    lasts = both.groupBy(key, "__day").agg(F.max_by("__v", F.when(F.col("__side") == 0, F.col(on))).alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    lasts = lasts.select(key, "__day", before.alias("__before"))
    seen = both.withColumn("__x", own).where("__side = 1").alias("s").join(lasts.alias("d").hint("merge"), (F.col(f"s.{key}").eqNullSafe(F.col(f"d.{key}"))) & F.col("s.__day").eqNullSafe(F.col("d.__day")))
    return seen.select(*(F.col(f"s.{c}") for c in left.columns), F.coalesce("__x", "__before").alias("__x")).select(*left.columns, *(F.col(f"__x.{v}").alias(v) for v in values))
