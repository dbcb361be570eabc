"""Signal detectors: Column predicates over one wide row per bar, so Catalyst sees all of them at once.

`wide` adds every column that a detector reads, in one shuffle by series: folds, frames, session and gap columns.
`detect` evaluates all detectors of the bars' timeframes, gates their candidates and gives one row for each signal.
A value at a bar never depends on a later bar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions import folds
from barlab.functions import indicators as I

# Parts of a position that go at the first target, at the second, and with the trail; by the start of a pattern's name.
DEFAULT_SPLITS = (0.5, 0.3, 0.2)
SPLITS = {
    "adx_stack_long": (0.40, 0.10, 0.50), "adx_stack_short": (0.25, 0.25, 0.50), "momentum_breakout": (0.50, 0.10, 0.40), "ts_momentum": (0.40, 0.40, 0.20), "multi_tf_trend": (0.25, 0.25, 0.50),
    "low_vol_long": (0.30, 0.30, 0.40), "turtle_breakout": (0.20, 0.10, 0.70), "bab_long": (0.30, 0.30, 0.40), "high_momentum_52w": (0.30, 0.30, 0.40), "rs_persistence_long": (0.30, 0.30, 0.40),
    "bb_squeeze_long": (0.50, 0.45, 0.05), "accumulation_long": (0.20, 0.10, 0.70), "distribution_short": (0.20, 0.10, 0.70),
}
# What the rest of a position trails, and by how much.
DEFAULT_TRAIL = ("atr", 2.0)
TRAILS = {
    "mean_reversion": ("vwap", 0.0), "trend_pullback": ("ema9", 9.0), "vwap_reversion": ("vwap", 2.0), "vwap_trend": ("atr", 1.0), "multi_tf_trend": ("atr", 3.0), "turtle_breakout": ("atr", 3.0),
    "bb_squeeze_long": ("atr", 2.5), "accumulation_long": ("atr", 1.0), "distribution_short": ("atr", 1.0),
}
# Minutes of cooldown and of the longest hold.
DEFAULT_MINUTES = (120, 600)
MINUTES = {
    "tidal_wave": (360, 480), "mean_reversion": (120, 240), "trend_pullback": (120, 240), "gap_fade": (480, 90), "vwap_reversion": (120, 240), "gap_reversal": (480, 240), "opening_drive": (480, 240),
    "volume_climax": (240, 240), "vwap_trend": (480, 240), "rsi_divergence": (240, 240), "midday_reversal": (480, 180), "power_hour": (480, 240), "keltner_breakout": (240, 480), "macd_turn": (240, 480),
    "vp_divergence": (240, 480), "momentum_breakout": (7200, 14400), "vol_compression_breakout": (7200, 14400), "range_expansion": (4320, 7200), "volume_breakout": (7200, 14400), "donchian_breakout": (7200, 14400),
    "adx_stack_long": (14400, 99000), "ts_momentum": (14400, 99000), "multi_tf_trend": (14400, 99000), "st_reversal": (7200, 14400), "low_vol_long": (14400, 99000), "turtle_breakout": (14400, 99000),
    "bab_long": (14400, 99000), "high_momentum_52w": (14400, 99000), "rs_persistence_long": (7200, 99000), "streak_reversal": (7200, 14400), "atr_expansion": (1440, 7200), "bb_squeeze": (7200, 99000),
    "accumulation_long": (7200, 99000), "distribution_short": (7200, 99000),
}
# Patterns whose two sides share one name, and so one open trade.
TWO_SIDED = ("mean_reversion", "trend_pullback", "gap_fade", "vwap_reversion", "vol_compression_breakout", "range_expansion", "volume_breakout", "donchian_breakout")


def _trait(pattern: Column, values: dict, default: Column, make: Callable) -> Column:
    """The value of the longest listed name that a pattern's name starts with."""
    out = F.when(F.lit(False), default)
    for name in sorted(values, key=len, reverse=True):
        out = out.when((pattern == name) | pattern.startswith(f"{name}_"), make(values[name]))
    return out.otherwise(default)


def with_traits(signals: DataFrame) -> DataFrame:
    """Signals with their pattern's splits, trail, trail_by, cooldown_minutes, hold_minutes, and `family`, the name its sides share."""
    pattern = F.col("pattern")
    array = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    minutes = _trait(pattern, MINUTES, F.array(*map(F.lit, DEFAULT_MINUTES)), lambda x: F.array(*map(F.lit, x)))
    shared = F.when(pattern.rlike("^(" + "|".join(TWO_SIDED) + ")_(long|short)$"), F.regexp_replace(pattern, "_(long|short)$", "")).otherwise(pattern)
    return signals.withColumns(
        {
            "splits": _trait(pattern, SPLITS, array(DEFAULT_SPLITS), array), "trail": _trait(pattern, TRAILS, F.lit(DEFAULT_TRAIL[0]), lambda x: F.lit(x[0])), "trail_by": _trait(pattern, TRAILS, F.lit(DEFAULT_TRAIL[1]), lambda x: F.lit(x[1])),
            "cooldown_minutes": minutes[0], "hold_minutes": minutes[1], "family": shared,
        }
    )


def setup_gate(candidates: DataFrame) -> DataFrame:
    """Candidates (bias, entry, stop, target, target_1, target_2, price, atr, confidence) that are fit to trade, with t1, t2 and rr.

    They need risk and 1 R to the target, and a price that has not run past the entry by more than half an ATR (1 % of the price where
    there is none). Targets of 0 or null are 1 R and the target; the confidence ends at 0.95.
    """
    risk, long = F.abs(F.col("entry") - F.col("stop")), F.col("bias") == "long"
    atr = F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.abs(F.col("price") * 0.01))
    rr = reward_to_risk(F.col("entry"), F.col("stop"), F.col("target"))
    late = F.when(long, F.col("price") > F.col("entry") + atr * 0.5).otherwise(F.col("price") < F.col("entry") - atr * 0.5)
    given = lambda x: F.nullif(F.col(x).cast("double"), F.lit(0.0))
    out = candidates.withColumns({"rr": rr, "t1": F.coalesce(given("target_1"), F.when(long, F.col("entry") + risk).otherwise(F.col("entry") - risk)), "t2": F.coalesce(given("target_2"), F.col("target")), "confidence": F.least(F.lit(0.95), F.col("confidence"))})
    return out.where((risk > 0) & (rr >= 1) & ~late)


#: Columns that most detectors read.
_COMMON = ("c", "o", "h", "l", "v", "atr", "vwap", "v20", "n")


def _common() -> tuple[Column, ...]:
    return tuple(F.col(x) for x in _COMMON)


@dataclass(frozen=True)
class Detector:
    """A pattern on some timeframes: condition, stop, two targets and confidence, all Columns of the wide row."""

    name: str
    tfs: tuple[str, ...]
    bars: int
    bias: str
    when: Column
    stop: Column
    t1: Column
    t2: Column
    confidence: Column


def wide(bars: DataFrame) -> DataFrame:
    """Bars with all columns of the detectors."""
    c, o, h, l, v, atr, vwap, v20, n = _common()  # noqa: E741
    df = folds.fold_series(bars)
    bb_mid, bb_std = I.sma(30), I.rolling_std(30)
    one = {
        "n": I.bars_so_far(), "prev": I.back("c", 1), "ret": I.pct_return(), "v20": F.avg("v").over(I.frame(-19)), "v50": F.avg("v").over(I.frame(-49)), "v30": F.avg("v").over(I.frame(-29)), "v10": F.avg("v").over(I.frame(-9)), "v78": F.avg("v").over(I.frame(-77)), "v6": F.avg("v").over(I.frame(-5)),
        "sma10": I.sma(10), "sma20": I.sma(20), "sma50": I.sma(50), "sma200": I.sma(200), "std50": I.rolling_std(50), "z50": I.zscore(50),
        **{f"hi{p}": F.max("h").over(I.frame(1 - p)) for p in (5, 10, 20, 252)}, **{f"lo{p}": F.min("l").over(I.frame(1 - p)) for p in (5, 10, 20)},
        **{f"hi{p}_before": I.donchian_high(p) for p in (9, 20, 30)}, **{f"lo{p}_before": I.donchian_low(p) for p in (9, 20, 30)},
        "range10": I.mean(h - l, -10, -1), "range19": I.mean(h - l, -19, -1), "squeeze": I.range_squeeze(), "exhausted": F.coalesce(I.volume_exhaustion(), F.lit(False)),
        "rising": I.higher_lows(), "falling": I.lower_highs(), "macd": F.col("emaf12") - F.col("emaf26"), "bb_upper": bb_mid + 2.25 * bb_std, "bb_lower": bb_mid - 2.25 * bb_std, "bandwidth": 4.5 * bb_std / bb_mid,
        "c10": I.back("c", 10), "c21": I.back("c", 21), "c62": I.back("c", 62), "c4": I.back("c", 4), "c164": I.back("c", 164), "v5": F.avg("v").over(I.frame(-4)), "v5_before": F.avg("v").over(I.frame(-9, -5)),
        "reds": F.count_if(c < o).over(I.frame(-3, -1)), "greens": F.count_if(c > o).over(I.frame(-3, -1)), "ema21_before": I.back("emaf21", 5), "atr30": F.avg("atr").over(I.frame(-16)), "day": F.to_date("ts"), "minute": I.minute_of_day(),
    }
    df = df.withColumns(one)
    sign = F.signum(c - F.col("prev"))
    months = [F.try_divide(I.back("c", 21 * j), I.back("c", 21 * (j + 1))) - 1 for j in range(1, 12)]
    two = {
        "vol60": F.when(n > 60, F.stddev_pop("ret").over(I.frame(-59)) * 252**0.5), "vol252": F.when(n > 252, F.stddev_pop("ret").over(I.frame(-251)) * 252**0.5),
        "bw_rank": I.bandwidth_rank(), "macd1": I.back("macd", 1), "macd2": I.back("macd", 2), "sign": F.coalesce(sign, F.lit(0.0)), "opened": I.session_open(),
        "day_bars": F.row_number().over(I.session()), "day_open": F.first("o").over(I.session()), "first_v": F.first("v").over(I.session()), "day_std": F.stddev_pop("c").over(I.session().rowsBetween(Window.unboundedPreceding, 0)), "n0": F.first("n").over(I.session()),
        "day_closes": F.collect_list(F.struct("c", "h", "l", "o", "v", "minute")).over(I.session().rowsBetween(Window.unboundedPreceding, 0)),
        "months": F.array(*months), "quiet": F.count_if(F.col("atr") < 0.7 * F.col("atr30")).over(I.frame(-9)), "closes20": F.collect_list("c").over(I.frame(-19)), "days": F.collect_list(F.struct((c > F.col("prev")).alias("up"), "v")).over(I.frame(-9)),
        "hs": F.collect_list("h").over(I.frame(-8)), "ls": F.collect_list("l").over(I.frame(-8)), "band": F.collect_list("c").over(I.frame(-4, -1)),
        "pre30": F.avg("v").over(I.frame(-30, -1)), "pre20": F.avg("v").over(I.frame(-20, -1)), "pre_all": F.avg("v").over(I.series().rowsBetween(Window.unboundedPreceding, -1)), "past60": F.percentile("atr", F.lit(0.5)).over(I.frame(-53, -14)),
    }
    df = df.withColumns(two)
    changed = F.when(F.col("sign") == F.lag("sign").over(I.series()), 0).otherwise(1)
    df = df.withColumn("vwap", I.session_vwap()).withColumn("turn", F.when(changed == 1, n)).withColumn("run", F.max("turn").over(I.series().rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("streak", F.least(F.lit(9), n - F.col("run") + 1) * F.col("sign"))
    at_open = lambda x: F.first(x).over(I.session())
    df = df.withColumns({"open_pre30": at_open("pre30"), "open_pre20": at_open("pre20"), "open_pre_all": at_open("pre_all"), "ratio40": F.when((n >= 19) & (F.col("past60") > 0), atr / F.col("past60")).otherwise(1.0)})
    hint = F.when(n < 50, "unknown").when((c > F.col("sma50")) & (F.col("ratio40") > 0.8), "trending_bull").when((c < F.col("sma50")) & (F.col("ratio40") > 0.8), "trending_bear").when(F.col("ratio40") < 0.6, "mean_reverting").otherwise("mixed")
    count = F.least(F.lit(11), F.floor((F.least(n, F.lit(252)) - 2) / 21)).cast("int")  # months that an index error would not end
    df = df.withColumn("hint", hint).withColumn("months_known", count).withColumn("months", F.slice("months", 1, F.greatest(count, F.lit(0))))
    df = df.withColumn("months_mean", _mean(F.col("months"))).withColumn("months_std", F.sqrt(_mean(F.transform("months", lambda x: (x - F.col("months_mean")) * (x - F.col("months_mean"))))))
    return _with_past_closes(df)


def _with_past_closes(df: DataFrame) -> DataFrame:
    """Last close of the calendar day before, and closes of the four weeks before: frames within the series, no join.

    The bar before a session's (week's) first one holds the close before it, and what that one knew before.
    """
    week = Window.partitionBy("symbol", "tf", "week").orderBy("ts")
    before = lambda x: F.lag(x, 1).over(I.series())
    df = df.withColumns({"week": F.trunc("day", "week"), "w0": F.col("c"), "day_before": before("day")})
    df = df.withColumns({"last_day": F.first("day_before").over(I.session()), "last_close": F.first("prev").over(I.session())})
    for k in range(1, 5):
        df = df.withColumn("__before", before(f"w{k - 1}")).withColumn(f"w{k}", F.first("__before").over(week)).drop("__before")
    return df.withColumn("yesterday", F.when(F.col("last_day") == F.date_sub("day", 1), F.col("last_close")))


def _offset(share: float) -> Column:
    return F.col("atr") * share


def _pair(name: str, tfs, bars: int, long: Column, short: Column, stops: tuple[Column, Column], t1: float, t2: float, confidence, targets=None) -> list[Detector]:
    """Twins with targets in ATRs unless given."""
    c, atr = F.col("c"), F.col("atr")
    conf = confidence if isinstance(confidence, tuple) else (confidence, confidence)
    out = []
    for k, (bias, when, sign) in enumerate((("long", long, 1), ("short", short, -1))):
        a, b = targets[k] if targets else (c + sign * t1 * atr, c + sign * t2 * atr)
        out.append(Detector(f"{name}_{bias}", tfs, bars, bias, when, stops[k], a, b, conf[k] if isinstance(conf[k], Column) else F.lit(conf[k])))
    return out


def _risk_targets(stop: Column) -> tuple[Column, Column]:
    c = F.col("c")
    return c + (c - stop), c + 2 * (c - stop)


def _swing_stops(mult: float = 2.0) -> tuple[Column, Column]:
    c, atr = F.col("c"), F.col("atr")
    return F.greatest(F.col("lo10").cast("double"), c - mult * atr) - _offset(0.1), F.least(F.col("hi10").cast("double"), c + mult * atr) + _offset(0.1)


def _risk_pair(name: str, tfs, bars: int, long: Column, short: Column, stops, confidence) -> list[Detector]:
    return _pair(name, tfs, bars, long, short, stops, 0, 0, confidence, targets=[_risk_targets(stops[0]), _risk_targets(stops[1])])


def _days(w: int, up: bool) -> Column:
    """Heavy days among the last w, against today's mean volume."""
    recent = F.slice("days", F.greatest(F.size("days") - w + 1, F.lit(1)), w)
    return F.size(F.filter(recent, lambda x: (x["v"] > F.col("v50")) & (F.coalesce(x["up"], F.lit(False)) == up)))


def _session(value: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    part = F.filter("day_closes", keep) if keep else F.col("day_closes")
    return F.transform(part, value)


def _mean(xs: Column) -> Column:
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs))


# Parameters of the daily patterns.
DAILY_PARAMS = {
    "adx_min": 35.0, "adx_min_short": 25.0, "vol_mult": 2.5, "volume_threshold": 3.0, "donchian_squeeze": 0.85, "momentum": 0.10, "reversal_z": 2.0, "turtle_squeeze": 0.80, "bab_vol": 0.35, "near_high": 0.05, "rs": 1.14, "streak": 5, "expansion": 1.8,
    "bw_rank": 0.19,
}


def daily_detectors(p: dict | None = None) -> list[Detector]:
    """Daily patterns; `p` overrides parameters by name."""
    c, o, h, l, v, atr, vwap, v20, n = _common()  # noqa: E741
    p = DAILY_PARAMS | (p or {})
    d = ("1d",)
    sma20, sma50, sma200, day_range = F.col("sma20"), F.col("sma50"), F.col("sma200"), h - l
    out: list[Detector] = []
    bonus = F.least(F.lit(0.10), (F.col("adx") - 25) / 500)
    heavy = F.when(F.col("v50") > 0, v20 / F.col("v50")).otherwise(1.0)
    weeks = [F.col(f"w{k}") for k in range(1, 5)]
    up4 = (c > weeks[0]) & (weeks[0] > weeks[1]) & (weeks[1] > weeks[2]) & (weeks[2] > weeks[3])
    down3 = (c < weeks[0]) & (weeks[0] < weeks[1]) & (weeks[1] < weeks[2])
    conf = 0.60 + bonus + F.least(F.lit(0.05), (heavy - 1) * 0.1) + F.when(F.col("hint") == "trending_bull", 0.08).otherwise(0.0)
    out += _pair("adx_stack", d, 60, (F.col("adx") >= p["adx_min"]) & (c > F.col("sma10")) & (F.col("sma10") > sma50) & F.col("rising") & up4 & (v20 >= F.col("v50")),
        (F.col("adx") >= p["adx_min_short"]) & (c < sma20) & (sma20 < sma50) & F.col("falling") & down3, (c - 2 * atr, c + 2 * atr), 2, 4, (conf, 0.60 + bonus))
    out.append(Detector("momentum_breakout", d, 50, "long", (c > F.col("hi30_before")) & (c >= sma50) & (v >= p["vol_mult"] * v20), c - 2 * atr, c + 2 * atr, c + 4.5 * atr, F.lit(0.58)))
    quiet = (atr <= 0.6 * F.col("atr30")) & (F.col("quiet") >= 5)
    out += _risk_pair("vol_compression_breakout", d, 30, quiet & (c > sma20), quiet & (c <= sma20), (sma20 - atr, sma20 + atr), 0.57 + F.when(v > 1.3 * v20, 0.05).otherwise(0.0))
    wide_day = (day_range >= 2 * F.col("range10")) & (v >= 1.3 * v20)
    out += _risk_pair("range_expansion", d, 20, wide_day & (c > o) & (c > sma20), wide_day & (c < o) & (c < sma20), _swing_stops(), 0.54)
    loud = v >= p["volume_threshold"] * v20
    out += _risk_pair("volume_breakout", d, 20, loud & (c > o), loud & (c < o), _swing_stops(), (F.when(c > sma20, 0.56).otherwise(0.51), F.when(c < sma20, 0.56).otherwise(0.51)))
    tight = F.coalesce(F.col("squeeze") <= p["donchian_squeeze"], F.lit(True))
    weak = F.when(v >= 1.5 * v20, 0.0).otherwise(0.05)
    out += _risk_pair("donchian_breakout", d, 50, tight & (c > F.col("hi20_before")), tight & (c < F.col("lo20_before")), _swing_stops(), (F.when(c > sma50, 0.55).otherwise(0.48) - weak, F.when(c < sma50, 0.55).otherwise(0.48) - weak))
    mom = F.try_divide(F.col("c4"), F.col("c164")) - 1
    alive = F.col("vol60") > 0
    out += _pair("ts_momentum", d, 165, alive & (mom > p["momentum"]), alive & (mom < -p["momentum"]), (c - 2 * atr, c + 2 * atr), 2, 4, 0.55 + F.least(F.abs(mom) / 0.30, F.lit(1.0)) * 0.10)
    vote = lambda a, b: F.when(F.col(a) > F.col(b), 1.0).otherwise(-1.0)
    votes = (vote("emaf20", "emaf50") + vote("emaf50", "emaf100") + vote("emaf100", "emaf200")) / 3
    lively = v >= 0.8 * v20
    out += _pair("multi_tf_trend", d, 200, lively & (votes >= 0.5), lively & (votes <= -0.5), (c - 3 * atr, c + 3 * atr), 2, 5, 0.55 + F.abs(votes) * 0.10)
    known = (F.col("months_known") >= 3) & (n - 1 >= 21 * (F.col("months_known") + 1)) & (F.col("months_std") > 0)
    z = F.try_divide(F.try_divide(c, F.col("c21")) - 1 - F.col("months_mean"), F.nullif(F.col("months_std"), F.lit(0.0)))
    half = F.abs(c - F.col("c21")) * 0.5
    conf = 0.55 + F.when(F.col("exhausted"), 0.05).otherwise(0.0) + F.least(F.lit(0.10), (F.abs(z) - p["reversal_z"]) * 0.05)
    out += _pair("st_reversal", d, 60, known & (z < -p["reversal_z"]), known & (z > p["reversal_z"]), (c - 1.5 * atr, c + 1.5 * atr), 0, 0, conf, targets=[(c + half, F.col("c21")), (c - half, F.col("c21"))])
    ratio = F.col("vol60") / F.col("vol252")
    out.append(Detector("low_vol_long", d, 253, "long", (ratio <= 0.75) & (F.col("vol60") > 0) & (c >= sma50) & (c >= sma200), c - 2 * atr, c + 2 * atr, c + 4 * atr, 0.58 + (0.75 - ratio) * 0.15))
    tight = F.coalesce(F.col("squeeze") <= p["turtle_squeeze"], F.lit(True))
    strong = v >= 2 * v20
    out += _pair("turtle_breakout", d, 60, tight & (c > F.col("hi30_before")), tight & (c < F.col("lo30_before")), (c - atr, c + atr), 2.5, 5.5, (F.when(strong, 0.58).otherwise(0.52), F.when(strong, 0.55).otherwise(0.50)))
    out.append(Detector("bab_long", d, 120, "long", (F.col("vol60") <= p["bab_vol"]) & (c >= sma50) & (c >= F.coalesce("sma200", "sma50")) & (c >= F.col("c62")), c - 2 * atr, c + 2 * atr, c + 4 * atr, 0.58 + (p["bab_vol"] - F.col("vol60")) * 0.20))
    below = F.try_divide(F.col("hi252") - c, F.col("hi252"))
    out.append(Detector("high_momentum_52w", d, 252, "long", (F.col("hi252") > 0) & (below <= p["near_high"]) & lively, c - 2.5 * atr, F.col("hi252"), F.col("hi252") + 2 * atr, 0.58 + (p["near_high"] - below) * 2))
    rs = c / sma50
    out.append(Detector("rs_persistence_long", d, 60, "long", (rs >= p["rs"]) & (c >= sma20), c - 2 * atr, c + 2 * atr, c + 4 * atr, 0.56 + F.when(v20 > F.col("v50"), 0.05).otherwise(0.0) + F.when(rs > 1.10, 0.05).otherwise(0.0)))
    run = F.abs("streak").cast("int")
    tail = lambda x: F.slice(x, F.greatest(F.size(x) - run + 1, F.lit(1)), F.greatest(run, F.lit(1)))
    conf = 0.55 + F.least(F.lit(0.10), (run - p["streak"]) * 0.03)
    out += _pair("streak_reversal", d, 10, F.col("streak") <= -p["streak"], F.col("streak") >= p["streak"], (F.array_min(tail(F.col("ls"))) - _offset(0.1), F.array_max(tail(F.col("hs"))) + _offset(0.1)), 1, 2, conf)
    place, grown = F.coalesce(F.try_divide(c - l, F.nullif(day_range, F.lit(0))), F.lit(0.5)), F.try_divide(day_range, F.nullif(F.col("range19"), F.lit(0.0)))
    big = (grown >= p["expansion"]) & (v >= 1.3 * v20)
    out += _pair("atr_expansion", d, 30, big & (place > 0.65), big & (place < 0.35), (l - _offset(0.1), h + _offset(0.1)), 1.5, 3, 0.56 + F.least(F.lit(0.10), (grown - p["expansion"]) * 0.05))
    few = F.col("bw_rank") <= p["bw_rank"]
    out += _pair("bb_squeeze", d, 130, few & (c > F.col("bb_upper")), few & (c < F.col("bb_lower")), (c - atr, c + atr), 0, 0, (0.58, 0.56), targets=[(c + 3 * atr, c + 8 * atr), (c - 2 * atr, c - 4 * atr)])
    many = (_days(7, True) >= 5) & (_days(7, False) <= 1)
    selling = ~many & (_days(10, False) >= 3) & (_days(10, True) <= 1)
    base = F.coalesce("sma50", "c")
    out.append(Detector("accumulation_long", d, 30, "long", many & (c >= base), c - 3.25 * atr, c + 3.75 * atr, c + 7 * atr, 0.56 + F.least(F.lit(0.08), (_days(7, True) - 5) * 0.03)))
    out.append(Detector("distribution_short", d, 30, "short", selling & (c <= base), c + 3.25 * atr, c - 3.75 * atr, c - 7 * atr, 0.52 + F.least(F.lit(0.08), (_days(10, False) - 3) * 0.02)))
    return out


#: Parameters of the 15-minute and hourly patterns, and of the 5-minute ones.
SWING_PARAMS = {"keltner_atr": 2.0, "keltner_squeeze": 0.80, "keltner_volume": 1.5, "divergence_volume": 0.60, "divergence_move": 0.02}
INTRADAY_PARAMS = {
    "mean_reversion_z": 2.5, "pullback_near": 0.3, "gap_fade": 0.02, "vwap_far": 2.0, "vwap_sigma": 2.0, "gap_reversal_least": 0.005, "gap_reversal_most": 0.03,
    "gap_reversal_retrace": 0.3, "drive_atr": 0.5, "drive_volume": 1.3, "climax_volume": 4.0, "vwap_trend_long": 0.75, "vwap_trend_short": 0.25, "vwap_trend_tests": 2.0,
    "vwap_trend_near": 0.4, "rsi_long": 40.0, "rsi_short": 60.0, "midday_atr": 1.0, "midday_retrace": 0.3,
}


def swing_detectors(p: dict | None = None) -> list[Detector]:
    """15-minute and hourly patterns; `p` overrides parameters by name."""
    p = SWING_PARAMS | (p or {})
    c, o, h, l, v, atr, vwap, v20, n = _common()  # noqa: E741
    tfs = ("15min", "1h")
    wide_by = p["keltner_atr"] * atr
    upper, lower, mid = F.col("emaf20") + wide_by, F.col("emaf20") - wide_by, F.col("emaf20")
    ready = F.exists("band", lambda x: (x > lower) & (x < upper)) & F.coalesce((F.col("squeeze") <= p["keltner_squeeze"]) | (n < 25), F.lit(True)) & (v >= p["keltner_volume"] * v20)
    out = _pair("keltner_breakout", tfs, 30, ready & (c > upper), ready & (c < lower), (mid - _offset(0.1), mid + _offset(0.1)), 1.5, 3, 0.58)
    m, m1, m2 = F.col("macd"), F.col("macd1"), F.col("macd2")
    out += _pair("macd_turn", tfs, 35, (m2 > m1) & (m > m1) & (m > 0) & (m1 < 0), (m2 < m1) & (m < m1) & (m < 0) & (m1 > 0), (F.col("lo5") - _offset(0.1), F.col("hi5") + _offset(0.1)), 1.5, 3, 0.55)
    move, thin = c / F.col("c10") - 1, F.col("v5") < p["divergence_volume"] * F.col("v5_before")
    out += _pair("vp_divergence", tfs, 20, thin & (move < -p["divergence_move"]) & (c <= 1.005 * F.col("lo10")), thin & (move > p["divergence_move"]) & (c >= 0.995 * F.col("hi10")), (F.col("lo5") - _offset(0.1), F.col("hi5") + _offset(0.1)), 1, 2, 0.55)
    return out


def intraday_detectors(p: dict | None = None) -> list[Detector]:
    """5-minute patterns; `p` overrides parameters by name."""
    p = INTRADAY_PARAMS | (p or {})
    c, o, h, l, v, atr, vwap, v20, n = _common()  # noqa: E741
    f, minute, hint = ("5min",), F.col("minute"), F.col("hint")
    bull, bear = hint == "trending_bull", hint == "trending_bear"
    calm = ~(bull | bear)
    mult = lambda good, bad: F.when(good, 1.1).when(bad, 0.9).otherwise(1.0)
    out: list[Detector] = []
    goal = F.when(vwap > 0, vwap).otherwise(c - F.col("z50") * F.col("std50"))
    conf = (0.58 + F.when(F.col("exhausted"), 0.05).otherwise(0.0)) * mult(hint == "mean_reverting", bull | bear)
    z, ok = F.col("z50"), hint.isin("mean_reverting", "mixed")
    out += _pair("mean_reversion", f, 50, ok & (z < -p["mean_reversion_z"]), ok & (z > p["mean_reversion_z"]), (F.least(F.col("lo10").cast("double"), c - atr) - atr, F.greatest(F.col("hi10").cast("double"), c + atr) + atr), 0, 0, conf, targets=[(c + (goal - c) / 2, goal), (c - (c - goal) / 2, goal)])
    slope, near = F.col("emaf21") - F.col("ema21_before"), F.abs(c - F.col("emaf21")) <= p["pullback_near"] * atr
    stops = (F.col("lo5") - _offset(0.1), F.col("hi5") + _offset(0.1))
    out += _pair("trend_pullback", f, 30, bull & (slope > 0) & near & (F.col("hi10") - F.col("lo5") >= atr) & F.coalesce(c >= vwap, F.lit(True)) & (F.col("reds") > 0) & (c > o),
        bear & (slope < 0) & near & (F.col("hi5") - F.col("lo10") >= atr) & F.coalesce(c <= vwap, F.lit(True)) & (F.col("greens") > 0) & (c < o), stops, 0, 0, (0.60 * mult(bull, F.lit(False)), 0.58 * mult(bear, F.lit(False))),
        targets=[(2 * c - stops[0], F.greatest(F.col("hi20").cast("double"), 3 * c - 2 * stops[0])), (2 * c - stops[1], F.least(F.col("lo20").cast("double"), 3 * c - 2 * stops[1]))])
    prior, first = F.col("yesterday"), F.col("day_open")
    gap = first - prior
    share = gap / prior
    first3 = _mean(F.slice(_session(lambda x: x["v"].cast("double")), 1, 3))
    fade = calm & minute.between(570, 630) & (F.abs(share) >= p["gap_fade"]) & F.coalesce(first3 <= 3 * F.col("open_pre_all"), F.lit(True))
    out += _pair("gap_fade", f, 10, fade & (gap < 0) & (c > first), fade & (gap > 0) & (c < first), (first - 0.5 * F.abs(gap), first + 0.5 * F.abs(gap)), 0, 0, 0.55, targets=[((first + prior) / 2, prior), ((first + prior) / 2, prior)])
    spread = F.col("day_std")  # of the closes' distances to the VWAP too, as one VWAP is taken off all of them
    sigma = F.try_divide(c - vwap, F.nullif(spread, F.lit(0.0)))
    far = calm & minute.between(630, 840) & (F.col("day_bars") >= 10) & (F.abs(c - vwap) >= p["vwap_far"] * atr)
    out += _pair("vwap_reversion", f, 30, far & (sigma < -p["vwap_sigma"]), far & (sigma > p["vwap_sigma"]), (F.col("lo10") - _offset(0.2), F.col("hi10") + _offset(0.2)), 0, 0, conf, targets=[(vwap - spread, vwap), (vwap + spread, vwap)])
    turned = minute.between(585, 630) & F.abs(share).between(p["gap_reversal_least"], p["gap_reversal_most"])
    mild = F.coalesce(F.col("first_v") <= 3 * F.col("open_pre20"), F.lit(True))
    out += _pair("gap_reversal", f, 20, turned & (gap <= 0) & (c - first >= p["gap_reversal_retrace"] * F.abs(gap)), turned & (gap > 0) & (first - c >= p["gap_reversal_retrace"] * F.abs(gap)) & mild, (first - _offset(0.1), first + _offset(0.1)), 0, 0, 0.55, targets=[((c + prior) / 2, prior), ((c + prior) / 2, prior)])
    six = F.slice("day_closes", 1, 6)
    drive = F.element_at(six, -1)["c"] - first
    volume6 = F.aggregate(six, F.lit(0).cast("long"), lambda a, x: a + x["v"])
    driven = minute.between(600, 615) & (F.col("day_bars") >= 6) & (F.abs(drive) >= p["drive_atr"] * atr) & ((F.col("n0") <= 31) | (volume6 >= p["drive_volume"] * 6 * F.col("open_pre30")))
    low6, high6 = F.array_min(F.transform(six, lambda x: x["l"])), F.array_max(F.transform(six, lambda x: x["h"]))
    out += _pair("opening_drive", f, 20, driven & (drive > 0), driven & (drive < 0), (low6 - _offset(0.1), high6 + _offset(0.1)), 1, 2, 0.56)
    climax = minute.between(585, 930) & (v >= p["climax_volume"] * F.col("v30"))
    conf = 0.56 + F.least(F.lit(0.10), (F.try_divide(v, F.nullif(F.col("v30"), F.lit(0.0))) - 3) * 0.02)
    at_high, at_low = (h >= 0.998 * F.col("hi20")) & (c < o), (l <= 1.002 * F.col("lo20")) & (c > o)
    out += _pair("volume_climax", f, 30, climax & at_low & ~at_high, climax & at_high, (l - _offset(0.1), h + _offset(0.1)), 1, 2, conf)
    above = F.size(F.filter("day_closes", lambda x: x["c"] > vwap)) / F.col("day_bars")
    tests = F.size(F.filter("day_closes", lambda x: ((F.abs(x["l"] - vwap) < 0.3 * atr) & (x["c"] > vwap)) | ((F.abs(x["h"] - vwap) < 0.3 * atr) & (x["c"] < vwap))))
    along = minute.between(630, 870) & (F.col("day_bars") >= 24) & (tests >= p["vwap_trend_tests"]) & (F.abs(c - vwap) <= p["vwap_trend_near"] * atr)
    out += _pair("vwap_trend", f, 40, along & (above > p["vwap_trend_long"]) & (c > vwap), along & (above < p["vwap_trend_short"]) & (c < vwap), (vwap - _offset(0.15), vwap + _offset(0.15)), 1, 2, 0.57)
    now, before = folds.rsi_wilder(F.col("closes20")), folds.rsi_wilder(F.slice("closes20", 1, 15))
    soft = minute.between(585, 930) & (v <= 1.2 * F.col("v10")) & (F.size("closes20") == 20)
    out += _pair("rsi_divergence", f, 30, soft & (l < F.col("lo9_before")) & (now > before) & (now < p["rsi_long"]), soft & (h > F.col("hi9_before")) & (now < before) & (now > p["rsi_short"]), (l - _offset(0.1), h + _offset(0.1)), 1, 2, 0.55)
    morning = F.filter("day_closes", lambda x: x["minute"] < 690)
    last = F.try_element_at(morning, F.lit(-1))["c"]
    move = last - first
    noon = minute.between(690, 750) & (F.size(morning) >= 10) & (F.abs(move) >= p["midday_atr"] * atr)
    out += _pair("midday_reversal", f, 30, noon & (move < 0) & (c - last >= p["midday_retrace"] * F.abs(move)), noon & (move > 0) & (last - c >= p["midday_retrace"] * move), (F.array_min(F.transform(morning, lambda x: x["l"])) - _offset(0.05), F.array_max(F.transform(morning, lambda x: x["h"])) + _offset(0.05)), 1, 2, 0.55)
    return out


def catalogue(tfs: Iterable[str]) -> list[Detector]:
    """The detectors of some timeframes."""
    wanted = set(tfs)
    return [d for d in [*daily_detectors(), *swing_detectors(), *intraday_detectors(), *REGISTERED] if wanted & set(d.tfs)]


#: Detectors that users have registered.
REGISTERED: list[Detector] = []


def reward_to_risk(entry: Column, stop: Column, target: Column) -> Column:
    """Reward over risk to two places, as a setup is judged; null without risk."""
    return F.round(F.abs(target - entry) / F.nullif(F.abs(entry - stop), F.lit(0.0)), 2)


def gated(candidates: Column) -> Column:
    """Candidates with risk, and 1 R to the second target as `setup_gate` measures it. Their entry is the price, which so has not run past it."""
    return F.filter(candidates, lambda x: x["pattern"].isNotNull() & (reward_to_risk(x["entry"], x["stop"], x["t2"]) >= 1))


def detect(wide_bars: DataFrame, detectors: list[Detector]) -> DataFrame:
    """symbol, tf, ts, k, pattern, bias, entry, stop, t1, t2, rr, confidence of every signal at every bar."""
    c, atr, n = F.col("c"), F.col("atr"), F.col("n")

    def candidate(d: Detector) -> Column:
        fires = F.col("tf").isin(*d.tfs) & (n >= d.bars) & (atr > 0) & d.when
        number = lambda x: x.cast("double")
        return F.when(fires, F.struct(F.lit(d.name).alias("pattern"), F.lit(d.bias).alias("bias"), number(c).alias("entry"), number(d.stop).alias("stop"), number(d.t1).alias("t1"), number(d.t2).alias("t2"), F.least(F.lit(0.95), d.confidence).cast("double").alias("confidence")))

    found = wide_bars.select("symbol", "tf", "ts", (n - 1).alias("k"), "atr", F.inline(gated(F.array_compact(F.array(*map(candidate, detectors))))))
    return found.withColumn("rr", F.abs(F.col("t2") - F.col("entry")) / F.abs(F.col("entry") - F.col("stop")))


def power_hour(wide_bars: DataFrame, block_days: int = 16, band: float = 1 / 512) -> DataFrame:
    """Share of all afternoon closes so far above the current VWAP, at bars from 14:00 to 14:30.

    Closes are counted by block of days and price band. An asked bar adds up the bands above its own over the blocks before its
    own, from running counts, and meets single closes only in its block, and in its band of the blocks before. So its work grows with the
    number of bands, and with the closes in one narrow band, not with the whole history.
    """
    atr, n = F.col("atr"), F.col("n")
    block = F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-01")) / block_days)
    of = lambda x: F.floor(F.log2(F.greatest(x.cast("double"), F.lit(1e-9))) / band).cast("long")
    asked = wide_bars.where(F.col("minute").between(840, 870) & F.col("vwap").isNotNull() & (n >= 30) & (atr > 0) & (F.col("v6") >= 1.2 * F.col("v78")))
    asked = asked.select("symbol", "tf", "ts", (n - 1).alias("k"), "c", "atr", "vwap", block.alias("block"), of(F.col("vwap")).alias("at"))
    past = wide_bars.where(F.col("minute") >= 780).select("symbol", "tf", F.col("ts").alias("pts"), F.col("c").alias("pc"), block.alias("pblock"), of(F.col("c")).alias("pat"))
    key, mine = ["symbol", "tf"], ["symbol", "tf", "ts", "k", "c", "atr", "vwap"]
    # the own block, close by close
    near = asked.join(past.withColumnRenamed("pblock", "block").hint("merge"), [*key, "block"]).where(F.col("pts") <= F.col("ts"))
    near = near.select(*mine, F.lit(1).cast("long").alias("m"), (F.col("pc") > F.col("vwap")).cast("long").alias("above"))
    # the own band of earlier blocks, close by close; of equal closes one row with its number
    closes = past.groupBy(*key, "pblock", "pat", "pc").agg(F.count("*").alias("w"))
    edge = asked.join(closes.withColumnRenamed("pat", "at").hint("merge"), [*key, "at"]).where(F.col("pblock") < F.col("block"))
    edge = edge.select(*mine, F.lit(0).cast("long").alias("m"), F.when(F.col("pc") > F.col("vwap"), F.col("w")).otherwise(0).cast("long").alias("above"))
    # bands above, and all closes, of earlier blocks: running counts at the blocks that are asked about
    counts = closes.groupBy(*key, "pat", F.col("pblock").alias("block")).agg(F.sum("w").alias("w"))
    blocks = asked.select(*key, "block").distinct()
    wanted = blocks.join(counts.select(*key, "pat").distinct().hint("merge"), key).select(*key, "pat", "block", F.lit(0).cast("long").alias("w"), F.lit(True).alias("asked"))
    running = F.sum("w").over(Window.partitionBy(*key, "pat").orderBy("block").rangeBetween(Window.unboundedPreceding, -1))
    held = counts.withColumn("asked", F.lit(False)).select(*key, "pat", "block", "w", "asked").unionByName(wanted).withColumn("before", F.coalesce(running, F.lit(0))).where("asked")
    higher = F.sum("before").over(Window.partitionBy(*key, "block").orderBy(F.desc("pat")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("before").over(Window.partitionBy(*key, "block"))
    steps = held.withColumns({"higher": higher, "total": total}).groupBy(*key, "block").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("pat", "higher"))).alias("steps"))
    upper = F.try_element_at(F.filter("steps", lambda x: x["pat"] > F.col("at")), F.lit(1))["higher"]
    far = asked.join(steps.hint("merge"), [*key, "block"]).select(*mine, F.col("total").cast("long").alias("m"), F.coalesce(upper, F.lit(0)).cast("long").alias("above"))
    shares = near.unionByName(edge).unionByName(far).groupBy(*mine).agg(F.sum("m").alias("m"), (F.sum("above") / F.sum("m")).alias("share"))
    bias = F.when(F.col("share") > 0.70, "long").when(F.col("share") < 0.30, "short")
    sign = F.when(F.col("share") > 0.70, 1).otherwise(-1)
    out = shares.where((F.col("m") >= 10) & bias.isNotNull()).select(
        "symbol", "tf", "ts", "k", "atr", F.concat(F.lit("power_hour_"), bias).alias("pattern"), bias.alias("bias"), F.col("c").cast("double").alias("entry"), (F.col("vwap") - sign * 0.1 * F.col("atr")).alias("stop"),
        (F.col("c") + sign * 0.5 * F.col("atr")).alias("t1"), (F.col("c") + sign * F.col("atr")).alias("t2"), F.lit(0.55).alias("confidence"),
    )
    entry, stop, target = F.col("entry"), F.col("stop"), F.col("t2")
    return out.where(reward_to_risk(entry, stop, target) >= 1).withColumn("rr", F.abs(target - entry) / F.abs(entry - stop))
