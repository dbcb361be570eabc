"""Scores, merging and ranking of setups, position sizes, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators.stats import clip
from barlab.sources.bars import materialised

#: A pattern's name as a key that is never null.
_PATTERN = ("__pattern", "__unnamed")

# Weights of the features by strategy type, and of the composite.
FEATURES = ("momentum", "volatility", "vol_compression", "volume", "trend", "breakout", "mean_reversion", "regime")
FEATURE_WEIGHTS = (0.18, 0.10, 0.12, 0.15, 0.15, 0.12, 0.08, 0.10)
TYPE_WEIGHTS = {
    "momentum": (0.30, 0.10, 0.10, 0.0, 0.25, 0.15, 0.0, 0.10),
    "mean_reversion": (0.05, 0.15, 0.10, 0.0, 0.05, 0.05, 0.45, 0.15),
    "breakout": (0.15, 0.10, 0.25, 0.0, 0.10, 0.30, 0.0, 0.10),
    "short_term": (0.20, 0.20, 0.15, 0.0, 0.15, 0.15, 0.05, 0.10),
}
DEFAULT_WEIGHTS = (0.20, 0.12, 0.14, 0.0, 0.18, 0.14, 0.10, 0.12)
COMPOSITE = {"confidence": 0.20, "feature": 0.22, "strategy": 0.18, "regime": 0.15, "edge": 0.10, "volume": 0.10, "rr": 0.05}


# Strategy type by the start of a pattern's name.
PATTERN_TYPES = {
    "momentum": (
        "trend_pullback", "opening_drive", "vwap_trend", "power_hour", "macd_turn", "momentum_breakout", "donchian_breakout", "adx_stack", "ts_momentum",
        "multi_tf_trend", "low_vol_long", "bab_long", "high_momentum_52w", "rs_persistence_long", "accumulation_long", "distribution_short",
    ),
    "mean_reversion": (
        "mean_reversion", "gap_fade", "vwap_reversion", "gap_reversal", "volume_climax", "rsi_divergence", "midday_reversal", "vp_divergence", "st_reversal", "streak_reversal",
    ),
    "breakout": ("keltner_breakout", "vol_compression_breakout", "range_expansion", "volume_breakout", "turtle_breakout", "atr_expansion", "bb_squeeze"),
    "short_term": ("tidal_wave",),
}


def pattern_type(pattern: Column) -> Column:
    """Strategy type of a pattern; breakout for one that is not listed."""
    out = F.when(F.lit(False), "")
    for kind, names in PATTERN_TYPES.items():
        for name in names:
            out = out.when((pattern == name) | pattern.startswith(f"{name}_"), kind)
    return out.otherwise("breakout")


def rr_quality(rr: Column) -> Column:
    """Piecewise linear through (1, 0), (1.5, 35), (2, 60), (2.5, 80), (3, 100), from 10 just above 1; 40 if unknown."""
    return (
        F.when(rr.isNull(), 40.0).when(rr >= 3, 100.0).when(rr >= 2.5, 80 + (rr - 2.5) * 40).when(rr >= 2, 60 + (rr - 2) * 40)
        .when(rr >= 1.5, 35 + (rr - 1.5) * 50).when(rr >= 1, 10 + (rr - 1) * 50).otherwise(0.0)
    )


def typed_feature_score(kind: Column) -> Column:
    """Weighted mean of the features by strategy type, volume left out."""
    def weighted(weights) -> Column:
        total = sum(weights)
        return sum((F.col(f) * w for f, w in zip(FEATURES, weights, strict=True) if w), F.lit(0.0)) / total

    out = F.when(F.lit(False), F.lit(0.0))
    for name, weights in TYPE_WEIGHTS.items():
        out = out.when(kind == name, weighted(weights))
    return out.otherwise(weighted(DEFAULT_WEIGHTS))


def composite_score() -> Column:
    return clip(sum((F.col(k) * w for k, w in COMPOSITE.items()), F.lit(0.0)))


def price_bucket(price: Column) -> Column:
    """For setups: five above 200, two above 50, one above 10, else a tenth; half to even."""
    step = F.when(price > 200, 5.0).when(price > 50, 2.0).when(price > 10, 1.0).otherwise(0.1)
    return F.round(F.bround(price / step) * step, 6)


def price_bucket_cooldown(price: Column) -> Column:
    """For cooldowns: whole units, half to even."""
    return F.bround(price)


def price_bucket_merge(price: Column) -> Column:
    """For merging timeframes: tens above 50, else units; half to even."""
    return F.when(price > 50, F.bround(price / 10) * 10).otherwise(F.bround(price))


def merge_timeframes(setups: DataFrame) -> DataFrame:
    """One setup for each (symbol, pattern, bias, bucket): the best, raised if several timeframes agree."""
    best = F.max_by(F.struct("id", "composite", "confidence", "tf"), F.struct("composite", "id"))
    out = setups.groupBy("symbol", "pattern_name", "bias", "bucket").agg(best.alias("x"), F.count_distinct("tf").alias("tfs"), F.array_join(F.array_sort(F.collect_set("tf")), " & ").alias("label"))
    multi = F.col("tfs") > 1
    return out.select(
        "symbol", "pattern_name", "bias", "bucket", "x.id", F.when(multi, F.least(F.lit(100.0), F.col("x.composite") + 5)).otherwise(F.col("x.composite")).alias("composite"),
        F.when(multi, F.least(F.lit(0.95), F.col("x.confidence") + 0.10)).otherwise(F.col("x.confidence")).alias("confidence"), multi.alias("multi_tf"), "label",
    )


def top_per_symbol(setups: DataFrame, k: int = 2, floor: float = 45.0) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("composite"), "id")
    return setups.where(F.col("composite") >= floor).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_per_day(setups: DataFrame, held: DataFrame, n: int = 5) -> DataFrame:
    """The best n of each day, one a symbol, none of those held."""
    free = setups.join(held, "symbol", "left_anti")
    one = free.withColumn("a", F.row_number().over(Window.partitionBy("day", "symbol").orderBy(F.desc("composite"), "id"))).where("a = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("composite"), "id"))).where(F.col("rank") <= n).drop("a")


def explain_score() -> tuple[Column, Column]:
    """Names of the factors at 70 or more, and at 30 or less."""
    parts = F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).cast("double").alias("v")) for k in COMPOSITE))
    names = lambda test: F.array_join(F.transform(F.filter(parts, test), lambda x: x["k"]), ",")
    return names(lambda x: x["v"] >= 70), names(lambda x: x["v"] <= 30)


def apply_verdicts(setups: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Outside verdicts: the delta clamped to 15, to 2 or 5 on thin volume, and kept in keeping with the verdict."""
    joined = setups.join(verdicts, "id", "left")
    delta = F.greatest(F.lit(-15.0), F.least(F.lit(15.0), F.col("delta")))
    signed = F.when(F.col("verdict") == "CONFIRMED", F.greatest(delta, F.lit(0.0))).when(F.col("verdict") == "DENIED", F.least(delta, F.lit(0.0))).otherwise(delta)
    cap = F.when(F.col("volume") < 30, 2.0).when(F.col("volume") < 50, 5.0).otherwise(15.0)
    final = F.when(F.col("delta").isNull(), 0.0).otherwise(F.least(cap, signed))  # least() would skip a null
    return joined.withColumns({"verdict": F.coalesce("verdict", F.lit("PENDING")), "delta": final, "final": clip(F.col("composite") + final)})


def risk_flags(conditions: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in conditions.items())))


def position_size(account: float, risk_pct: float, modifier: Column, cap: float = 0.15) -> dict[str, Column]:
    """Whole shares by risk, at most a share of the account, with warnings."""
    risk = F.abs(F.col("entry") - F.col("stop"))
    by_risk = F.floor(F.try_divide(account * risk_pct * modifier, F.nullif(risk, F.lit(0.0))))
    by_cap = F.floor(F.try_divide(F.lit(account * cap), F.col("entry")))
    shares = F.coalesce(F.greatest(F.lit(0), F.least(by_risk, by_cap)), F.lit(0)).cast("long")
    warnings = risk_flags({"no risk": risk == 0, "capped": by_risk > by_cap, "no shares": shares == 0})
    return {"shares": shares, "risk_amount": shares * risk, "warnings": F.array_join(warnings, ",")}


def portfolio_heat(positions: DataFrame, budget: float) -> DataFrame:
    value, long = F.col("shares") * F.col("entry"), F.col("bias") == "long"
    sums = positions.groupBy("account").agg(
        F.sum(F.col("shares") * F.abs(F.col("entry") - F.col("stop"))).alias("heat"), F.sum(F.when(long, value).otherwise(0)).alias("long_value"), F.sum(F.when(~long, value).otherwise(0)).alias("short_value")
    )
    return sums.withColumns({"net": F.col("long_value") - F.col("short_value"), "gross": F.col("long_value") + F.col("short_value"), "left": F.lit(budget) - F.col("heat"), "can_add": F.col("heat") < budget})


def strategy_multiplier() -> Column:
    """From the win rate of all earlier trades: 0.3 to 0.7 onto 0.5 to 2, once there are ten."""
    before = Window.partitionBy("pattern_name").orderBy("closed_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    n, wins = F.count("*").over(before), F.count_if(F.col("r_milli") > 0).over(before)
    return F.when(n >= 10, F.greatest(F.lit(0.5), F.least(F.lit(2.0), 0.5 + (wins / n - 0.3) / 0.4 * 1.5))).otherwise(1.0)


def recency_multiplier(trades: DataFrame, chunk: int = 65_536) -> DataFrame:
    """id and multiplier: a pattern's last 20 trades count twice against those of the last 200; 1 under 50 trades.

    Trades are numbered along their pattern in two levels, by day and then within days, and dealt out in chunks of these numbers; a
    chunk begins with the 200 trades before it. The sums are differences of running ones, so a trade costs the same whatever the span. A chunk is
    of 200 trades at least.
    """
    day = [*_PATTERN, "__day"]
    keyed = trades.select("id", "closed_at", "r_milli", F.coalesce("pattern_name", F.lit("")).alias("__pattern"), F.col("pattern_name").isNull().alias("__unnamed"), F.to_date("closed_at").alias("__day"))
    keyed = materialised(keyed)
    earlier = F.sum("__n").over(Window.partitionBy(*_PATTERN).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    days = keyed.groupBy(*day).agg(F.count("*").alias("__n")).select(*day, F.coalesce(earlier, F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy(*day).orderBy("closed_at", "id"))
    numbered = keyed.join(days.hint("merge"), day).select("id", "r_milli", *_PATTERN, (F.col("__base") + within - 1).alias("k"))
    own = F.floor(F.col("k") / chunk)
    twice = F.when(F.col("k") % chunk >= chunk - 200, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = numbered.withColumns({"__own": own, "__chunk": F.explode(twice)})
    along = Window.partitionBy(*_PATTERN, "__chunk").orderBy("k")
    dealt = dealt.withColumn("__sum", F.coalesce(F.sum("r_milli").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dealt = dealt.withColumns({"__sum20": F.lag("__sum", 20, 0).over(along), "__sum200": F.lag("__sum", 200, 0).over(along)}).where("__chunk = __own")
    n, recent = F.least(F.col("k"), F.lit(200)), F.least(F.col("k"), F.lit(20))
    edge = F.try_divide(2 * (F.col("__sum") - F.col("__sum20")) + F.col("__sum20") - F.col("__sum200"), recent + n) / 1000.0
    multiplier = F.when(n < 50, 1.0).when(edge >= 0.15, 1.25).when(edge >= 0, 1.0).when(edge >= -0.1, 0.75).when(edge >= -0.3, 0.5).otherwise(0.25)
    return dealt.select("id", multiplier.alias("multiplier"))


def drawdown_multiplier(drawdown_pct: Column) -> Column:
    return F.when(drawdown_pct >= 15, 0.25).when(drawdown_pct >= 10, 0.5).when(drawdown_pct >= 5, 0.75).otherwise(1.0)
