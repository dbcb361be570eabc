"""Features from 0 to 100, market regime, relative strength: all as of each bar, on one window pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions import folds
from barlab.functions import indicators as I
from barlab.operators.score import FEATURE_WEIGHTS
from barlab.operators.stats import clip

#: How well a strategy type suits a regime; others 50.
ALIGNMENT = {
    ("trending_bull", "momentum"): 90, ("trending_bull", "breakout"): 80, ("trending_bull", "mean_reversion"): 35, ("trending_bull", "short_term"): 60,
    ("trending_bear", "momentum"): 75, ("trending_bear", "breakout"): 55, ("trending_bear", "mean_reversion"): 40, ("trending_bear", "short_term"): 65,
    ("mean_reverting", "momentum"): 35, ("mean_reverting", "breakout"): 40, ("mean_reverting", "mean_reversion"): 90, ("mean_reverting", "short_term"): 70,
    ("high_volatility", "momentum"): 40, ("high_volatility", "breakout"): 60, ("high_volatility", "mean_reversion"): 55, ("high_volatility", "short_term"): 80,
}


def inputs(bars: DataFrame, benchmark: str) -> DataFrame:
    """Bars with ATR ratio, EMAs and the benchmark's close and means at the same time (an equi join)."""
    df = folds.fold_series(bars, ("atr", "ema9", "ema21")).withColumn("ret", I.log_return())
    past = F.percentile("atr", F.lit(0.5)).over(I.frame(-73, -14))
    valid = F.count("atr").over(I.series().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("atr_ratio", F.when((valid >= 19) & (past > 0), F.col("atr") / past).otherwise(1.0)).withColumn("n", I.bars_so_far())
    ref = bars.where(F.col("symbol") == benchmark).withColumns({"bc": F.col("c"), "b20": I.sma(20), "b50": I.sma(50), "blag": I.back("c", 20)}).select("tf", "ts", "bc", "b20", "b50", "blag")
    return df.join(ref.hint("merge"), ["tf", "ts"], "left")


def scores() -> dict[str, Column]:
    n, c = F.col("n"), F.col("c")
    roc = lambda k: clip((I.roc(k) + 0.10) / 0.20 * 100)
    fifty = F.lit(50.0)
    weights = F.when(n > 60, 0.2 * roc(5) + 0.3 * roc(20) + 0.5 * roc(60)).when(n > 20, 0.3 * roc(5) + 0.7 * roc(20)).otherwise(roc(5))
    vol = F.try_divide(F.stddev_pop("ret").over(I.frame(-9)), F.nullif(F.stddev_pop("ret").over(I.frame(-59)), F.lit(0.0)))
    loud, z = F.try_divide(F.avg("v").over(I.frame(-2)), F.nullif(F.avg("v").over(I.frame(-22, -3)), F.lit(0.0))), I.zscore(20)
    near, far = I.range_position(20), F.when(n > 50, I.range_position(50))
    above = [F.col("ema9"), F.col("ema21"), I.sma(50), I.sma(200)]
    held = sum((F.when(c > x, 25.0).otherwise(0.0) for x in above), F.lit(0.0))
    possible = sum((F.when(x.isNotNull(), 25.0).otherwise(0.0) for x in above), F.lit(0.0))
    bench = F.when(F.col("bc").isNull() | F.col("b50").isNull(), 50.0).when((F.col("bc") > F.col("b20")) & (F.col("bc") > F.col("b50")) & (F.col("bc") > F.col("blag")), 80.0).when(F.col("bc") > F.col("b50"), 55.0).when((F.col("bc") < F.col("b20")) & (F.col("bc") < F.col("b50")), 25.0).otherwise(50.0)
    return {
        "momentum": F.when(n < 10, fifty).otherwise(weights),
        "volatility": F.when((n < 25) | vol.isNull(), fifty).otherwise(clip((vol - 0.3) / 1.7 * 100)),
        "vol_compression": F.when(n < 30, fifty).otherwise(clip((1.5 - F.col("atr_ratio")) / 1.1 * 100)),
        "volume": F.when((n < 15) | loud.isNull(), fifty).otherwise(clip(F.sqrt(loud) * 50)),
        "trend": F.when(n < 10, fifty).otherwise(F.try_divide(held * 100, F.nullif(possible, F.lit(0.0)))),
        "breakout": F.when(n < 22, fifty).otherwise(F.coalesce(0.6 * near + 0.4 * far, near, far, fifty)),
        "mean_reversion": F.when((n < 22) | z.isNull(), fifty).otherwise(clip(F.abs(z) / 3 * 100)),
        "regime": bench,
    }


def feature_vector(bars: DataFrame, benchmark: str) -> DataFrame:
    made = inputs(bars, benchmark).withColumns(scores())
    total = sum((F.col(k) * w for k, w in zip(scores(), FEATURE_WEIGHTS, strict=True)), F.lit(0.0))
    return made.withColumn("composite", total)


def detect_regime(bars: DataFrame, benchmark: str) -> DataFrame:
    """High volatility first, then trend by side and slope of the 200-bar mean, else mean reverting."""
    return with_regime(inputs(bars, benchmark))


def with_regime(df: DataFrame) -> DataFrame:
    """The regime of rows that `inputs` made."""
    df = df.withColumns({"sma50": I.sma(50), "sma200": I.sma(200)})
    anchor = F.coalesce("sma200", "sma50")
    df = df.withColumn("anchor", anchor)
    slope = F.try_divide(F.col("anchor"), F.lag("anchor", 19).over(I.series())) - 1
    regime = (
        F.when((F.col("n") < 30) | F.col("anchor").isNull(), "mean_reverting").when(F.col("atr_ratio") > 1.8, "high_volatility").when((F.col("c") > F.col("anchor")) & (slope > 0.005), "trending_bull")
        .when((F.col("c") < F.col("anchor")) & (slope < -0.005), "trending_bear").otherwise("mean_reverting")
    )
    return df.withColumns({"slope": slope, "regime": regime})


def alignment(regime: Column, kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for (r, k), x in ALIGNMENT.items():
        out = out.when((regime == r) & (kind == k), x)
    return out.otherwise(50)


def relative_strength(bars: DataFrame, benchmark: str) -> DataFrame:
    """By symbol and session: returns of both, their spread, and how often bars move alike, aligned from the end."""
    last = Window.partitionBy("symbol", "day").orderBy(F.desc("ts"))
    moves = bars.withColumn("day", F.to_date("ts")).withColumns({"rn": F.row_number().over(last), "move": F.signum(F.col("c") - F.col("o"))})
    day = moves.groupBy("symbol", "day").agg(((F.max_by("c", "ts") / F.min_by("o", "ts") - 1) * 100).alias("ret"), F.count("*").alias("n"))
    ref_moves = moves.where(F.col("symbol") == benchmark).select("day", "rn", F.col("move").alias("bmove"))
    ref_day = day.where(F.col("symbol") == benchmark).select("day", F.col("ret").alias("bret"))
    alike = moves.join(ref_moves.hint("merge"), ["day", "rn"]).groupBy("symbol", "day").agg((F.avg((F.col("move") == F.col("bmove")).cast("double")) * 100).alias("agreement"))
    out = day.where(F.col("n") >= 3).join(ref_day.hint("merge"), "day").join(alike.hint("merge"), ["symbol", "day"])
    return out.withColumns({"spread": F.col("ret") - F.col("bret"), "grade": corr_grade(F.col("agreement")), "label": corr_label(F.col("ret"), F.col("bret"))})


def corr_grade(agreement: Column) -> Column:
    """A for a series that goes its own way, F for one that follows the benchmark."""
    return F.when(agreement <= 30, "A").when(agreement <= 45, "B").when(agreement <= 60, "C").when(agreement <= 75, "D").otherwise("F")


# Bounds and words of the labels.
def corr_label(ret: Column, bench: Column) -> Column:
    """One of nine labels from the two returns in percent; moves within 0.05 are none."""
    up, down, bench_up, bench_down = ret > 0.05, ret < -0.05, bench > 0.05, bench < -0.05
    both_up = F.when(ret > bench + 0.3, "Outperforming").when(ret < bench - 0.3, "Lagging").otherwise("In Line")
    both_down = F.when(F.abs(ret) < F.abs(bench) * 0.6, "Holding Up").when(F.abs(ret) > F.abs(bench) * 1.5, "Underperforming").otherwise("In Line")
    label = F.when(up & bench_down, "Relative Strength").when(down & bench_up, "Relative Weakness").when(up & bench_up, both_up).when(down & bench_down, both_down).otherwise("Neutral")
    return F.when(ret.isNull() | bench.isNull(), "No data").otherwise(label)
