"""Compositions: scan of all symbols at once, walk-forward backtest, and registration of user detectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from barlab.functions import folds
from barlab.operators import detect as D
from barlab.operators import features as G
from barlab.operators import outcomes as O
from barlab.operators import resample, score
from barlab.sources.bars import materialised


def all_signals(wide: DataFrame, tfs: Iterable[str], detectors: list[D.Detector] | None = None) -> DataFrame:
    """Signals of all patterns of some timeframes, those that are no predicate of the wide row too."""
    found = D.detect(wide, D.catalogue(tfs) if detectors is None else detectors)
    if detectors is None and "5min" in tfs:
        found = found.unionByName(D.power_hour(wide))
    return found


def scan(bars: DataFrame, per_symbol: int = 2, tfs: Iterable[str] | None = None) -> DataFrame:
    """Signals at each series' last bar, scored, merged over timeframes and ranked within symbols. `tfs` spares a look at the bars."""
    tfs = list(tfs) if tfs is not None else [r["tf"] for r in bars.select("tf").distinct().collect()]  # a handful of timeframes
    found = all_signals(D.wide(bars), tfs)
    newest = found.join(bars.groupBy("symbol", "tf").agg(F.max("ts").alias("ts")).hint("merge"), ["symbol", "tf", "ts"])
    scored = newest.withColumns(
        {"pattern_name": F.col("pattern"), "id": F.concat_ws("|", "symbol", "tf", "pattern"), "composite": F.round(F.col("confidence") * 70 + score.rr_quality(F.col("rr")) * 0.3, 6), "bucket": score.price_bucket_merge(F.col("entry") / 100)}
    )
    return score.top_per_symbol(score.merge_timeframes(scored), per_symbol, 0.0)


def seen_today(at: Column, now: Column) -> Column:
    """Whether a signal counts as today's: of this date, or of yesterday from 15:30 on."""
    late = F.hour(at) * 60 + F.minute(at) >= 930
    return (F.to_date(at) == F.to_date(now)) | ((F.to_date(at) == F.date_sub(F.to_date(now), 1)) & late)


def scored_scan(
    bars: DataFrame, benchmark: str, tfs: Iterable[str], detectors: list[D.Detector] | None = None, now: Column | None = None,
    edges: DataFrame | None = None, strategies: DataFrame | None = None, least_bars: int = 20,
) -> DataFrame:
    """Signals at each series' last bar with the seven factors of their score, merged over timeframes: the whole scan of all symbols.

    Features and regime are those of the series' last bar. now: only today's signals, as of then. edges, strategies: (pattern, edge) and
    (pattern, strategy); patterns without a row, or no table, are neutral at 50. Series of under `least_bars` bars are left out.
    """
    ends = bars.groupBy("symbol", "tf").agg(F.max("ts").alias("ts"), F.count("*").alias("bars")).where(F.col("bars") >= least_bars).drop("bars")
    found = all_signals(D.wide(bars), tfs, detectors).join(ends.hint("merge"), ["symbol", "tf", "ts"])
    if now is not None:
        found = found.where(seen_today(F.col("ts"), now))
    # a feature is called regime too
    made = G.feature_vector(bars, benchmark).drop("composite").withColumnsRenamed({x: f"f_{x}" for x in score.FEATURES})
    made = G.with_regime(made).select("symbol", "tf", "ts", F.col("regime").alias("market"), *(f"f_{x}" for x in score.FEATURES))
    met = found.join(made.hint("merge"), ["symbol", "tf", "ts"]).withColumn("kind", score.pattern_type(F.col("pattern")))
    for table, name in ((edges, "edge"), (strategies, "strategy")):
        # a row for each pattern of the catalogue at most; the signals are few too
        met = met.join(table.select("pattern", name).hint("merge"), "pattern", "left").fillna(50.0, [name]) if table is not None else met.withColumn(name, F.lit(50.0))
    met = met.withColumnRenamed("confidence", "sure").withColumnsRenamed({f"f_{x}": x for x in score.FEATURES})
    met = met.withColumns({"confidence": F.col("sure") * 100, "feature": score.typed_feature_score(F.col("kind")), "rr": score.rr_quality(F.col("rr"))})
    met = met.withColumn("regime", G.alignment(F.col("market"), F.col("kind")).cast("double"))
    scored = met.withColumns(
        {
            "composite": F.round(score.composite_score(), 1), "confidence": F.col("sure"), "pattern_name": F.col("pattern"),
            "id": F.concat_ws("|", "symbol", "tf", "pattern"), "bucket": score.price_bucket_merge(F.col("entry") / 100),
        }
    )
    return score.merge_timeframes(scored)


def walk_forward_backtest(bars: DataFrame, detectors: list[D.Detector] | None = None, tfs: Iterable[str] = ("1d",), days: int = 30) -> DataFrame:
    """Detect at scan bars, resolve all candidates, take those that do not overlap: trades with R and outcome.

    Bars are written once and read for the detectors, the scan's bars and the barriers. Slippage is by the window ATR; hold,
    cooldown and splits are the pattern's own; a pattern has one open trade at a time, on both sides where these share its name.
    """
    numbered = materialised(resample.with_index(bars.select("symbol", "tf", "ts", "o", "h", "l", "c", "v")))
    found = D.with_traits(all_signals(D.wide(numbered.drop("k")), tfs, detectors)).drop("atr")
    scans = O.with_window_atr(numbered)
    scans = O.scan_schedule(scans, days).select("symbol", "tf", "k", F.col("window_atr").alias("atr"))
    fields = ["symbol", "tf", "k", "bias", "entry", "stop", "t1", "t2", "pattern", "confidence", "splits", "family", "bucket", "cooldown", "hold", "atr"]
    candidates = found.join(scans.hint("merge"), ["symbol", "tf", "k"]).withColumns(
        {"bucket": score.price_bucket_cooldown(F.col("entry") / 100).cast("long"), "cooldown": O.bars_for(F.col("cooldown_minutes")), "hold": O.bars_for(F.col("hold_minutes"))}
    )
    candidates = materialised(O.apply_slippage(candidates).select(*fields))
    kept = ("pattern", "confidence", "family", "bucket", "cooldown")
    resolved = O.finalize_r(O.barrier_resolve(candidates.drop("atr"), numbered, F.col("hold"), "splits", kept))
    return O.select_non_overlapping(resolved, by="family")


def breakout_study(bars: DataFrame, hold: int = 20) -> DataFrame:
    """Channel breakouts on volume, labelled by first touch, with statistics by symbol and side: windows and joins only."""
    from barlab.functions import indicators as I

    high, low = I.donchian_high(20), I.donchian_low(20)
    df = resample.with_index(bars).withColumns({"high20": high, "low20": low, "loud": I.volume_confirm(1.2)})
    bias = F.when(F.col("c") > F.col("high20"), "long").when(F.col("c") < F.col("low20"), "short")
    sign = F.when(bias == "long", 1).otherwise(-1)
    span = F.greatest(F.col("high20") - F.col("low20"), F.lit(1))
    signals = df.withColumn("bias", bias).where(F.col("bias").isNotNull() & F.col("loud")).select("symbol", "tf", "k", "bias", F.col("c").alias("entry"), (F.col("c") - sign * span).alias("stop"), (F.col("c") + sign * span).alias("t1"), (F.col("c") + 2 * sign * span).alias("t2"))
    labelled = O.first_touch_label(signals, df.select("symbol", "tf", "k", "h", "l", "c"), hold)
    return labelled.groupBy("symbol", "bias").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "win").alias("wins"), F.count_if(F.col("label") == "loss").alias("losses"), F.sum("r").alias("total_r"))


def register_detector(name: str, tfs: tuple[str, ...], bars: int, bias: str, when: Column, stop: Column, t1: Column, t2: Column, confidence: Column) -> None:
    """A user's detector as Columns of the wide row; Catalyst plans it with all others."""
    unregister_detector(name)
    D.REGISTERED.append(D.Detector(name, tfs, bars, bias, when, stop, t1, t2, confidence))


def unregister_detector(name: str) -> None:
    D.REGISTERED[:] = [d for d in D.REGISTERED if d.name != name]


def series_detector(bars: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's sequential logic over one series at a time, in Arrow batches."""
    return bars.groupBy("symbol", "tf").applyInPandas(fn, schema)


def register_sql_functions(spark: SparkSession) -> None:
    """For SQL users: last_ema(array, p); the grouped aggregates ema(x, ts, p) and wilder_atr(h, l, c, ts, p); and the table function
    swings(TABLE(bars) PARTITION BY (symbol, tf) ORDER BY (ts) [, threshold]), whose rows are the confirmed zigzag swings of a series."""
    def last_ema(xs: pd.Series, p: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([folds.ema_first_seed(np.asarray(x, dtype=float), int(k))[-1] if x is not None and len(x) else None for x, k in zip(xs, p, strict=True)])

    def ema(x: pd.Series, ts: pd.Series, p: pd.Series) -> float:
        xs = x.to_numpy(dtype=float)[ts.to_numpy().argsort(kind="stable")]
        return float(folds.ema_first_seed(xs, int(p.iloc[0]))[-1])

    def wilder_atr(h: pd.Series, l: pd.Series, c: pd.Series, ts: pd.Series, p: pd.Series) -> float:  # noqa: E741
        by = ts.to_numpy().argsort(kind="stable")
        return float(folds.wilder_atr(*(x.to_numpy(dtype=float)[by] for x in (h, l, c)), int(p.iloc[0]))[-1])

    spark.udf.register("last_ema", F.pandas_udf(last_ema, DoubleType()))
    spark.udf.register("ema", F.pandas_udf(ema, DoubleType()))
    spark.udf.register("wilder_atr", F.pandas_udf(wilder_atr, DoubleType()))
    spark.udtf.register("swings", F.udtf(Swings))


class Swings:
    """Zigzag swings of one partition's rows, in order: swings(TABLE(bars) PARTITION BY (symbol, tf) ORDER BY (ts) [, threshold]).

    The threshold is a share of the price, by default the timeframe's. A partition keeps its running extreme alone, and a swing
    goes out at the bar that confirms it.
    """

    @staticmethod
    def analyze(row: AnalyzeArgument, threshold: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not row.isTable:
            raise ValueError("swings takes a table: swings(TABLE(bars) PARTITION BY (symbol, tf) ORDER BY (ts))")
        names = {f.name for f in row.dataType.fields}
        if lacking := {"symbol", "tf", "h", "l"} - names:
            raise ValueError(f"swings needs the columns {sorted(lacking)}")
        if threshold is not None and not (threshold.isConstantExpression and threshold.value is not None and 0 < float(threshold.value) < 1):
            raise ValueError("the threshold of swings is a constant between 0 and 1")
        # no session here, so no DDL
        kinds = {"symbol": StringType(), "tf": StringType(), "pivot": IntegerType(), "confirm": IntegerType(), "price": DoubleType(), "kind": StringType()}
        return AnalyzeResult(StructType([StructField(name, kind) for name, kind in kinds.items()]))

    def __init__(self):
        self._fold, self._of = None, ()

    def eval(self, row, threshold=None):
        if self._fold is None:
            self._of = (row["symbol"], row["tf"])
            self._fold = folds.ZigzagFold(float(threshold) if threshold is not None else folds.ZIGZAG.get(row["tf"], folds.ZIGZAG["1d"]))
        for swing in self._fold.push(float(row["h"]), float(row["l"])):
            yield (*self._of, *swing)

    def terminate(self):
        for swing in self._fold.finish() if self._fold else ():
            yield (*self._of, *swing)


def with_param_table(detect_rows: DataFrame, params: DataFrame) -> DataFrame:
    """Least confidence by pattern from a table of parameters; patterns without a row keep all."""
    joined = detect_rows.join(params.hint("merge"), "pattern", "left")
    return joined.where(F.col("least_confidence").isNull() | (F.col("confidence") >= F.col("least_confidence"))).drop("least_confidence")


def detectors_with_params(tfs: Iterable[str], params: DataFrame) -> list[D.Detector]:
    """The catalogue with the detectors' parameters from a short table (name, value); names that no detector has are an error."""
    given = {r["name"]: float(r["value"]) for r in params.select("name", "value").collect()}  # a row for each parameter
    sets = ((D.daily_detectors, D.DAILY_PARAMS), (D.swing_detectors, D.SWING_PARAMS), (D.intraday_detectors, D.INTRADAY_PARAMS))
    if unknown := set(given) - {name for _, known in sets for name in known}:
        raise ValueError(f"no such parameters: {sorted(unknown)}")
    made = {d.name: d for make, known in sets for d in make({k: v for k, v in given.items() if k in known})}
    return [made.get(d.name, d) for d in D.catalogue(tfs)]
