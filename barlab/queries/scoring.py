"""B, L and M: scalar expressions, scores, merging, sizing. Setups come from the closed trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.operators import perf, score
from barlab.queries.sql import CLOSED, DAILY, HOURLY
from barlab.sources import bars as store
from barlab.sources import fixtures

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_TYPES = [*score.TYPE_WEIGHTS, "other"]


def setups(spark, sf_dir: str) -> DataFrame:
    """Setups with factor scores in whole numbers made from a trade's keys."""
    t = store.history_union(fixtures.trades(spark, sf_dir), fixtures.TRADE_TIES)
    n = lambda a, b: ((F.col("l_partkey") * a + F.col("l_suppkey") * b) % 101).cast("double")
    made = {name: n(3 + i, 7 + 2 * i) for i, name in enumerate(score.FEATURES)}
    t = t.withColumns(made).withColumns({"confidence": n(5, 3), "feature": n(11, 2), "strategy": n(2, 13), "edge": n(7, 7), "rr": n(9, 4)})
    return t.withColumns(
        {
            "kind": F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("l_partkey") % 5 + 1).cast("int")), "tf": F.element_at(F.array(*map(F.lit, ("5min", "15min", "1h"))), (F.col("l_suppkey") % 3 + 1).cast("int")),
            "entry": (F.col("l_partkey") % 250 + 10).cast("double"), "stop": (F.col("l_partkey") % 250 + 5 + F.col("l_suppkey") % 5).cast("double"), "day": F.to_date("closed_at"),
        }
    )


def _f(a: int, b: int) -> str:
    return f"((l_partkey * {a} + l_suppkey * {b}) % 101)::DOUBLE"


SETUPS = f"""{CLOSED}, setups AS (SELECT *, {', '.join(f'{_f(3 + i, 7 + 2 * i)} AS {n}' for i, n in enumerate(score.FEATURES) if n != 'regime')}, {_f(10, 21)} AS regime_score, {_f(5, 3)} AS confidence, {_f(11, 2)} AS feature, {_f(2, 13)} AS strategy, {_f(7, 7)} AS edge, {_f(9, 4)} AS rr,
  {_TYPES}[l_partkey % 5 + 1] AS kind, ['5min', '15min', '1h'][l_suppkey % 3 + 1] AS tf, (l_partkey % 250 + 10)::DOUBLE AS entry, (l_partkey % 250 + 5 + l_suppkey % 5)::DOUBLE AS stop, closed_at::DATE AS day FROM closed)"""
_COL = {f: ("regime_score" if f == "regime" else f) for f in (*score.FEATURES, *score.COMPOSITE)}


def _add(name: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(setups(spark, sf_dir))
    ORACLE_SQL[name] = f"WITH {SETUPS} {sql}"


def _weighted(weights) -> str:
    return "(" + " + ".join(f"{_COL[f]} * {w}::DOUBLE" for f, w in zip(score.FEATURES, weights, strict=True) if w) + f") / {sum(weights)!r}::DOUBLE"


COMPOSITE = "greatest(0, least(100, " + " + ".join(f"{_COL[k]} * {w}::DOUBLE" for k, w in score.COMPOSITE.items()) + "))"
r6 = lambda x, name: F.round(x, 6).alias(name)

_add("typed_feature_score", lambda s: s.select("id", r6(score.typed_feature_score(F.col("kind")), "score")),
    f"SELECT id, round(CASE kind {' '.join(f'''WHEN '{k}' THEN {_weighted(w)}''' for k, w in score.TYPE_WEIGHTS.items())} ELSE {_weighted(score.DEFAULT_WEIGHTS)} END, 6) AS score FROM setups")
_add("feature_composite", lambda s: s.select("id", r6(sum((F.col(f) * w for f, w in zip(score.FEATURES, score.FEATURE_WEIGHTS, strict=True)), F.lit(0.0)), "score")), f"SELECT id, round({' + '.join(f'{_COL[f]} * {w}::DOUBLE' for f, w in zip(score.FEATURES, score.FEATURE_WEIGHTS, strict=True))}, 6) AS score FROM setups")
_add("composite_score", lambda s: s.select("id", r6(score.composite_score(), "composite")), f"SELECT id, round({COMPOSITE}, 6) AS composite FROM setups")
_add("score_batch", lambda s: s.select("id", r6(score.composite_score(), "composite")), f"SELECT id, round({COMPOSITE}, 6) AS composite FROM setups")
_names = lambda test: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_COL[k]} {test} THEN '{k}' END" for k in score.COMPOSITE) + "], lambda x: x IS NOT NULL), ',')"
_add("explain_score", lambda s: s.select("id", score.explain_score()[0].alias("strengths"), score.explain_score()[1].alias("weaknesses")), f"SELECT id, {_names('>= 70')} AS strengths, {_names('<= 30')} AS weaknesses FROM setups")
_add("rr_quality", lambda s: s.select("id", r6(score.rr_quality(F.when(F.col("rr") < 90, F.col("rr") / 25)), "quality")),
    "SELECT id, round(CASE WHEN q IS NULL THEN 40 WHEN q >= 3 THEN 100 WHEN q >= 2.5 THEN 80 + (q - 2.5) * 40 WHEN q >= 2 THEN 60 + (q - 2) * 40 WHEN q >= 1.5 THEN 35 + (q - 1.5) * 50 WHEN q >= 1 THEN 10 + (q - 1) * 50 ELSE 0 END, 6) AS quality FROM (SELECT id, CASE WHEN rr < 90 THEN rr / 25 END AS q FROM setups)")
_BUCKET = "round(round_even(p / st, 0) * st, 6)"
_add("price_bucket", lambda s: s.withColumn("p", F.col("entry") * 0.37).select("id", score.price_bucket(F.col("p")).alias("bucket"), score.price_bucket_cooldown(F.col("p")).alias("cooldown_bucket"), score.price_bucket_merge(F.col("p")).alias("merge_bucket")),
    f"""SELECT id, {_BUCKET} AS bucket, round_even(p, 0) AS cooldown_bucket, CASE WHEN p > 50 THEN round_even(p / 10, 0) * 10 ELSE round_even(p, 0) END AS merge_bucket
      FROM (SELECT id, p, CASE WHEN p > 200 THEN 5.0::DOUBLE WHEN p > 50 THEN 2 WHEN p > 10 THEN 1 ELSE 0.1 END AS st FROM (SELECT id, entry * 0.37::DOUBLE AS p FROM setups))""")
_add("r_multiple", lambda s: s.select("id", r6(F.try_divide(F.when(F.col("bias") == "long", F.col("feature") - F.col("entry")).otherwise(F.col("entry") - F.col("feature")), F.nullif(F.abs(F.col("entry") - F.col("stop")), F.lit(0.0))), "r")),
    "SELECT id, round((CASE WHEN bias = 'long' THEN feature - entry ELSE entry - feature END) / nullif(abs(entry - stop), 0), 6) AS r FROM setups")
_add("risk_reward", lambda s: s.withColumn("q", r6(F.try_divide(F.abs(F.col("edge") - F.col("entry")), F.nullif(F.abs(F.col("entry") - F.col("stop")), F.lit(0.0))), "q")).where("q >= 1").select("id", "q"),
    "SELECT * FROM (SELECT id, round(abs(edge - entry) / nullif(abs(entry - stop), 0), 6) AS q FROM setups) WHERE q >= 1")


def _merged(s: DataFrame) -> DataFrame:
    return score.merge_timeframes(s.withColumns({"composite": F.round(score.composite_score(), 6), "confidence": F.col("confidence") / 128, "bucket": score.price_bucket_merge(F.col("entry"))}))


_BK = "CASE WHEN entry > 50 THEN round_even(entry / 10.0::DOUBLE, 0) * 10 ELSE round_even(entry, 0) END"
_add("merge_timeframes", lambda s: _merged(s).select("symbol", "pattern_name", "bias", "bucket", "id", r6(F.col("composite"), "composite"), r6(F.col("confidence"), "confidence"), "multi_tf", "label"),
    f", m AS (SELECT symbol, pattern_name, bias, {_BK} AS bucket, arg_max({{'id': id, 'c': cs, 'f': confidence / 128}}, (cs, id)) AS x, count(DISTINCT tf) AS tfs, string_agg(DISTINCT tf, ' & ' ORDER BY tf) AS label FROM (SELECT *, round({COMPOSITE}, 6) AS cs FROM setups) GROUP BY ALL) "
    "SELECT symbol, pattern_name, bias, bucket, x.id, round(CASE WHEN tfs > 1 THEN least(100, x.c + 5) ELSE x.c END, 6) AS composite, round(CASE WHEN tfs > 1 THEN least(0.95, x.f + 0.10::DOUBLE) ELSE x.f END, 6) AS confidence, tfs > 1 AS multi_tf, label FROM m")
_CS = f", cs AS (SELECT *, round({COMPOSITE}, 6) AS composite FROM setups)"
_scored = lambda s: s.withColumn("composite", F.round(score.composite_score(), 6))
_add("top_per_symbol", lambda s: score.top_per_symbol(_scored(s)).select("symbol", "id", "composite"), f"{_CS} SELECT symbol, id, composite FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY composite DESC, id) AS rk FROM cs WHERE composite >= 45) WHERE rk <= 2")
_add("top_per_day", lambda s: score.top_per_day(_scored(s), s.where("symbol IN ('S1', 'S2', 'S3')").select("symbol").distinct()).select("day", "symbol", "id", "composite"),
    f"{_CS}, o AS (SELECT *, row_number() OVER (PARTITION BY day, symbol ORDER BY composite DESC, id) AS a FROM cs WHERE symbol NOT IN ('S1', 'S2', 'S3')), p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY composite DESC, id) AS b FROM o WHERE a = 1) SELECT day, symbol, id, composite FROM p WHERE b <= 5")


def _verdicts(s: DataFrame) -> DataFrame:
    v = s.where("regime < 2").select("id", F.when(F.col("strategy") > 50, "CONFIRMED").otherwise("DENIED").alias("verdict"), (F.col("feature") - 50).alias("delta"))
    return score.apply_verdicts(_scored(s).select("id", "composite", "volume"), v).select("id", "verdict", "delta", F.round("final", 6).alias("final"))


_LOW = f"{_f(10, 21)} < 2"
_add("apply_verdicts", _verdicts,
    f"{_CS}, v AS (SELECT *, {_LOW} AS judged, CASE WHEN strategy > 50 THEN 'CONFIRMED' ELSE 'DENIED' END AS vd, greatest(-15, least(15, feature - 50)) AS d0 FROM cs), w AS (SELECT *, CASE WHEN judged THEN least(CASE WHEN volume < 30 THEN 2 WHEN volume < 50 THEN 5 ELSE 15 END, CASE WHEN vd = 'CONFIRMED' THEN greatest(d0, 0) ELSE least(d0, 0) END) ELSE 0 END::DOUBLE AS dl FROM v) "
    "SELECT id, CASE WHEN judged THEN vd ELSE 'PENDING' END AS verdict, dl AS delta, round(greatest(0, least(100, composite + dl)), 6) AS final FROM w")
def _merged_sources(s: DataFrame) -> DataFrame:
    """Every setup is tracked or fresh, by its day; fresh ones go where a tracked one of equal symbol, pattern and side stands."""
    named = s.select("id", "symbol", "pattern_name", "bias", (F.dayofmonth("day") % 2).alias("role"))
    tracked, fresh = named.where("role = 0").drop("role"), named.where("role = 1").drop("role")
    return tracked.unionByName(fresh.join(tracked.select("symbol", "pattern_name", "bias").hint("merge"), ["symbol", "pattern_name", "bias"], "left_anti"))


_add(
    "merge_tracked_and_fresh",
    _merged_sources,
    ", x AS (SELECT id, symbol, pattern_name, bias, day(day) % 2 AS role FROM setups), a AS (SELECT * FROM x WHERE role = 0) SELECT id, symbol, pattern_name, bias FROM a "
    "UNION ALL SELECT id, symbol, pattern_name, bias FROM x WHERE role = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.symbol = x.symbol AND a.pattern_name = x.pattern_name AND a.bias = x.bias)",
)
_add(
    "enrich_opportunities",
    lambda s: s.select("id", "symbol", "tf").join(perf.performance(s, "symbol", "tf").select("symbol", "tf", "total").hint("merge"), ["symbol", "tf"], "left"),
    ", p AS (SELECT symbol, tf, sum(r_milli)::BIGINT AS total FROM setups GROUP BY ALL) SELECT s.symbol, tf, id, total FROM setups s LEFT JOIN p USING (symbol, tf)",
)
_add("risk_flags", lambda s: s.withColumn("f", score.risk_flags({"thin volume": F.col("volume") < 20, "weak trend": F.col("trend") < 30, "poor edge": F.col("edge") < 40, "low rr": F.col("rr") < 25})).select("id", F.array_join("f", ",").alias("flags"), F.size("f").cast("long").alias("n")),
    ", r AS (SELECT id, list_filter([CASE WHEN volume < 20 THEN 'thin volume' END, CASE WHEN trend < 30 THEN 'weak trend' END, CASE WHEN edge < 40 THEN 'poor edge' END, CASE WHEN rr < 25 THEN 'low rr' END], lambda x: x IS NOT NULL) AS f FROM setups) SELECT id, array_to_string(f, ',') AS flags, len(f) AS n FROM r")
_add("filter_setups", lambda s: _scored(s).where((F.col("bias") == "long") & F.col("kind").isin("momentum", "breakout") & (F.col("composite") >= 50)).select("id", "kind", "composite"),
    f"{_CS} SELECT id, kind, composite FROM cs WHERE bias = 'long' AND kind IN ('momentum', 'breakout') AND composite >= 50")
_add("alert_format", lambda s: s.select("id", F.format_string("%s %s %s: entry %.2f, stop %.2f", "symbol", F.upper("bias"), "pattern_name", "entry", "stop").alias("alert")), "SELECT id, printf('%s %s %s: entry %.2f, stop %.2f', symbol, upper(bias), pattern_name, entry, stop) AS alert FROM setups")
_sized = lambda s: s.withColumns(score.position_size(25000.0, 0.01, F.when(F.col("regime") < 50, 0.5).otherwise(1.0)))
_SIZE = f", z AS (SELECT *, abs(entry - stop) AS rk, floor(250.0::DOUBLE * CASE WHEN {_f(10, 21)} < 50 THEN 0.5 ELSE 1 END / nullif(abs(entry - stop), 0)) AS br, floor(3750.0::DOUBLE / entry) AS bc FROM setups), zz AS (SELECT *, coalesce(greatest(0, least(br, bc)), 0)::BIGINT AS shares FROM z)"
_SIZE = _SIZE.replace("coalesce(greatest(0, least(br, bc)), 0)", "CASE WHEN br IS NULL THEN bc ELSE greatest(0, least(br, bc)) END")
_add("position_size", lambda s: _sized(s).select("id", "shares", r6(F.col("risk_amount"), "risk_amount"), "warnings"),
    f"{_SIZE} SELECT id, shares, round(shares * rk, 6) AS risk_amount, array_to_string(list_filter([CASE WHEN rk = 0 THEN 'no risk' END, CASE WHEN br > bc THEN 'capped' END, CASE WHEN shares = 0 THEN 'no shares' END], lambda x: x IS NOT NULL), ',') AS warnings FROM zz")
_add("portfolio_heat", lambda s: score.portfolio_heat(_sized(s).withColumn("account", F.col("l_suppkey") % 5), 1e6).select("account", "heat", "long_value", "short_value", "net", "gross", "left", "can_add"),
    f"{_SIZE}, h AS (SELECT l_suppkey % 5 AS account, sum(shares * rk) AS heat, sum(CASE WHEN bias = 'long' THEN shares * entry ELSE 0 END) AS lv, sum(CASE WHEN bias <> 'long' THEN shares * entry ELSE 0 END) AS sv FROM zz GROUP BY 1) SELECT account, heat, lv AS long_value, sv AS short_value, lv - sv AS net, lv + sv AS gross, 1000000 - heat AS \"left\", heat < 1000000 AS can_add FROM h")
_W = "OVER (PARTITION BY pattern_name ORDER BY closed_at, id ROWS BETWEEN {} PRECEDING AND {} PRECEDING)"
_add("strategy_multiplier", lambda s: s.select("id", r6(score.strategy_multiplier(), "multiplier")),
    f", w AS (SELECT id, count(*) {_W.format('UNBOUNDED', 1)} AS n, count(*) FILTER (r_milli > 0) {_W.format('UNBOUNDED', 1)} AS w FROM setups) SELECT id, round(CASE WHEN n >= 10 THEN greatest(0.5, least(2.0, 0.5::DOUBLE + (w::DOUBLE / n - 0.3::DOUBLE) / 0.4::DOUBLE * 1.5::DOUBLE)) ELSE 1 END, 6) AS multiplier FROM w")

def _recency(spark, sf_dir: str) -> DataFrame:
    """Only what it reads goes through the union: ids, results and what orders them."""
    known = fixtures.trades(spark, sf_dir).select("id", "pattern_name", "r_milli", "closed_at", "src_rank", *fixtures.TRADE_TIES)
    return score.recency_multiplier(store.history_union(known, fixtures.TRADE_TIES))


QUERIES["recency_multiplier"] = _recency
ORACLE_SQL["recency_multiplier"] = (
    f"WITH {SETUPS} , w AS (SELECT id, count(*) {_W.format(200, 1)} AS n, (2 * sum(r_milli) {_W.format(20, 1)} + sum(r_milli) {_W.format(200, 21)})::DOUBLE / (2 * count(*) {_W.format(20, 1)} + count(*) {_W.format(200, 21)}) / 1000.0::DOUBLE AS e FROM setups) "
    "SELECT id, (CASE WHEN n < 50 THEN 1.0 WHEN e >= 0.15 THEN 1.25 WHEN e >= 0 THEN 1 WHEN e >= -0.1 THEN 0.75 WHEN e >= -0.3 THEN 0.5 ELSE 0.25 END)::DOUBLE AS multiplier FROM w"
)
_add("drawdown_multiplier", lambda s: perf.drawdown(s).select("day", score.drawdown_multiplier(F.col("drawdown") / 1000).alias("multiplier")),
    ", e AS (SELECT day, (sum(sum(r_milli)) OVER (ORDER BY day))::BIGINT AS q FROM setups GROUP BY 1), p AS (SELECT day, greatest(0, max(q) OVER (ORDER BY day)) - q AS dd FROM e) SELECT day, (CASE WHEN dd >= 15000 THEN 0.25 WHEN dd >= 10000 THEN 0.5 WHEN dd >= 5000 THEN 0.75 ELSE 1 END)::DOUBLE AS multiplier FROM p")
_add("strategy_summary", lambda s: s.groupBy("pattern_name").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("r_milli") > 0) / F.count("*"), 6).alias("wr"), F.sum("r_milli").alias("total")), "SELECT pattern_name, count(*) AS n, round(count(*) FILTER (r_milli > 0)::DOUBLE / count(*), 6) AS wr, sum(r_milli)::BIGINT AS total FROM setups GROUP BY 1")


def _geometry(spark, sf_dir: str) -> DataFrame:
    top, bottom = F.greatest("o", "c"), F.least("o", "c")
    return fixtures.daily(spark, sf_dir).select("symbol", "ts", F.abs(F.col("c") - F.col("o")).alias("body"), (F.col("h") - F.col("l")).alias("span"), (F.col("c") > F.col("o")).alias("green"), (F.col("h") - top).alias("upper_wick"), (bottom - F.col("l")).alias("lower_wick"), F.round(F.try_divide(F.col("c") - F.col("l"), F.nullif(F.col("h") - F.col("l"), F.lit(0))), 6).alias("close_position"))


QUERIES["bar_geometry"] = _geometry
ORACLE_SQL["bar_geometry"] = f"WITH {DAILY} SELECT symbol, ts, abs(c - o) AS body, h - l AS span, c > o AS green, h - greatest(o, c) AS upper_wick, least(o, c) - l AS lower_wick, round((c - l)::DOUBLE / nullif(h - l, 0), 6) AS close_position FROM daily"


def _time_window(spark, sf_dir: str) -> DataFrame:
    return fixtures.intraday(spark, sf_dir).where((F.hour("ts") * 60 + F.minute("ts")).between(585, 630) | (F.hour("ts") * 60 + F.minute("ts")).between(840, 870)).select("symbol", "ts", "c")


QUERIES["time_window"] = _time_window
ORACLE_SQL["time_window"] = f"WITH {HOURLY} SELECT symbol, ts, c FROM hourly WHERE hour(ts) * 60 + minute(ts) BETWEEN 585 AND 630 OR hour(ts) * 60 + minute(ts) BETWEEN 840 AND 870"
