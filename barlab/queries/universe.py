"""O: universe and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators import universe as U
from barlab.queries.sql import DAILY, HOURLY
from barlab.sources import fixtures


def _both(spark, sf_dir):
    return fixtures.daily(spark, sf_dir).unionByName(fixtures.intraday(spark, sf_dir))


QUERIES = {
    "top_symbols": lambda s, d: U.top_symbols(fixtures.universe(s, d), 100).select("symbol", "value"),
    "skip_reasons": lambda s, d: U.skip_reasons(fixtures.universe(s, d)),
    "daily_universe": lambda s, d: U.daily_universe(fixtures.daily(s, d), ["ECONOMY"], 3).select("ts", "symbol", F.col("rank").cast("long").alias("rank")),
    "hot_list": lambda s, d: U.hot_list(fixtures.universe(s, d).where("px % 7 = 0"), fixtures.universe(s, d).where("px % 5 = 0"), U.top_symbols(fixtures.universe(s, d), 500)).select("symbol", F.col("priority").cast("long").alias("priority")),
    "verify_square": lambda s, d: U.verify_square(_both(s, d)),
    "missing_symbols": lambda s, d: U.missing_symbols(_both(s, d), "1d"),
    "verify_coverage": lambda s, d: U.verify_coverage(_both(s, d), "2024-01-30"),
    "symbols_with_history": lambda s, d: U.symbols_with_history(_both(s, d), 700).select("symbol", "tf", "n"),
}
_U = """u AS (SELECT translate(p_partkey::VARCHAR, '0123456789', 'ABCDEFGHIJ') AS symbol, round(p_retailprice * 100)::BIGINT AS px, sum(l_quantity::BIGINT)::BIGINT * 2000 AS volume FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2),
  w AS (SELECT *, CASE WHEN NOT regexp_matches(symbol, '^[A-Za-z]{1,5}$') OR (length(symbol) > 1 AND regexp_matches(symbol, '[WURwur]$')) THEN 'bad_symbol' WHEN px IS NULL THEN 'no_price' WHEN px < 500 THEN 'low_price' WHEN volume < 500000 THEN 'low_volume' END AS reason FROM u)"""
_BOTH = f"{DAILY}, {HOURLY}, b AS (SELECT '1d' AS tf, * FROM daily UNION ALL SELECT '1h', * FROM hourly)"
ORACLE_SQL = {
    "top_symbols": f"WITH {_U} SELECT symbol, px * volume AS value FROM w WHERE reason IS NULL ORDER BY 2 DESC, 1 LIMIT 100",
    "skip_reasons": f"WITH {_U} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM w GROUP BY 1",
    "daily_universe": f"WITH {DAILY}, a AS (SELECT *, avg(c * v) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS val FROM daily WHERE symbol <> 'ECONOMY'), r AS (SELECT ts, symbol, dense_rank() OVER (PARTITION BY ts ORDER BY val DESC) AS rank FROM a) SELECT * FROM r WHERE rank <= 3",
    "hot_list": f"WITH {_U}, t AS (SELECT symbol FROM w WHERE reason IS NULL ORDER BY px * volume DESC, symbol LIMIT 500), s AS (SELECT symbol, 0 AS p FROM u WHERE px % 7 = 0 UNION ALL SELECT symbol, 1 FROM u WHERE px % 5 = 0 UNION ALL SELECT symbol, 2 FROM t) SELECT symbol, min(p)::BIGINT AS priority FROM s GROUP BY 1",
    "verify_square": f"WITH {_BOTH}, p AS (SELECT tf, symbol, count(*) AS n, min(ts) AS a, max(ts) AS z FROM b GROUP BY ALL) SELECT tf, count(*) AS symbols, min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS most, min(a) AS \"first\", max(z) AS \"last\" FROM p GROUP BY 1",
    "missing_symbols": f"WITH {_BOTH} SELECT t.tf, s.symbol FROM (SELECT DISTINCT tf FROM b WHERE tf <> '1d') t, (SELECT DISTINCT symbol FROM b WHERE tf = '1d') s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.tf = t.tf AND b.symbol = s.symbol)",
    "verify_coverage": f"WITH {_BOTH}, p AS (SELECT tf, symbol, max(ts) AS z FROM b GROUP BY ALL) SELECT tf, count(*) FILTER (z >= '2024-01-30')::DOUBLE / count(*) AS covered, count(*) FILTER (z >= '2024-01-30')::DOUBLE / count(*) >= 0.95 AS ok FROM p GROUP BY 1",
    "symbols_with_history": f"WITH {_BOTH} SELECT symbol, tf, count(*) AS n FROM b GROUP BY ALL HAVING count(*) >= 700",
}
