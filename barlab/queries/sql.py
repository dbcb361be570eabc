"""Common table expressions of the test shapes, for the SQL side."""

TICKS = """ticks AS (SELECT event_type AS symbol, ts, event_id,
  10000 + (sum((CAST(round(value*100) AS BIGINT) % 41) - 20) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS px,
  1 + CAST(round(value*100) AS BIGINT) % 500 AS qty FROM events)"""
DTICKS = """dticks AS (SELECT p_type AS symbol, l_shipdate AS ts, row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_id,
  100000 + (sum((CAST(round(l_extendedprice*100) AS BIGINT) % 401) - 200) OVER (PARTITION BY p_type ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING))::BIGINT AS px,
  CAST(l_quantity AS BIGINT)*100 AS qty FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def bars_of(ticks: str, minutes: int, name: str) -> str:
    return f"""{name} AS (SELECT symbol, time_bucket(INTERVAL {minutes} MINUTE, ts) AS ts, arg_min(px, (ts, event_id)) AS o, max(px) AS h, min(px) AS l,
  arg_max(px, (ts, event_id)) AS c, sum(qty)::BIGINT AS v, sum(px * qty)::DOUBLE / sum(qty) AS vwap, count(*) AS n FROM {ticks} GROUP BY ALL)"""


DAILY = f"{DTICKS}, {bars_of('dticks', 1440, 'daily')}"
HOURLY = f"{TICKS}, {bars_of('ticks', 60, 'hourly')}"
QUARTER = f"{TICKS}, {bars_of('ticks', 15, 'quarter')}"
FIVE = f"{TICKS}, {bars_of('ticks', 5, 'five')}"

TRADES = """trades AS (SELECT *, CASE WHEN r_milli >= 1500 THEN 'win' WHEN r_milli > 0 THEN 'partial_win' WHEN r_milli = 0 THEN 'timeout' ELSE 'loss' END AS outcome FROM (
  SELECT concat(l_orderkey, '-', l_linenumber) AS id, p_brand AS pattern_name, concat('S', l_suppkey) AS symbol,
    CASE WHEN l_linenumber % 2 = 0 THEN 'long' ELSE 'short' END AS bias,
    ((l_partkey*7 + l_suppkey*13 + l_linenumber*29) % 81 - 36) * 50 AS r_milli, l_shipdate AS closed_at,
    l_shipdate - to_hours(l_quantity::INT) AS entered_at, l_shipdate - to_hours(l_quantity::INT + 1) AS detected_at, l_orderkey % 4 AS regime,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS src_rank, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey))"""
CLOSED = f"""{TRADES}, closed AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src_rank, l_partkey, l_suppkey, closed_at, r_milli) AS rn FROM trades) WHERE rn = 1)"""


def over(first: int, last: int = 0) -> str:
    """A frame of one series, as (PARTITION BY ... ROWS ...)."""
    side = lambda n: "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {side(first)} AND {side(last)})"


K = "row_number() OVER (PARTITION BY symbol ORDER BY ts)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY ts)"
