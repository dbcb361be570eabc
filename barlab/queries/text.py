"""N and the text expressions of B."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators import news as N
from barlab.queries.sql import HOURLY
from barlab.sources import fixtures

POSITIVE, NEGATIVE = ("the", "ing", "tion"), ("eau", "sch", "os", "heit")
QUERIES: dict = {}
ORACLE_SQL: dict = {}

NEWS = """news AS (SELECT d.doc_id, string_split(text, chr(10))[1] AS headline, text, source, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id * 7) AS published, concat('S', d.doc_id % 50) AS symbol, lang AS provider,
  list_distinct([concat('S', d.doc_id % 50), concat('S', d.doc_id * 3 % 50), concat('S', d.doc_id * 7 % 50)]) AS bag, [concat('S', d.doc_id % 50), concat('S', d.doc_id * 3 % 50), concat('S', d.doc_id * 7 % 50)] AS tick, CASE l.quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS sentiment
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _add(name: str, build, sql: str, table: str = "") -> None:
    QUERIES[name] = (lambda spark, sf_dir: build(fixtures.table(spark, sf_dir, table))) if table else (lambda spark, sf_dir: build(fixtures.news(spark, sf_dir)))
    ORACLE_SQL[name] = sql if table else f"WITH {NEWS} {sql}"


_clean = "regexp_replace(html, '<[^>]+>', '', 'g')"
for _a, _b in N.ENTITIES:
    _clean = f"replace({_clean}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
_add("clean_html", lambda p: p.select("page_id", F.md5(N.clean_html(F.col("html"))).alias("clean")), f"SELECT page_id, md5(trim({_clean}, ' ')) AS clean FROM pages", "pages")
_letters = lambda x: F.translate(x.cast("string"), "0123456789", "ABCDEFGHIJ")


def _page(p):
    """Pages with symbols in all places; every fourth has eleven of the first kind, so that the others are not looked at."""
    id_ = F.col("page_id")
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.when(id_ % 4 == 0, 11).otherwise(2)), lambda i: F.concat(F.lit('<i data-symbol="'), _letters(i + id_ % 7), F.lit('">'))), "")
    rest = F.concat(F.lit('<a href="/quote/'), _letters(id_ % 50), F.lit('/"> {"symbol" : "'), _letters(id_ % 90), F.lit('"} <b symbol="'), _letters(id_ % 11), F.lit('">'))
    return F.concat(F.coalesce("html", F.lit("")), many, rest)


_add("extract_tickers_from_html", lambda p: p.select("page_id", N.extract_tickers(_page(p)).alias("t")).select("page_id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort("t"), ",").alias("tickers")),
    r"""WITH p AS (SELECT page_id, coalesce(html, '') || array_to_string(list_transform(range(1, CASE WHEN page_id % 4 = 0 THEN 12 ELSE 3 END), lambda i: '<i data-symbol="' || translate((i + page_id % 7)::VARCHAR, '0123456789', 'ABCDEFGHIJ') || '">'), '')
        || '<a href="/quote/' || translate((page_id % 50)::VARCHAR, '0123456789', 'ABCDEFGHIJ') || '/"> {"symbol" : "' || translate((page_id % 90)::VARCHAR, '0123456789', 'ABCDEFGHIJ') || '"} <b symbol="' || translate((page_id % 11)::VARCHAR, '0123456789', 'ABCDEFGHIJ') || '">' AS x FROM pages),
      a AS (SELECT *, list_distinct(regexp_extract_all(x, 'data-symbol="([A-Z]{1,5})"', 1)) AS t1 FROM p),
      b AS (SELECT *, CASE WHEN len(t1) < 10 THEN list_distinct(t1 || regexp_extract_all(x, '/quote/([A-Z]{1,5})(?:[/?"\s])', 1)) ELSE t1 END AS t2 FROM a),
      c AS (SELECT *, CASE WHEN len(t2) < 10 THEN list_distinct(t2 || regexp_extract_all(x, 'symbol="([A-Z]{1,5})"', 1)) ELSE t2 END AS t3 FROM b),
      d AS (SELECT *, CASE WHEN len(t3) < 10 THEN list_distinct(t3 || regexp_extract_all(x, '"symbol"\s*:\s*"([A-Z]{1,5})"', 1)) ELSE t3 END AS t4 FROM c)
      SELECT page_id, len(t4) AS n, array_to_string(list_sort(t4), ',') AS tickers FROM d""", "pages")
_joined = lambda: F.concat("headline", F.lit(" - "), "source")
_add("split_source", lambda n: n.select("doc_id", N.split_source(_joined())[0].alias("head"), N.split_source(_joined())[1].alias("src")), "SELECT doc_id, headline AS head, source AS src FROM news")
_count = lambda words: " + ".join(f"contains(lower(headline), '{w}')::INT" for w in words)
_add("headline_sentiment", lambda n: n.select("doc_id", N.headline_sentiment(F.col("headline"), POSITIVE, NEGATIVE).alias("label")),
    f"SELECT doc_id, CASE WHEN {_count(POSITIVE)} > {_count(NEGATIVE)} THEN 'positive' WHEN {_count(POSITIVE)} < {_count(NEGATIVE)} THEN 'negative' ELSE 'neutral' END AS label FROM news")
_add("dedup_headlines", lambda n: N.dedup_headlines(n.select("headline", "provider", "doc_id")).select("key", "provider", "doc_id"),
    "SELECT key, provider, doc_id FROM (SELECT *, trim(lower(headline[1:60]), ' ') AS key, row_number() OVER (PARTITION BY trim(lower(headline[1:60]), ' ') ORDER BY provider, doc_id) AS r FROM news) WHERE r = 1")
_add("latest_news", lambda n: N.latest_news(n, 5).select("symbol", "doc_id", "published"), "SELECT symbol, doc_id, published FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published DESC, doc_id) AS r FROM news WHERE trim(headline, ' ') <> '') WHERE r <= 5")
_add("aggregate_sentiment", lambda n: N.aggregate_sentiment(n.where("sentiment is not null").select(F.explode("tickers").alias("ticker"), "sentiment")).withColumn("net", F.round("net", 6)),
    "SELECT ticker, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral, round((count(*) FILTER (sentiment = 'positive') - count(*) FILTER (sentiment = 'negative'))::DOUBLE / count(*), 6) AS net FROM (SELECT unnest(bag) AS ticker, sentiment FROM news WHERE sentiment IS NOT NULL) GROUP BY 1")
_add("relevance_filter", lambda n: N.relevance_filter(n.withColumn("tickers", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("S1"))).otherwise(F.array("symbol"))).select("symbol", "doc_id", "tickers"), 1).select("symbol", "doc_id"),
    ", t AS (SELECT symbol, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'S1' ELSE symbol END AS lead FROM news), r AS (SELECT * FROM t WHERE lead = symbol) SELECT symbol, doc_id FROM r UNION ALL SELECT symbol, doc_id FROM t WHERE symbol NOT IN (SELECT symbol FROM r)")
_line = lambda: F.concat(F.lit("- "), F.substring("headline", 1, 40), F.lit(" ("), "source", F.lit(")"))
_add("news_digest", lambda n: N.latest_news(n, 3).withColumn("line", _line()).groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("digest")),
    "SELECT symbol, string_agg('- ' || headline[1:40] || ' (' || source || ')', chr(10) ORDER BY r) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published DESC, doc_id) AS r FROM news WHERE trim(headline, ' ') <> '') WHERE r <= 3 GROUP BY 1")
_add("headline_age", lambda n: n.select("doc_id", N.headline_age(F.col("published"), F.lit("2024-03-01 00:00:00").cast("timestamp")).alias("age")),
    ", m AS (SELECT doc_id, greatest(0, trunc(epoch(TIMESTAMP '2024-03-01' - published) / 60))::BIGINT AS m FROM news) SELECT doc_id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS age FROM m")


def news_as_of_signals(spark, sf_dir):
    """Headlines of the three days before noon of each day, by symbol."""
    news = fixtures.news(spark, sf_dir)
    at = F.to_date("published").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12))
    signals = news.select("symbol", at.alias("at")).distinct()
    met = N.news_as_of_signals(signals, news.select("symbol", "published", "sentiment"))
    return met.groupBy("symbol", "at").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == "positive").alias("positive"))


QUERIES["news_as_of_signals"] = news_as_of_signals
ORACLE_SQL["news_as_of_signals"] = f"""WITH {NEWS}, s AS (SELECT DISTINCT symbol, published::DATE::TIMESTAMP + INTERVAL 12 HOUR AS at_ FROM news)
  SELECT s.symbol, at_ AS "at", count(*) AS n, count(*) FILTER (sentiment = 'positive') AS positive FROM s JOIN news n ON n.symbol = s.symbol AND published <= at_ AND published > at_ - INTERVAL 3 DAY GROUP BY ALL"""
_add("symbol_valid", lambda t: t.select("p_partkey", N.symbol_valid(F.translate(F.col("p_partkey").cast("string"), "0123456789", "ABWDERGHUJ")).alias("valid")),
    "SELECT p_partkey, regexp_matches(s, '^[A-Za-z]{1,5}$') AND NOT (length(s) > 1 AND regexp_matches(s, '[WURwur]$')) AS valid FROM (SELECT p_partkey, translate(p_partkey::VARCHAR, '0123456789', 'ABWDERGHUJ') AS s FROM part)", "part")
_add("ticker_filter", lambda t: N.ticker_filter(t.select(F.concat(F.lit(" "), F.substring("p_name", 1, 3)).alias("name"), F.col("p_partkey").alias("pos"))),
    f"SELECT name, min(p_partkey) AS pos FROM (SELECT upper(trim(' ' || p_name[1:3], ' ')) AS name, p_partkey FROM part) WHERE regexp_matches(name, '^[A-Z]{{1,6}}$') AND name NOT IN {N.STOP_TICKERS} GROUP BY 1 ORDER BY 2, 1 LIMIT 50", "part")
_LABELS = (
    "Tidal Wave", "Mean Reversion", "Trend Pullback", "Gap Fade", "VWAP Reversion", "Gap Reversal Long", "Opening Drive Long", "Power Hour Short", "Volume Climax Short", "VWAP Trend Long", "RSI Divergence Long",
    "Midday Reversal Short", "Keltner Breakout Long", "MACD Turn Short", "VP Divergence Long", "Juicer Long", "52W High Momentum", "RS Persistence Long", "BB Squeeze Short", "Accumulation Long", "Distribution Short",
)
_add("strategy_category", lambda t: t.withColumn("name", F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % len(_LABELS) + 1).cast("int"))).select("p_partkey", N.strategy_category(F.col("name"))[0].alias("category"), N.strategy_category(F.col("name"))[1].alias("direction")),
    f"""SELECT p_partkey, CASE WHEN n IN ('Keltner Breakout Long', 'BB Squeeze Short') THEN 'breakout' WHEN n LIKE '%Reversal%' OR n LIKE '%Reversion%' OR n LIKE '%Divergence%' OR n LIKE '%Fade%' THEN 'mean_reversion'
      WHEN n IN ('Tidal Wave', 'Trend Pullback', 'Opening Drive Long', 'VWAP Trend Long', '52W High Momentum', 'RS Persistence Long') THEN 'momentum' WHEN n = 'Volume Climax Short' THEN 'volume' WHEN n = 'Power Hour Short' THEN 'intraday'
      WHEN n IN ('Accumulation Long', 'Distribution Short') THEN 'institutional' ELSE 'other' END AS category,
      CASE WHEN contains(n, 'Long') THEN 'long' WHEN contains(n, 'Short') THEN 'short' ELSE 'both' END AS direction FROM (SELECT p_partkey, {list(_LABELS)}[p_partkey % {len(_LABELS)} + 1] AS n FROM part)""", "part")
_ = HOURLY
