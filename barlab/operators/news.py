"""News and text: cleaning, de-duplication, sentiment, digests, tickers. Lexicons are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Named entities, in order; the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
# Words that look like tickers and are none.
STOP_TICKERS = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "ES", "NQ", "YM", "RTY", "CL", "GC")


def clean_html(html: Column) -> Column:
    out = F.regexp_replace(html, r"<[^>]+>", "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(out)


def split_source(text: Column) -> tuple[Column, Column]:
    """Headline and source around the last " - "; the whole text and null without one."""
    has = text.contains(" - ")
    return F.when(has, F.regexp_extract(text, r"^(.*) - (.*)$", 1)).otherwise(text), F.when(has, F.regexp_extract(text, r"^(.*) - (.*)$", 2))


def headline_sentiment(text: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """Which lexicon has more of its entries in the text."""
    low = F.lower(text)
    count = lambda words: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    score = count(positive) - count(negative)
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def headline_key(text: Column) -> Column:
    return F.trim(F.lower(F.substring(text, 1, 60)))


def dedup_headlines(news: DataFrame) -> DataFrame:
    """The first of equal keys by provider, then id. A struct minimum: one aggregation, no sort of a hot key."""
    rest = [c for c in news.columns if c not in ("provider", "doc_id")]
    first = F.min_by(F.struct("provider", "doc_id", *rest), F.struct("provider", "doc_id"))
    return news.groupBy(headline_key(F.col("headline")).alias("key")).agg(first.alias("x")).select("key", "x.*")


def latest_news(news: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("published"), "doc_id")
    return news.where(F.trim("headline") != "").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def aggregate_sentiment(insights: DataFrame) -> DataFrame:
    """Counts and net sentiment by ticker."""
    counts = insights.groupBy("ticker").pivot("sentiment", ["positive", "negative", "neutral"]).count().fillna(0)
    total = F.col("positive") + F.col("negative") + F.col("neutral")
    return counts.withColumn("net", F.try_divide(F.col("positive") - F.col("negative"), total))


def relevance_filter(news: DataFrame, first: int = 2) -> DataFrame:
    """News whose first tickers name its symbol; for symbols without any, all their news."""
    relevant = news.where(F.array_contains(F.slice("tickers", 1, first), F.col("symbol")))
    rest = news.join(relevant.select("symbol").distinct(), "symbol", "left_anti")
    return relevant.unionByName(rest.select(*relevant.columns))


def news_as_of_signals(signals: DataFrame, news: DataFrame, days: int = 3) -> DataFrame:
    """News of the days before each signal: an equi join on symbol and day bucket, then the exact interval."""
    span = F.make_dt_interval(days=F.lit(days))
    number = lambda ts: F.datediff(F.to_date(ts), F.lit("1970-01-01"))
    right = news.withColumn("bucket", F.explode(F.sequence(F.floor(number("published") / days), F.floor(number(F.col("published") + span) / days))))
    left = signals.withColumn("bucket", F.floor(number("at") / days))
    met = left.join(right.hint("merge"), ["symbol", "bucket"])
    return met.where((F.col("published") <= F.col("at")) & (F.col("published") > F.col("at") - span)).drop("bucket")


#: Where pages name symbols, the most reliable place first.
TICKER_PLACES = (r'data-symbol="([A-Z]{1,5})"', r'/quote/([A-Z]{1,5})(?:[/?"\s])', r'symbol="([A-Z]{1,5})"', r'"symbol"\s*:\s*"([A-Z]{1,5})"')


def extract_tickers(html: Column, enough: int = 10) -> Column:
    """Distinct symbols of a page in order of place; each next place is looked at while fewer than `enough` are found."""
    out = F.array_distinct(F.regexp_extract_all(html, F.lit(TICKER_PLACES[0]), F.lit(1)))
    for place in TICKER_PLACES[1:]:
        more = F.array_distinct(F.concat(out, F.regexp_extract_all(html, F.lit(place), F.lit(1))))
        out = F.when(F.size(out) < enough, more).otherwise(out)
    return out


def symbol_valid(symbol: Column) -> Column:
    return symbol.rlike("^[A-Za-z]{1,5}$") & ~((F.length(symbol) > 1) & symbol.rlike("[WURwur]$"))


def ticker_filter(df: DataFrame, cap: int = 50) -> DataFrame:
    """Names trimmed and in upper case, of 6 letters at most, not stopped, first occurrence of each, capped."""
    name = F.upper(F.trim("name"))
    ok = df.withColumn("name", name).where(F.col("name").rlike("^[A-Z]{1,6}$") & ~F.col("name").isin(*STOP_TICKERS))
    first = ok.groupBy("name").agg(F.min("pos").alias("pos"))
    return first.orderBy("pos", "name").limit(cap)


# Categories and the words that a pattern's name has, in order; the first match wins.
CATEGORIES = (
    ("breakout", "breakout|expansion|squeeze|donchian|turtle|keltner"),
    ("mean_reversion", "reversal|reversion|divergence|fade"),
    ("momentum", "momentum|trend|drive|persistence|flag|wave"),
    ("volume", "volume|climax|vp |vwap"),
    ("intraday", "gap|opening|power hour|midday"),
    ("institutional", "accumulation|distribution"),
)


def strategy_category(name: Column) -> tuple[Column, Column]:
    """Category by the first matching words, and direction."""
    out = F.when(F.lit(False), F.lit(""))
    for category, words in CATEGORIES:
        out = out.when(F.lower(name).rlike(words), category)
    return out.otherwise("other"), F.when(name.contains("Long"), "long").when(name.contains("Short"), "short").otherwise("both")


def headline_age(published: Column, as_of: Column) -> Column:
    """Minutes, hours or days since; a headline from after `as_of` counts as 0 minutes old."""
    minutes = F.greatest(F.timestamp_diff("MINUTE", published.cast("timestamp"), as_of.cast("timestamp")), F.lit(0))
    days, hours = F.floor(minutes / 1440), F.floor(minutes / 60)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(minutes < 1440, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(days.cast("string"), F.lit("d ago")))
