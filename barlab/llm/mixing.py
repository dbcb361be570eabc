"""Mixing sources to target weights: whole copies plus one hash-seeded Bernoulli copy.

A document's size is its number of words. Sources in code-point order, null last, weigh 1, 2, 3,
repeating, or as a caller's weights say, and share the sizes of all documents. A target stops at
`most` times its source's size and the excess is shared again by weight until none is above. The rate of a
source is target / size; each of its documents is taken floor(rate) times, and once more if a hash of
its id falls below the fraction. So no document exceeds ceil(rate) <= `most` copies and reruns agree.

The shares use the closed form of that sharing: with sources ordered by most * size / weight, the first k
are capped, k being the least number for which the share per weight of the rest caps none of them.

Cases: a null text and a text without words have size 0 and take 0 words; a source of size 0 has target 0;
repeated ids share their draw; a null id draws as the empty string. An empty table gives an empty
result. Other columns are kept by `mix` and ignored by `mixture`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import WORD, checkpoint, lookup_join

#: Hexadecimal digits of the draw.
_DIGITS = 12


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(identity: Column, seed: int) -> Column:
    """A number from 0 to 1 from the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target, rate) from (source, size): one short row for each source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    cap = F.lit(most) * F.col("source_size")
    by_cap = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = weighed.withColumns(
        {
            "left": F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
            "over": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("level", F.when(F.col("left") / F.col("over") <= cap / F.col("weight"), F.col("left") / F.col("over")))
    level = F.first("level", ignorenulls=True).over(all_rows)
    target = F.least(cap, F.coalesce(level * F.col("weight"), cap))
    return shared.withColumn("target", target).select(
        "source", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    )


def copies_of(rate: Column, identity: Column, seed: int) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(identity, seed) < rate - whole, 1).otherwise(0)).cast("int")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = 3.0, seed: int = 10) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every row."""
    sized = checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")))
    targets = checkpoint(source_targets(sized, most))
    joined = lookup_join(sized, targets, "source", targets.count(), null_safe=True)
    copies = copies_of(F.col("rate"), F.col("doc_id"), seed)
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = 3.0, seed: int = 10) -> DataFrame:
    """`docs` with each row as many times as it is taken, columns as they are.

    The first pass reads sources and texts for the sizes; the second is a map over the rows.
    """
    targets = checkpoint(source_targets(docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")), most))
    rates = targets.select(F.col("source").alias(source_col), F.col("rate").alias("__rate"))
    joined = lookup_join(docs, rates, source_col, targets.count(), null_safe=True)
    copies = copies_of(F.col("__rate"), F.col(id_col), seed)
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM totals),
shared AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER w, 0) AS remain,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS over_w
  FROM weighed WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT max(CASE WHEN remain / over_w <= 3.0::DOUBLE * source_size / weight THEN remain / over_w END) AS level FROM shared),
targets AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(level * weight, 3.0::DOUBLE * source_size)) AS target FROM shared, levels),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || md5('10:' || coalesce(s.doc_id::VARCHAR, ''))[1:12])::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM rated
"""
