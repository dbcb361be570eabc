"""Hard negatives: for each anchor and each of its positives, the best rows of other labels that score just below the positive.

Two passes of anchors against all rows, in blocks, and one secondary sort. A unit of a pass is a block of up to ANCHOR_ROWS anchors and a block of
rows, which stream past the anchors in short runs; a unit puts out only what can be among an anchor's winners, so no anchor's scores are
ever all shuffled or held. The first pass finds the positives. The second knows each anchor's windows (from `floor` percent of a positive's
score up to the score) and puts out, of each window, the unit's first `top` negatives.

The pairs that remain are dealt by anchor and sorted within partitions by (anchor, descending score, positives first, id): the
DataFrame form of a secondary-sort shuffle. An iterator reads them once: a positive opens its window; each negative goes to all windows
that are open, has its score still at or above their floor and fewer than `top` before it; windows close at their floor. It holds an anchor's open windows, and never an
anchor's pairs.

Scores are inner products of whole numbers, formed in doubles, which hold them exactly below 2^53, and in long integers beyond.

Cases: rows with a null id or label, a null vector, or a null or non-finite component take no part, nor do vectors of
another length than most, or with a component so large that a score might leave 64 bits. Zero vectors take part. Equal rows of an anchor are one anchor; rows of one id that differ
are each an anchor under that id. An anchor leaves out all rows of its own id. Equal rows among candidates are each ranked. Ties go to the smaller id. Positives of negative score have
empty windows. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlab.llm.common import checkpoint
from barlab.llm.vectors import dimension, matrix

#: Anchors of a unit, held as doubles; rows of a unit at most, streamed; of both, what is multiplied at a time.
ANCHOR_ROWS, UNIT_ROWS, STEP_ROWS, STEP_ANCHORS = 32_768, 262_144, 4096, 512
#: Rows below which no more units are made.
LEAST_ROWS = 4096
#: Winners that a unit holds before it thins them out.
_HELD = 400_000


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of all components as array<long>, or null if the vector takes no part."""
    doubles = vector.cast("array<double>")
    # 100 times a sum of squares stays below 2^63
    most = F.sqrt(F.lit(float(2**62)) / 100 / F.size(doubles)) / scale
    good = F.forall(doubles, lambda x: x.isNotNull() & (F.abs(x) <= most))
    return F.when((F.size(doubles) > 0) & good, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale)))))


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    return a @ b.T if exact else (a.astype(np.int64) @ b.astype(np.int64).T)


def first_of(anchor: np.ndarray, row: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Positions of each anchor's `top` best, ties to the smaller id."""
    order = np.lexsort((row, -score, anchor))
    a = anchor[order]
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
    return order[np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) < top]


def in_windows(anchor: np.ndarray, row: np.ndarray, score: np.ndarray, opened: np.ndarray, at: np.ndarray, floor: int, top: int) -> np.ndarray:
    """Positions of the negatives that are among the first `top` of some window; a window: its anchor (`opened`) and its positive's score (`at`)."""
    kind = np.append(np.zeros(len(opened), np.int8), np.ones(len(anchor), np.int8))
    who, value = np.append(opened, anchor), np.append(at, score)
    order = np.lexsort((np.append(np.zeros(len(opened), np.int64), row), kind, -value, who))
    before = np.cumsum(kind[order])
    negatives = order[kind[order] == 1] - len(opened)
    w = np.flatnonzero(kind[order] == 0)
    place = before[w][:, None] + np.arange(top)
    inside = place < len(negatives)
    n = negatives[np.where(inside, place, 0)] if len(negatives) else np.zeros_like(place)
    if not len(negatives):
        return np.empty(0, np.int64)
    p = value[order][w][:, None]
    good = inside & (anchor[n] == who[order][w][:, None]) & (100 * score[n] >= floor * p)
    return np.unique(n[good])


class _Unit:
    """Anchors of one block and what they have won so far."""

    def __init__(self, parts: list[pa.RecordBatch], positives: bool, floor: int, top: int):
        t = pa.Table.from_batches(parts)
        self.number, self.ids, self.labels = (t.column(c).to_numpy() for c in ("number", "vec_id", "label"))
        self.rows = matrix(t.column("vector")).astype(np.int64)
        self.positives, self.floor, self.top = positives, floor, top
        self.won: list[tuple[np.ndarray, ...]] = []
        self.count = 0
        if not positives:
            windows = t.column("windows").combine_chunks()
            sizes = windows.value_lengths().to_numpy(zero_copy_only=False)
            self.opened, self.at = np.repeat(np.arange(len(sizes)), sizes), windows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            self.high, self.low = np.full(len(sizes), -(1 << 62)), np.full(len(sizes), 1 << 62)
            np.maximum.at(self.high, self.opened, self.at)
            np.minimum.at(self.low, self.opened, -(-self.floor * self.at // 100))

    def meet(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        biggest = int(np.abs(rows).max(initial=0)) * int(np.abs(self.rows).max(initial=0)) * rows.shape[1]
        exact = biggest < 1 << 53
        own, other = (self.rows.astype(np.float64), rows.astype(np.float64)) if exact else (self.rows, rows)
        for i in range(0, len(own), STEP_ANCHORS):
            some = slice(i, i + STEP_ANCHORS)
            product = _products(own[some], other, exact)
            same = self.labels[some, None] == labels[None, :]
            free = self.ids[some, None] != ids[None, :]
            if self.positives:
                masked = np.where(same & free, product, -np.inf) if exact else np.where(same & free, product, -(1 << 62))
                cut = np.partition(masked, masked.shape[1] - self.top, axis=1)[:, -self.top][:, None] if masked.shape[1] > self.top else masked.min(axis=1)[:, None]
                x, y = np.nonzero((masked >= cut) & same & free)
            else:
                x, y = np.nonzero((product <= self.high[some, None]) & (product >= self.low[some, None]) & ~same & free)
            self.won.append((x + i, ids[y], product[x, y].astype(np.int64)))
            self.count += len(x)
            if self.count > _HELD:
                self.thin()
        if self.count > _HELD // 4:
            self.thin()

    def thin(self) -> None:
        anchor, row, score = (np.concatenate(c) for c in zip(*self.won, strict=True)) if self.won else (np.empty(0, np.int64),) * 3
        keep = first_of(anchor, row, score, self.top) if self.positives else in_windows(anchor, row, score, self.opened, self.at, self.floor, self.top)
        self.won, self.count = [(anchor[keep], row[keep], score[keep])], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.thin()
        anchor, row, score = self.won[0]
        yield pa.RecordBatch.from_arrays([pa.array(self.number[anchor]), pa.array(row), pa.array(score)], ["number", "vec_id", "score"])


def _meet(positives: bool, floor: int, top: int):
    """Rows sorted by unit and `streams`: its anchors (0), then the rows that stream past them (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, unit = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "part", "streams")])
            cuts = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))), batch.num_rows).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (key := (int(keys[0, a]), int(keys[1, a]))) != of:
                    if unit:
                        yield from unit.batches()
                    of, held, unit = key, [], None
                if not keys[2, a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if held and not unit:
                    unit = _Unit(held, positives, floor, top)
                for i in range(a, b if unit else a, STEP_ROWS):
                    part = batch.slice(i, min(STEP_ROWS, b - i))
                    unit.meet(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("vector")).astype(np.int64))
        if unit:
            yield from unit.batches()

    return run


def _pass(anchors: DataFrame, rows: DataFrame, blocks: int, parts: int, positives: bool, floor: int, top: int) -> DataFrame:
    """(number, vec_id, score): each unit's winners. anchors: number, vec_id, label, vector, windows; rows: number, vec_id, label, vector."""
    block, part = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int")
    columns = ["number", "vec_id", "label", "vector", "windows"]
    here = anchors.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("streams"), *columns)
    there = rows.withColumn("windows", F.array().cast("array<long>")).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("part"), F.lit(1).alias("streams"), *columns)
    met = here.union(there).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "streams")
    return met.mapInArrow(_meet(positives, floor, top), "number long, vec_id long, score long")


def _stream(floor: int, top: int):
    """Rows sorted by anchor number, descending score, kind (0: positive) and id; negatives of each window as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, open_ = None, []
        for batch in batches:
            out: list[tuple[int, int, int, int, int, int]] = []
            for number, score, kind, vec_id in zip(*(batch.column(c).to_pylist() for c in ("number", "score", "kind", "vec_id")), strict=True):
                if number != anchor:
                    anchor, open_ = number, []
                if not kind:
                    open_.append([vec_id, score, 0])
                    continue
                open_ = [w for w in open_ if w[2] < top and 100 * score >= floor * w[1]]
                for w in open_:
                    w[2] += 1
                    out.append((number, w[0], w[2], vec_id, w[1], score))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["number", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    vectors: DataFrame, is_anchor, label=None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, floor: int = 80
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: condition on vec_id; label: of (vec_id, label), the label to use."""
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), scaled(F.col(vector_col), scale).alias("vector"))
    if label is not None:
        named = named.withColumn("label", label(F.col("vec_id"), F.col("label")))
    good = named.where("vec_id is not null and label is not null and vector is not null")
    d = dimension(good, "vector")
    # numbers deal rows out whatever their ids; they are written before anything depends on them
    rows = checkpoint(good.where(F.size("vector") == d).withColumn("number", F.monotonically_increasing_id()))
    anchors = rows.where(is_anchor(F.col("vec_id"))).groupBy("vec_id", "label", "vector").agg(F.min("number").alias("number"))
    anchors = checkpoint(anchors)
    n, a = rows.count(), anchors.count()
    if not a:
        return spark.createDataFrame([], _RESULT)
    blocks = -(-a // ANCHOR_ROWS)
    parts = max(-(-n // UNIT_ROWS), min(-(-n // LEAST_ROWS), 2 * spark.sparkContext.defaultParallelism))
    found = _pass(anchors.withColumn("windows", F.array().cast("array<long>")), rows, blocks, parts, True, floor, positives)
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    best = checkpoint(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).drop("rank"))
    windows = best.where("score >= 0").groupBy("number").agg(F.collect_list("score").alias("windows"))  # at most `positives` of an anchor
    near = _pass(anchors.join(windows.hint("merge"), "number"), rows, blocks, parts, False, floor, negatives)
    pairs = best.withColumn("kind", F.lit(0)).unionByName(near.withColumn("kind", F.lit(1)))
    ordered = pairs.repartition("number").sortWithinPartitions("number", F.desc("score"), "kind", "vec_id")
    mined = ordered.mapInArrow(_stream(floor, negatives), "number long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    named = anchors.select("number", F.col("vec_id").alias("anchor_id"))
    return mined.join(named.hint("merge"), "number").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: Inner products of whole numbers, which doubles hold exactly.
ORACLE_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
