"""Nearest neighbours by inner product, over a hierarchical k-means tree with best-bin-first search.

The tree is fit on a bounded sample (about SAMPLE_ROWS vectors, drawn by hash); every vector is then filed under the leaf
its descent ends in. A query keeps the tree's nodes in a priority queue by the inner product it can hope for below
them, that with their centre and SPREAD deviations of their vectors around it; it takes the best, puts its children in or,
at a leaf, visits it. How many leaves are visited is calibrated: CALIBRATION queries are answered exactly over all
vectors, and visits widen until the leaves that hold the true neighbours have been visited in `recall` of the cases.

Leaves are dealt into buckets of about BUCKET_ROWS vectors, and a leaf above that into several. A query goes once to each
bucket that holds leaves it visits, with the list of these, and meets their vectors alone. A task holds the vectors
of one bucket, streams the queries past them, and returns each query's best; a ranking merges those.

Cases: vectors that are null, empty, zero, of unusual length or hold null or non-finite components take no part,
as queries or as candidates. A query leaves out the rows of its own id. Fewer candidates than asked
give fewer rows. Rows of a repeated query id with equal vectors are one query, and with different vectors one each, under the same id; candidates of equal ids are each ranked.
Ties go to the smaller id. Null ids take no part. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import checkpoint
from barlab.llm.vectors import dimension, matrix, usable

SAMPLE_ROWS = 65_536
BRANCHES = 16
#: Sampled vectors to a leaf, about.
LEAF_SAMPLE = 16
CALIBRATION = 128
#: Deviations of a node's vectors, along one direction, that a query hopes for beyond the centre.
SPREAD = 2.5
BUCKET_ROWS = 2048
#: Queries that meet one copy of a bucket.
QUERY_ROWS = 262_144
#: Queries that a task leads through the tree.
SEEK_ROWS = 256
_HELD = 400_000


class KMeansTree:
    """centres: of all nodes; children: of each inner node; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, seed: int = 3):
        self._draw = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])]
        self.children: list[list[int]] = [[]]
        self.spreads: list[float] = [self._spread(sample, self.centres[0])]
        self._grow(0, sample)
        self.matrix, self.hope = np.stack(self.centres), SPREAD * np.array(self.spreads)
        self.leaves = [i for i, c in enumerate(self.children) if not c]
        self.leaf_number = {node: k for k, node in enumerate(self.leaves)}

    @staticmethod
    def _spread(rows: np.ndarray, centre: np.ndarray) -> float:
        return float(np.sqrt(((rows - centre) ** 2).mean())) if len(rows) else 0.0

    def _grow(self, node: int, rows: np.ndarray) -> None:
        k = min(BRANCHES, -(-len(rows) // LEAF_SAMPLE))
        if k < 2 or (rows == rows[0]).all():
            return
        centres, of = self._kmeans(rows, k)
        if len(np.unique(of)) < 2:  # rows apart by less than rounding
            return
        for j in range(len(centres)):
            if len(g := np.flatnonzero(of == j)):
                child = len(self.centres)
                self.centres.append(centres[j])
                self.children.append([])
                self.spreads.append(self._spread(rows[g], centres[j]))
                self.children[node].append(child)
                self._grow(child, rows[g])

    def _kmeans(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Centres of k groups or, with many copies, fewer, and the group of each row; two groups have rows, as not all rows are equal."""
        centres = np.unique(rows[self._draw.choice(len(rows), k, replace=False)], axis=0)
        if len(centres) == 1:
            centres = np.stack([centres[0], rows[(rows != centres[0]).any(axis=1).argmax()]])
        near = lambda c: np.argmin((c**2).sum(axis=1) - 2 * rows @ c.T, axis=1)
        of = near(centres)
        for _ in range(8):
            order = np.argsort(of, kind="stable")
            held, starts = np.unique(of[order], return_index=True)
            moved = centres.copy()
            moved[held] = np.add.reduceat(rows[order], starts, axis=0) / np.diff(np.append(starts, len(rows)))[:, None]
            after = near(moved)
            if len(np.unique(after)) < 2:
                break
            centres, of = moved, after
        return centres, of

    def file(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every node on the way down."""
        out = np.zeros(len(rows), dtype=np.int64)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, some = stack.pop()
            if not len(some):
                continue
            kids = self.children[node]
            if not kids:
                out[some] = self.leaf_number[node]
                continue
            c = self.matrix[kids]
            of = np.argmin((c**2).sum(axis=1) - 2 * rows[some] @ c.T, axis=1)
            stack += [(kid, some[of == j]) for j, kid in enumerate(kids)]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order."""
        gain = (self.matrix @ query + self.hope * np.linalg.norm(query)).tolist()
        queue, out = [(-gain[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf_number[node])
            for kid in self.children[node]:
                heapq.heappush(queue, (-gain[kid], kid))
        return out


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Positions of each query's `top` best, nearest first, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[rank < top]


def _best_of(product: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, by_id: np.ndarray, top: int):
    """(query position, row position, score) of what can be among each query's best; product: -inf where a pair does not meet. by_id: order of row_ids."""
    same = row_ids[by_id]
    first, last = np.searchsorted(same, ids, "left"), np.searchsorted(same, ids, "right")
    for k in np.flatnonzero(last > first):
        product[k, by_id[first[k] : last[k]]] = -np.inf
    if len(rows) > top:
        bound = np.partition(product, len(rows) - top, axis=1)[:, len(rows) - top]
        bound = bound - 1e-9 * np.maximum(1, np.where(bound > -np.inf, np.abs(bound), 0))  # products in blocks may differ in the last bits
        x, y = np.nonzero((product >= bound[:, None]) & (product > -np.inf))
    else:
        x, y = np.nonzero(product > -np.inf)
    return x, y, (queries[x] * rows[y]).sum(axis=1)


class _Held:
    """Running best of many queries in bounded memory."""

    def __init__(self, top: int):
        self.top, self.parts, self.count = top, [], 0

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, vec, score))
        self.count += len(query)

    def shrink(self) -> tuple[np.ndarray, ...]:
        query, vec, score = (np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        keep = _best(query, vec, score, self.top)
        self.parts, self.count = [(query[keep], vec[keep], score[keep])], 0
        return self.parts[0]

    def overflow(self) -> Iterator[pa.RecordBatch]:
        """Hand out what is held where it is too much to keep."""
        if self.count > _HELD and len(self.shrink()[0]) > _HELD // 2:
            yield from self.batches()
            self.parts, self.count = [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in self.shrink()], ["query_id", "vec_id", "score"])


#: `query_id` is the number of a query: queries of one id with different vectors are told apart.
_FOUND = "query_id long, vec_id long, score double"


def _scan(ids: np.ndarray, queries: np.ndarray, top: int):
    """Exact search of a few stated queries, told by their positions, over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(top)
        for batch in batches:
            all_rows, all_ids = matrix(batch.column("vector")).astype(np.float64), batch.column("vec_id").to_numpy()
            for i in range(0, len(all_rows), 4096):
                rows, row_ids = all_rows[i : i + 4096], all_ids[i : i + 4096]
                x, y, score = _best_of(queries @ rows.T, queries, ids, rows, row_ids, np.argsort(row_ids, kind="stable"), top)
                held.add(x, row_ids[y], score)
                yield from held.overflow()
        yield from held.batches()

    return run


class _Bucket:
    """The filed vectors of one bucket, by leaf."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        leaf = table.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        self.rows, self.ids = matrix(table.column("vector")).astype(np.float64)[order], table.column("vec_id").to_numpy()[order]
        self.leaves, starts = np.unique(leaf[order], return_index=True)
        self.cuts, self.by_id = np.append(starts, len(leaf)).tolist(), np.argsort(self.ids, kind="stable")

    def search(self, batch: pa.RecordBatch, top: int):
        """Best of the queries of a batch over the leaves that each one visits."""
        queries, ids = matrix(batch.column("vector")).astype(np.float64), batch.column("vec_id").to_numpy()
        numbers = batch.column("number").to_numpy()
        visits = batch.column("leaves")
        query, leaf = np.repeat(np.arange(len(ids)), visits.value_lengths().to_numpy(zero_copy_only=False)), visits.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.leaves, leaf), len(self.leaves) - 1)
        here = self.leaves[at] == leaf
        query, at = query[here], at[here]
        by = np.argsort(at, kind="stable")
        query, ends = query[by], np.searchsorted(at[by], np.arange(len(self.leaves) + 1)).tolist()
        product = np.full((len(ids), len(self.rows)), -np.inf)
        for k in range(len(self.leaves)):
            if ends[k + 1] > ends[k]:
                some, a, b = query[ends[k] : ends[k + 1]], self.cuts[k], self.cuts[k + 1]
                product[some, a:b] = queries[some] @ self.rows[a:b].T
        x, y, score = _best_of(product, queries, ids, self.rows, self.ids, self.by_id, top)
        return numbers[x], self.ids[y], score


def _search(top: int):
    """Rows sorted by bucket, queries' block and `seeks`: vectors (seeks 0), then the queries that visit the bucket (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filed, of, bucket = _Held(top), [], None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "block", "seeks")])
            cuts = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))), batch.num_rows).tolist() if batch.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = (int(keys[0, a]), int(keys[1, a]))
                if key != of:
                    filed, of, bucket = [], key, None
                if not keys[2, a]:
                    filed.append(batch.slice(a, b - a))
                    continue
                if filed and bucket is None:
                    bucket = _Bucket(filed)
                for i in range(a, b if filed else a, 512):
                    held.add(*bucket.search(batch.slice(i, min(512, b - i)), top))
                    yield from held.overflow()
        yield from held.batches()

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def nearest(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20, recall: float = 0.93
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the condition `is_query` (on vec_id) holds for, its `top` nearest."""
    narrow = "float" in dict(vectors.dtypes)[vector_col]
    kind = "float" if narrow else "double"  # components that came as floats travel as floats
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), usable(F.col(vector_col)).alias("vector")).where("vec_id is not null and vector is not null")
    d = dimension(good, "vector")
    rows = good.where(F.size("vector") == d).select("vec_id", F.col("vector").cast(f"array<{kind}>").alias("vector"))
    spark = vectors.sparkSession
    total = rows.count()
    # a share of the rows by hash; the limit only guards against very many copies of one row
    by_hash = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 40))
    share = rows.where(by_hash < F.lit(int((1 << 40) * min(1.0, SAMPLE_ROWS / max(total, 1)))))
    sample = share.limit(2 * SAMPLE_ROWS).select("vector").toArrow()
    queries = checkpoint(rows.where(is_query(F.col("vec_id"))).distinct().withColumn("number", F.monotonically_increasing_id()))
    trial = queries.orderBy(by_hash, "vec_id").limit(CALIBRATION).select("vec_id", "vector").toArrow()
    if not sample.num_rows or not trial.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = matrix(sample.column("vector")).astype(np.float64)
    tree = KMeansTree(points[np.lexsort(points.T)])  # the same tree whatever order the rows came in
    shared = spark.sparkContext.broadcast(tree)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.file(matrix(batch.column("vector")).astype(np.float64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("vec_id"), batch.column("vector")], ["leaf", "vec_id", "vector"])

    index = checkpoint(rows.mapInArrow(filed, f"leaf int, vec_id long, vector array<{kind}>"))
    most = _calibrated(index, tree, trial, top, recall)

    # buckets of neighbouring leaves; a large leaf has several of its own
    sizes = np.zeros(len(tree.leaves), dtype=np.int64)
    for r in index.groupBy("leaf").count().collect():  # at most one row a leaf
        sizes[r["leaf"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // BUCKET_ROWS))
    before = np.cumsum(np.where(blocks > 1, blocks * BUCKET_ROWS, sizes)) - np.where(blocks > 1, blocks * BUCKET_ROWS, sizes)
    first = -(-before // BUCKET_ROWS) * (blocks > 1) + before // BUCKET_ROWS * (blocks == 1)
    dealt = spark.sparkContext.broadcast((first, blocks))
    number_of_queries = queries.count()
    copies = -(-number_of_queries // QUERY_ROWS)
    # few rows, but each walks the tree: dealt out by their number, not by their size
    known, queries = queries, queries.repartition(-(-number_of_queries // SEEK_ROWS), "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, number = dealt.value
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            spread = (batch.column("vec_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            bucket = begin[leaf] + spread % number[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("leaf"), batch.column("vec_id"), batch.column("vector")], ["bucket", "leaf", "vec_id", "vector"])

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (begin, number) = shared.value, dealt.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, of, buckets, lists = batch.slice(i, 256), [], [], []
                for k, query in enumerate(matrix(part.column("vector")).astype(np.float64)):
                    leaves = np.array(own.visits(query, most), dtype=np.int32)
                    times = number[leaves]
                    goes = np.repeat(begin[leaves], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    leaves, by = np.repeat(leaves, times), np.argsort(goes, kind="stable")
                    new, starts = np.unique(goes[by], return_index=True)
                    of.append(np.full(len(new), k))
                    buckets.append(new)
                    lists += np.split(leaves[by], starts[1:])
                ends = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
                taken = part.take(pa.array(np.concatenate(of)))
                visited = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), visited, *(taken.column(c) for c in ("number", "vec_id", "vector"))], ["bucket", "leaves", "number", "vec_id", "vector"])

    here = index.mapInArrow(place, f"bucket long, leaf int, vec_id long, vector array<{kind}>").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("block"), F.lit(0).alias("seeks"), "leaf", F.array().cast("array<int>").alias("leaves"), F.lit(-1).cast("long").alias("number"), "vec_id", "vector"
    )
    there = queries.mapInArrow(seek, f"bucket long, leaves array<int>, number long, vec_id long, vector array<{kind}>").select(
        "bucket", F.pmod(F.xxhash64("number"), F.lit(copies)).cast("int").alias("block"), F.lit(1).alias("seeks"), F.lit(-1).alias("leaf"), "leaves", "number", "vec_id", "vector"
    )
    met = here.union(there).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "seeks")
    best = _ranked(met.mapInArrow(_search(top), _FOUND), top).withColumnRenamed("query_id", "number")
    named = known.select("number", F.col("vec_id").alias("query_id"))
    return best.join(named.hint("merge"), "number").select("query_id", "rank", "vec_id", "score")


def _calibrated(index: DataFrame, tree: KMeansTree, trial: pa.Table, top: int, recall: float) -> int:
    """Visits by which the leaves of the trial queries' true neighbours have been reached in `recall` of the cases."""
    ids, points = trial.column("vec_id").to_numpy(), matrix(trial.column("vector")).astype(np.float64)
    true = _ranked(index.mapInArrow(_scan(ids, points, top), _FOUND), top).select("query_id", "vec_id")
    hits = index.select("vec_id", "leaf").join(F.broadcast(true), "vec_id").select("query_id", "leaf").collect()  # CALIBRATION * top short rows
    reached = {}
    for q, p in enumerate(points):
        reached[q] = np.empty(len(tree.leaves), dtype=np.int64)
        reached[q][tree.visits(p, len(tree.leaves))] = np.arange(len(tree.leaves))
    at = sorted(int(reached[r["query_id"]][r["leaf"]]) for r in hits)
    return at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)] + 1 if at else len(tree.leaves)
