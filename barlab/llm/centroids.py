"""Clusters of integer vectors around centroids, assigned through a VA-file.

Every vector is kept beside its approximation: BITS bits a dimension that tell the cell its component lies in, packed, and its
squared length. A cell's bounds are exact, so a table of 2^BITS entries a dimension holds, for each centroid, the
least and the most that a component of the cell adds to the distance. Adding up table entries over a vector's cells
gives an interval for its distance to each centroid. Where one centroid's interval ends before all others begin, the cells
alone decide; only for the other vectors is the full vector fetched, and compared with the centroids whose intervals overlap the
best one. Tables are centred: what all centroids have in common, the distance to their mean, cancels and widens nothing.

A pass over the index is narrow: no vector is shuffled. Each task adds up its vectors by cluster, and only these sums, a
row for each centroid and dimension, go on. Approximations and vectors lie in one table as random access to single
vectors would cost a shuffle of all. The means need all components, so a pass that moves centroids adds up stored
components, but computes no distances from them.

Cases: a vector is kept if it has exactly `dims` components, none of them null or non-finite, and none that scaled leaves
+-LIMIT (its distance might leave 64 bits). A null id may have a vector, which is assigned, but seeds no centroid. Repeated rows each count, as seeds
too (ties of the hash go by the vectors). With fewer vectors than centroids there are as many centroids as vectors. Empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm.common import checkpoint
from barlab.llm.vectors import matrix

BITS = 6
#: Components are at most so large after scaling: 64 squares of twice this stay below 2^63.
LIMIT = 1 << 27
#: Vectors that a task has open at a time.
ROWS = 4096


def scaled(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of all components as array<int>, or null if the vector is not kept."""
    doubles = vector.cast("array<double>")
    # a comparison with NaN holds in Spark for "greater", so that NaN and both infinities fail here
    good = F.forall(doubles, lambda x: x.isNotNull() & (F.abs(x) <= F.lit(LIMIT / scale)))
    return F.when((F.size(doubles) == dims) & good, F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))).cast("int")))


class Cells:
    """Cells of each dimension: marks[j] are the last values of all cells but the last; low, high: bounds of cells, (dims, 2^bits)."""

    def __init__(self, marks: list[np.ndarray], least: np.ndarray, most: np.ndarray, bits: int = BITS):
        self.bits, self.marks = bits, marks
        self.low, self.high = np.zeros((len(marks), 1 << bits), dtype=np.int64), np.zeros((len(marks), 1 << bits), dtype=np.int64)
        for j, m in enumerate(marks):
            self.low[j, : len(m) + 1] = np.append(least[j], m + 1)
            self.high[j, : len(m) + 1] = np.append(m, most[j])

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """Packed cells of vectors, one row of bytes each."""
        cells = np.stack([np.searchsorted(m, rows[:, j]) for j, m in enumerate(self.marks)], axis=1).astype(np.uint8)
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return np.packbits(bits.reshape(len(rows), -1), axis=1)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(packed, axis=1)[:, : len(self.marks) * self.bits].reshape(len(packed), len(self.marks), self.bits)
        return bits @ (1 << np.arange(self.bits)[::-1]).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centre, least, most): with y = x - centre, what a component in a cell adds to |y - c|^2 - |y|^2, by (dimension, cell, centroid)."""
        centre = centroids.sum(axis=0) // len(centroids)
        c = (centroids - centre).T[:, None, :]
        ends = [c * c - 2 * c * (bound - centre[:, None])[:, :, None] for bound in (self.low, self.high)]
        return centre, np.minimum(*ends), np.maximum(*ends)


def intervals(cells: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the intervals for the distance to each centroid, less the squared distance to the centre, which they share."""
    low, high = np.zeros((len(cells), least.shape[2]), dtype=np.int64), np.zeros((len(cells), least.shape[2]), dtype=np.int64)
    for j in range(cells.shape[1]):
        low += least[j][cells[:, j]]
        high += most[j][cells[:, j]]
    return low, high


def assign(cells: np.ndarray, fetch, tables: tuple[np.ndarray, ...], centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each vector, ties to the smaller number, and how many vectors were fetched: `fetch(positions)`."""
    _, least, most = tables
    low, high = intervals(cells, least, most)
    near = low <= high.min(axis=1)[:, None]
    own = near.argmax(axis=1)
    open_ = np.flatnonzero(near.sum(axis=1) > 1)
    if len(open_):
        vectors = fetch(open_)
        x, k = np.nonzero(near[open_])
        distance = np.full((len(open_), len(centroids)), np.iinfo(np.int64).max)
        distance[x, k] = ((vectors[x] - centroids[k]) ** 2).sum(axis=1)
        own[open_] = distance.argmin(axis=1)
    return own, len(open_)


def _packed(column: pa.Array) -> np.ndarray:
    """Binary values of equal length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _assigned(batches: Iterator[pa.RecordBatch], cells: Cells, centroids: np.ndarray):
    """Batches in short runs with their clusters and the way to their full vectors."""
    tables = cells.tables(centroids)
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            vectors = part.column("vector")
            fetch = lambda at, v=vectors: matrix(v.take(pa.array(at))).astype(np.int64)
            own, _ = assign(cells.unpack(_packed(part.column("cells"))), fetch, tables, centroids)
            yield part, own


def _sums(cells: Cells, centroids: np.ndarray):
    """Rows (cluster, position, total, rows) of a task: sums of its vectors' components by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        total, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for part, own in _assigned(batches, cells, centroids):
            order = np.argsort(own, kind="stable")
            held, starts = np.unique(own[order], return_index=True)
            total[held] += np.add.reduceat(matrix(part.column("vector"))[order], starts, axis=0, dtype=np.int64)
            count += np.bincount(own, minlength=k)
        cluster, position = np.divmod(np.arange(k * dims), dims)
        full = count[cluster] > 0
        columns = [cluster[full].astype(np.int32), position[full].astype(np.int32), total.ravel()[full], count[cluster][full]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "position", "total", "rows"])

    return run


def _distances(cells: Cells, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _assigned(batches, cells, centroids):
            distance = ((matrix(part.column("vector")).astype(np.int64) - centroids[own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def va_file(rows: DataFrame, dims: int, bits: int = BITS) -> tuple[DataFrame, Cells]:
    """rows: (vec_id, vector array<int>). The index (vec_id, cells, vector) and its cells, whose marks are quantiles over all rows.

    Marks decide how narrow the cells are, never which vectors a cell's bounds hold: those are exact.
    """
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    by_dim = rows.select(F.posexplode("vector").alias("j", "x")).groupBy("j").agg(F.percentile_approx("x", shares).alias("marks"), F.min("x").alias("least"), F.max("x").alias("most"))
    found = sorted(by_dim.collect())  # one short row a dimension
    marks = [np.unique(np.array(r["marks"], dtype=np.int64)) for r in found]
    cells = Cells([m[m < r["most"]] for m, r in zip(marks, found, strict=True)], np.array([r["least"] for r in found]), np.array([r["most"] for r in found]), bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x.tobytes() for x in cells.pack(matrix(batch.column("vector")))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary()), batch.column("vector")], ["vec_id", "cells", "vector"])

    return checkpoint(rows.mapInArrow(pack, "vec_id long, cells binary, vector array<int>")), cells


def seeds(rows: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in the order of these."""
    by = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "vector")
    return np.array([r["vector"] for r in by.orderBy("h", "vector").limit(k).collect()], dtype=np.int64)


def moved(index: DataFrame, cells: Cells, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of the means of their vectors; those without vectors stay."""
    sums = index.mapInArrow(_sums(cells, centroids), "cluster int, position int, total long, rows long")
    total = sums.groupBy("cluster", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows"))
    out = centroids.copy()
    for r in total.collect():  # at most one row for each centroid and dimension
        out[r["cluster"], r["position"]] = int(r["total"]) // r["rows"]
    return out


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector, after `rounds` rounds."""
    spark: SparkSession = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), dims, scale).alias("vector")).where("vector is not null")
    centroids = seeds(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], _RESULT)
    index, cells = va_file(rows, dims)
    for _ in range(rounds):
        centroids = moved(index, cells, centroids)
    out = checkpoint(index.mapInArrow(_distances(cells, centroids), "vec_id long, cluster int, distance long"))
    sums = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(c, d, sum(sums.values()), digests[c]) for c, d in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a centroid


def _oracle(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """The same in SQL: squared distances by inner products of whole numbers, which doubles hold exactly."""
    kept = f"len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings WHERE {kept})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w FROM (SELECT v, sha256('1:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"d{r} AS (SELECT vec_id, v, c, (list_inner_product(v, v) - 2 * list_inner_product(v, w) + list_inner_product(w, w))::BIGINT AS distance FROM kept CROSS JOIN c{r} "
            "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1)"
        )
        if r < rounds:
            parts.append(
                f"s{r} AS (SELECT c, j, sum(x)::BIGINT AS total, count(*) AS n FROM (SELECT c, unnest(v)::BIGINT AS x, generate_subscripts(v, 1) AS j FROM d{r}) GROUP BY c, j), "
                f"m{r} AS (SELECT c, list(((total - ((total % n) + n) % n) // n)::DOUBLE ORDER BY j) AS w FROM s{r} GROUP BY c), "
                f"c{r + 1} AS (SELECT c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (c))"
            )
    last = f"d{rounds}"
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(list_transform(w, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} USING (c)"
    )


ORACLE_SQL = _oracle()
