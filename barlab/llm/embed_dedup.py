"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

Each of ROTATIONS random rotations is cut into `PARTS` slices, each with a codebook of random unit vectors; a filter
direction is one code word of each slice. Several small codes miss fewer pairs than one large code with as many
directions, whose products share their words. A vector goes to every filter whose cap it lies in, i.e. whose
direction it exceeds the threshold on. List decoding finds them without a look at all directions: per slice
the words' products are sorted, and only sums that can still pass are formed. Vectors that share a filter
are compared exactly, in double precision.

The threshold and the number of filters follow from the number of vectors n alone: a cap holds about
CAP_ROWS / n of the sphere, and there are so many caps that two vectors at the bound share SHARED of them
on average. A pair counts in the first filter that both have, so link counts add up without the pairs ever
leaving a task; a task also returns a spanning forest of its links for the components. Filters that hold
more vectors than a bound are dealt out as pairs of blocks. Exact copies are one node with its number.

Cases: vectors that are null, empty, zero, of unusual length or hold null or non-finite components link
with nothing and are their own component. Equal vec_ids are rows of their own; a null vec_id is linked like
any other but names no component. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import blocked, checkpoint, connected_components, group_starts, group_tables, unite
from barlab.llm.vectors import dimension, matrix, usable

PARTS, ROTATIONS = 2, 8
CAP_ROWS = 1000
#: Two isolated vectors at the bound then share none in about one of 10,000 cases.
SHARED = 24.0
#: Vectors of one filter in a block, and rows of a product matrix formed at once.
BLOCK_VECTORS, _ROWS = 4096, 512


def cap_filters(n: int, cosine: float) -> tuple[float, int]:
    """Threshold on sqrt(d) * <direction, vector> and code words per slice for n vectors."""
    normal = NormalDist()
    cap = min(0.05, max(CAP_ROWS / max(n, 1), 1e-6))
    t = normal.inv_cdf(1 - cap)
    # the share of caps that two vectors at `cosine` have in common, by integration over the first one
    z = np.linspace(t, t + 8, 4001)
    dense = np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi)
    tail = np.array([1 - normal.cdf((t - cosine * x) / math.sqrt(1 - cosine**2)) for x in z[::20]])
    both = float(np.sum(dense * np.interp(z, z[::20], tail)) * (z[1] - z[0]))
    return t, max(2, math.ceil((SHARED / ROTATIONS / both) ** (1 / PARTS)))


class ProductCodes:
    """All rotations' filters, numbered through."""

    def __init__(self, d: int, words: int, threshold: float):
        self._codes, self._size = [_ProductCode(d, words, threshold, 7 + k) for k in range(ROTATIONS)], words**PARTS

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that rows of unit vectors exceed, by row, then filter."""
        found = [code.decode(unit) for code in self._codes]
        rows = np.concatenate([r for r, _ in found])
        filters = np.concatenate([f + k * self._size for k, (_, f) in enumerate(found)])
        by = np.lexsort((filters, rows))
        return rows[by], filters[by]


class _ProductCode:
    def __init__(self, d: int, words: int, threshold: float, seed: int):
        draw = np.random.default_rng(seed)
        self._rotation = np.linalg.qr(draw.standard_normal((d, d)))[0]
        self._cuts = [d * i // PARTS for i in range(PARTS + 1)]
        self._books = []
        for a, b in zip(self._cuts[:-1], self._cuts[1:], strict=True):
            book = draw.standard_normal((words, b - a))
            # lengths as in a random unit direction of all dimensions, scaled by sqrt(d)
            self._books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt(b - a))
        self._words, self._threshold = words, threshold

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self._rotation
        scores = [turned[:, a:b] @ book.T for a, b, book in zip(self._cuts[:-1], self._cuts[1:], self._books, strict=True)]
        rows = np.arange(len(unit))
        codes, sums = np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit))
        for k, score in enumerate(scores):
            rest = sum((s.max(axis=1) for s in scores[k + 1 :]), np.zeros(len(unit)))  # what later slices can add
            need = self._threshold - sums - rest[rows]
            order = np.argsort(-score, axis=1)
            ranked = np.take_along_axis(score, order, axis=1)
            # of each partial code's row, the words whose product is large enough stand first
            number = np.zeros(len(rows), dtype=np.int64)
            for i in range(0, len(rows), 8192):
                number[i : i + 8192] = (ranked[rows[i : i + 8192]] >= need[i : i + 8192, None]).sum(axis=1)
            of = np.repeat(np.arange(len(rows)), number)
            place = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
            word = order[rows[of], place]
            codes, sums, rows = codes[of] * self._words + word, sums[of] + score[rows[of], word], rows[of]
        return rows, codes


def _decoder(d: int, words: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = ProductCodes(d, words, threshold)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                vectors = matrix(part.column("vector")).astype(np.float64)
                scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the norm
                rows, filters = code.decode(scaled / np.linalg.norm(scaled, axis=1, keepdims=True))
                number = np.bincount(rows, minlength=part.num_rows)
                ends = np.append(0, np.cumsum(number)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(filters, pa.int32()))
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(filters), taken.column("node"), taken.column("copies"), taken.column("vector"), lists.take(pa.array(rows))],
                    ["filter", "node", "copies", "vector", "filters"],
                )

    return run


def _first_shared(own: np.ndarray, x: np.ndarray, y: np.ndarray, here: int) -> np.ndarray:
    """Whether `here` is the first filter that rows x and y share; own: their sorted filters, padded with -1."""
    first = np.ones(len(x), dtype=bool)
    open_ = np.arange(len(x))
    for k in range(own.shape[1]):
        mine = own[x[open_], k]
        open_ = open_[(mine >= 0) & (mine < here)]
        if not len(open_):
            break
        met = (own[y[open_]] == own[x[open_], k][:, None]).any(axis=1)
        first[open_[met]] = False
        open_ = open_[~met]
    return first


def _linker(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in group_tables(batches, 3, 8192):
            starts = group_starts(table, 3)
            vectors = matrix(table.column("vector")).astype(np.float64)
            scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            filters, side = table.column("filter").to_numpy(), table.column("side").to_numpy()
            node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            lists = table.column("filters").combine_chunks()
            lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
            number = lists.value_lengths().to_numpy(zero_copy_only=False)
            own = np.full((len(node), number.max()), -1, dtype=np.int64)
            own[np.arange(own.shape[1])[None, :] < number[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            links, root = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                split = a + int((side[a:b] == 1).sum()) if side[a] else a
                stop = split if side[a] else b
                for i in range(a, stop, _ROWS):
                    j = min(i + _ROWS, stop)
                    left = split if side[a] else i
                    x, y = np.nonzero(unit[i:j] @ unit[left:b].T >= cosine - 1e-12)
                    x, y = x + i, y + left
                    keep = x < y
                    x, y = x[keep], y[keep]
                    exact = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                    x, y = x[exact], y[exact]
                    unite(root, x, y)
                    count = _first_shared(own, x, y, int(filters[a]))
                    np.add.at(links, x[count], copies[y[count]])
                    np.add.at(links, y[count], copies[x[count]])
            some = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], ["u", "links", "v"])

    return run


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), usable(F.col(vector_col)).alias("vector"))
    d = dimension(rows, "vector")
    alone = F.col("vector").isNull() | (F.size("vector") != d)
    distinct = rows.where(~alone).groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = checkpoint(distinct.withColumn("node", F.monotonically_increasing_id()))
    threshold, words = cap_filters(nodes.count(), cosine)
    # components that came as floats travel as floats; tasks make the same doubles of both
    narrow = "float" in dict(vectors.dtypes)[vector_col]
    sent = nodes.select("node", "copies", F.col("vector").cast("array<float>" if narrow else "array<double>").alias("vector"))
    kind = "float" if narrow else "double"
    listed = sent.mapInArrow(_decoder(d, words, threshold), f"filter long, node long, copies long, vector array<{kind}>, filters array<int>") if d else None
    if listed is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    units = blocked(listed, "filter", "node", BLOCK_VECTORS).select("filter", "p", "q", "side", "node", "copies", "vector", "filters")
    placed = units.repartition("filter", "p", "q").sortWithinPartitions("filter", "p", "q", "side", "node")
    found = checkpoint(placed.mapInArrow(_linker(cosine), "u long, links long, v long"))
    counts = found.groupBy("u").agg(F.sum("links").alias("links"))
    reached = connected_components(found.select("u", "v"))
    joined = (
        nodes.select("node", "vector", "first", "copies")
        .join(counts.hint("merge"), F.col("node") == F.col("u"), "left")
        .join(reached.withColumnRenamed("node", "n").hint("merge"), F.col("node") == F.col("n"), "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    joined = checkpoint(joined.select("node", "vector", "first", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    # materialised like the other side, so that adaptive execution can split a component of very many vectors
    smallest = checkpoint(joined.groupBy("root").agg(F.min("first").alias("component_id")))
    per_node = joined.join(smallest.hint("merge"), "root").select("vector", "n_links", "component_id")
    linked = rows.where(~alone).join(per_node.hint("merge"), "vector").select("vec_id", "n_links", "component_id")
    single = rows.where(alone).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
