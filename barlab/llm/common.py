"""Helpers that several operators share: durable cuts, group streams, graph components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one group that a single task takes at most; larger groups go out as pairs of blocks.
BLOCK_ROWS = 32_768

#: A side of a join is broadcast only if it was counted and has at most so many short rows.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a fresh local one in local mode alone (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder, so that lost executors lose nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def lookup_join(left: DataFrame, small: DataFrame, on: str, rows: int, null_safe: bool = False) -> DataFrame:
    """Left join to a table of `rows` counted rows: broadcast within the bound, sort-merge beyond it."""
    hint = "broadcast" if rows <= BROADCAST_ROWS else "merge"
    if not null_safe:
        return left.join(small.hint(hint), on, "left")
    other = small.withColumnRenamed(on, f"__{on}")
    return left.join(other.hint(hint), left[on].eqNullSafe(other[f"__{on}"]), "left").drop(f"__{on}")


def group_tables(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 65_536) -> Iterator[pa.Table]:
    """Join batches sorted by their first `keys` columns into tables that hold whole groups.

    A table has about `rows` rows, or one group, whose size the caller has bounded.
    """
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        last = np.zeros(table.num_rows, dtype=bool)
        for i in range(keys):
            column = table.column(i).to_numpy()
            last |= column != column[-1]
        differing = np.flatnonzero(last)
        cut = int(differing[-1]) + 1 if len(differing) else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, count = [rest], 0 if cut else rest.num_rows
    if held and (table := pa.concat_tables(held).combine_chunks()).num_rows:
        yield table


def group_starts(table: pa.Table, keys: int) -> np.ndarray:
    """Positions at which a new group starts, and the end."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for i in range(keys):
        column = table.column(i).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def blocked(df: DataFrame, key: str, item: str, limit: int = BLOCK_ROWS) -> DataFrame:
    """Rows with their work unit: columns p, q (blocks of the group `key`) and side.

    A group of up to `limit` rows is one unit (0, 0). A larger one is split by a hash of `item` into
    blocks, and each pair of blocks p <= q is a unit; side is 0 if p = q, else 1 for p and 2 for q.
    So every pair of rows of a group meets in exactly one unit and no unit is much above 2 * `limit`.
    """
    spark = df.sparkSession
    large = df.groupBy(key).count().where(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).alias("blocks"))
    large = checkpoint(large)
    whole = [F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side")]
    if large.isEmpty():
        return df.select("*", *whole)
    n = large.count()
    hint = "broadcast" if n <= BROADCAST_ROWS else "merge"
    marked = df.join(large.hint(hint), key, "left")
    one = marked.where(F.col("blocks").isNull()).drop("blocks").select("*", *whole)
    own = F.pmod(F.xxhash64(F.col(item)), F.col("blocks")).cast("int")
    many = (
        marked.where(F.col("blocks").isNotNull())
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        .withColumn("p", F.least("own", "other"))
        .withColumn("q", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2))
        .drop("blocks", "own", "other")
    )
    return one.unionByName(many)


def flatten(root: np.ndarray) -> None:
    while not np.array_equal(up := root[root], root):
        root[:] = up


def unite(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Union of x[i] with y[i] for all i in the flat forest `root` (each position's smallest member)."""
    while len(x):
        a, b = root[x], root[y]
        if not (open_ := a != b).any():
            return
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        flatten(root)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of `edges` (u, v: long); root is the component's smallest node.

    Alternating large-star and small-star rounds; every round is a few shuffles of edges with map-side
    minima, and is checkpointed. The minima are materialised before their join: only then are both sides
    of the sort-merge join plain exchanges, whose large partitions (hubs) adaptive execution splits.
    """
    now = checkpoint(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        both = now.union(now.select("v", "u"))
        least = checkpoint(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = (
            both.where(F.col("v") > F.col("u")).join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = checkpoint(large)
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.hint("merge"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
