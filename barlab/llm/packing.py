"""Best-fit packing of tokenised documents into sequences, by hierarchical residual rounds.

A document is its token ids and an end id; longer ones are cut into pieces of `capacity`. Each partition
packs its pieces best-fit, longest first, into bins and emits those that are nearly full. The underfull
bins go on as items: partitions merge `FAN_IN` at a time and pack again, round by round up a tree to
its root, whatever a level gains. Tasks take pieces in windows of bounded number; where a level's tasks would
get more than a window each, all open bins are dealt anew by a hash instead, half a window to a task, so that
each task has bins of all sizes from all partitions. The walk goes on until one task has seen all open bins, or such
a deal makes no fewer bins. Each round is checkpointed, so its choices stand whatever is lost later.

Cases: a null or empty text is the end id alone, one piece of length 1. Equal rows and equal ids are packed
each. Null ids stay null. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import checkpoint
from barlab.llm.tokens import encoder

FAN_IN = 8
#: Pieces that a task packs at once.
WINDOW = 65_536
#: A bin is nearly full if at most this share of its capacity is free.
SLACK = 1 / 256

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BIN = "bin long, place long, part int, full boolean"


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, into the open bin whose free space fits it most tightly."""
    bins = np.empty(len(lengths), dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free = 0  # bit k: a bin with k free
    made = 0
    for i, n in zip(order := np.argsort(-lengths, kind="stable").tolist(), lengths[order].tolist(), strict=True):
        fitting = free >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                free ^= 1 << room
        else:
            room, b = capacity, made
            made += 1
        bins[i] = b
        if left := room - n:
            open_[left].append(b)
            free |= 1 << left
    return bins


def _pack(table: pa.Table, items: np.ndarray, capacity: int, first_bin: int) -> tuple[pa.Table, np.ndarray, int]:
    """Pack items, runs of pieces of a table. items: the first row of each, and the end.

    An underfull bin is one item; where its pieces by themselves pack into fewer bins, it is dissolved.
    Returns the pieces by bin with columns bin and place, whether each one's bin is nearly full, and
    the number of bins.
    """
    length = table.column("length").to_numpy()
    sizes = np.add.reduceat(length, items[:-1])
    of_item = best_fit(sizes, capacity)
    of_row = np.repeat(of_item, np.diff(items))
    if len(items) <= len(length) and (apart := best_fit(length, capacity)).max() < of_item.max():
        of_row = apart
    order = np.argsort(of_row, kind="stable")
    table, of_row, length = table.take(order), of_row[order], length[order]
    starts = np.flatnonzero(np.append(True, of_row[1:] != of_row[:-1]))
    total, before = np.add.reduceat(length, starts), np.cumsum(length) - length
    runs = np.diff(np.append(starts, len(length)))
    place = before - np.repeat(before[starts], runs)
    full = np.repeat(total >= capacity - int(capacity * SLACK), runs)
    table = table.append_column("bin", pa.array(of_row + first_bin)).append_column("place", pa.array(place))
    return table, full, len(starts)


def _emit(table: pa.Table, full: np.ndarray, part: int) -> list[pa.RecordBatch]:
    marked = table.append_column("part", pa.array(np.full(len(full), part, dtype=np.int32))).append_column("full", pa.array(full))
    return marked.combine_chunks().to_batches(max_chunksize=20_000)


def _rounds(tables: Iterator[pa.Table], capacity: int, level: int, window: int) -> Iterator[pa.RecordBatch]:
    """Pack windows of pieces with what the window before left open; `bin` tells the pieces of an item."""
    part = TaskContext.get().partitionId()
    first = (level << 50) | (part << 28)
    held: pa.Table | None = None
    for table in tables:
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        item = table.column("bin").to_numpy()
        items = np.append(np.flatnonzero(np.append(True, item[1:] != item[:-1])), len(item))
        packed, full, made = _pack(table.drop_columns(["bin"]), items, capacity, first)
        first += made
        if full.any():
            yield from _emit(packed.filter(pa.array(full)), full[full], part)
        held = packed.filter(pa.array(~full)).drop_columns(["place"])
        held = held if held.num_rows else None
        if held is not None and held.num_rows > window:  # too many stay open to carry on: their turn comes a round later
            yield from _leave(held, part)
            held = None
    if held is not None:
        yield from _leave(held, part)


def _leave(held: pa.Table, part: int) -> list[pa.RecordBatch]:
    """Open bins as they are, with their places."""
    of_row, length = held.column("bin").to_numpy(), held.column("length").to_numpy()
    starts = np.flatnonzero(np.append(True, of_row[1:] != of_row[:-1]))
    before = np.cumsum(length) - length
    place = before - np.repeat(before[starts], np.diff(np.append(starts, len(length))))
    return _emit(held.append_column("place", pa.array(place)), np.zeros(len(length), dtype=bool), part)


def _first(path: str, capacity: int, end_id: int, window: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        code = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []
        item = -1  # below all bin numbers
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for flat, starts in code.encode(batch.column(1)):
                blob, cuts = flat.tobytes(), (starts * 4).tolist()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    doc, own = next(ids), blob[a:b] + end
                    for k in range(0, len(own), 4 * capacity):
                        piece = own[k : k + 4 * capacity]
                        rows.append((doc, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece), item))
                        item -= 1
                    if len(rows) >= window:
                        yield _table(rows)
                        rows = []
        if rows:
            yield _table(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rounds(pieces(batches), capacity, 0, window)

    return run


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _again(capacity: int, level: int, window: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        from barlab.llm.common import group_tables

        for table in group_tables(batches, 1, window):
            yield table.select(["doc_id", "piece", "start", "length", "ids_crc32", "bin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rounds(windows(batches), capacity, level, window)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    schema = f"{_PIECE}, {_BIN}"
    now = checkpoint(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_first(tokenizer, capacity, end_id, window), schema))
    done = now.where("full")
    size = lambda df: df.agg(F.count_distinct("bin"), F.count("*")).first()
    parts, level = max(1, now.rdd.getNumPartitions()), 0
    left = now.where("not full")
    count, pieces = size(left)
    stuck = 0
    while count > 1 and (parts > 1 or pieces > window):
        level += 1
        if dealt := pieces > window * -(-parts // FAN_IN):
            parts = -(-2 * pieces // window)
            placed = left.repartition(parts, "bin", F.lit(level))
        else:
            parts = -(-parts // FAN_IN)
            placed = left.withColumn("part", (F.col("part") / FAN_IN).cast("int")).repartition(parts, "part")
        columns = ["bin", "doc_id", "piece", "start", "length", "ids_crc32"]
        placed = placed.sortWithinPartitions("bin", "place").select(*columns)
        now = checkpoint(placed.mapInArrow(_again(capacity, level, window), schema))
        done, left = done.union(now.where("full")), now.where("not full")
        before, (count, pieces) = count, size(left)
        # a deal may be unlucky; the walk ends after two in a row that made no fewer bins
        stuck = stuck + 1 if dealt and size(now)[0] >= before else 0
        if stuck == 2:
            break
    return done.union(left).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
