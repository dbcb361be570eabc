"""Near-duplicate documents by SimHash fingerprints and a binary trie self-join.

Fingerprint: lower-case A-Z, words, shingles of four words with repeats, XXH64 (seed 42) of each, and a
bit where over half of the hashes have it. Two fingerprints link at `budget` or fewer differing bits.

The join: any such pair agrees on `bands - budget` of the bands that the 64 bits are cut into, so each
distinct fingerprint goes to one group per choice of bands. A group is a sub-trie below its agreeing
bits; tasks walk pairs of trie nodes together, add up differing bits, and drop a pair of nodes once the
budget is exceeded or all their leaves are known to be in one component. Tasks return a spanning
forest, never the pairs. Groups over a bound are dealt out as pairs of blocks.

Cases: null and empty texts, and texts without words, have fingerprint zero, linked like any other;
texts of under four words are one shingle. Equal rows and equal doc_ids stay as rows. A null doc_id is
linked like any other but never names a component, which is null if no member has an id. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from barlab.llm.common import blocked, checkpoint, connected_components, flatten, group_starts, group_tables, unite

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HASHES_AT_ONCE = 32_768
#: Pairs of leaves below a pair of nodes that are compared directly, and pairs of nodes expanded at once.
_DIRECT, _FRONTIER = 32, 32_768


def fingerprint_of(text: bytes | None, size: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text in UTF-8; zero without words."""
    words = (text or b"").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: max(1, n - size + 1)].tolist(), ends[min(size, n) - 1 :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), _HASHES_AT_ONCE):
        some = [digest(line[a:b], seed) for a, b in zip(starts[i : i + _HASHES_AT_ONCE], ends[i : i + _HASHES_AT_ONCE], strict=True)]
        bits = np.unpackbits(np.array(some, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts), bitorder="little").tobytes(), "little")


@F.arrow_udf(LongType())
def fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Fingerprints as signed longs of the same bits."""
    for column in texts:
        values = np.fromiter((fingerprint_of(t) for t in column.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(column))
        yield pa.array(values.view(np.int64))


def trie_forest(values: np.ndarray, pairs: np.ndarray, budget: int) -> np.ndarray:
    """Walk a binary trie's node pairs. values: uint64, sorted and distinct within each node.

    pairs: rows (a_lo, a_hi, b_lo, b_hi) of position ranges to join; equal ranges are a self-join.
    Returns for each position the smallest position that its links reach.
    """
    n = len(values)
    root = np.arange(n)
    ones: dict[int, np.ndarray] = {}
    stack = [(0, pairs.astype(np.int64), np.zeros(len(pairs), dtype=np.int8))]
    joined = False
    while stack:
        depth, nodes, spent = stack.pop()
        while len(nodes):
            if len(nodes) > _FRONTIER:
                half = len(nodes) // 2
                stack.append((depth, nodes[half:], spent[half:]))
                nodes, spent = nodes[:half], spent[:half]
                continue
            if joined and len(nodes) > 512:  # both nodes' leaves are one component already
                changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
                one = (changes[nodes[:, 1] - 1] == changes[nodes[:, 0]]) & (changes[nodes[:, 3] - 1] == changes[nodes[:, 2]])
                keep = ~(one & (root[nodes[:, 0]] == root[nodes[:, 2]]))
                nodes, spent = nodes[keep], spent[keep]
            size = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
            direct = size <= _DIRECT
            if direct.any():
                joined |= _compare(values, nodes[direct], size[direct], budget, root)
                nodes, spent = nodes[~direct], spent[~direct]
            if not len(nodes) or depth == 64:
                break
            if depth not in ones:
                ones[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
            count = ones[depth]
            a_lo, a_hi, b_lo, b_hi = nodes.T
            a_mid, b_mid = a_hi - (count[a_hi] - count[a_lo]), b_hi - (count[b_hi] - count[b_lo])
            both = a_lo != b_lo
            parts = [
                (np.stack([a_lo, a_mid, b_lo, b_mid], 1), spent),
                (np.stack([a_mid, a_hi, b_mid, b_hi], 1), spent),
                (np.stack([a_lo, a_mid, b_mid, b_hi], 1), spent + 1),
                (np.stack([a_mid, a_hi, b_lo, b_mid], 1)[both], spent[both] + 1),
            ]
            nodes, spent = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            keep = (nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (spent <= budget)
            nodes, spent, depth = nodes[keep], spent[keep], depth + 1
    return root


def _compare(values: np.ndarray, nodes: np.ndarray, size: np.ndarray, budget: int, root: np.ndarray) -> bool:
    """Compare all leaves below small pairs of nodes and unite those that link."""
    which = np.repeat(np.arange(len(nodes)), size)
    within = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    width = (nodes[:, 3] - nodes[:, 2])[which]
    x, y = nodes[which, 0] + within // width, nodes[which, 2] + within % width
    keep = (x < y) & (np.bitwise_count(values[x] ^ values[y]) <= budget)
    unite(root, x[keep], y[keep])
    return bool(keep.any())


def _walk(budget: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in group_tables(batches, 3):
            starts = group_starts(table, 3)
            values = table.column("fp").to_numpy().view(np.uint64)
            side = table.column("side").to_numpy()
            lo, hi = starts[:-1], starts[1:]
            # a unit of two blocks has the rows of side 1 first
            mid = np.where(side[lo] == 0, lo, lo + np.add.reduceat((side == 1).astype(np.int64), lo))
            self_join = side[lo] == 0
            pairs = np.stack([lo, np.where(self_join, hi, mid), mid, hi], 1)
            pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (hi - lo > 1)]
            root = trie_forest(values, pairs, budget)
            child = np.flatnonzero(root != np.arange(len(root)))
            signed = values.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[root[child]])], ["u", "v"])

    return walk


def bands_for(count: int, budget: int) -> int:
    """Number of bands: so many that groups of evenly spread fingerprints stay small."""
    bands = budget + 1
    while bands < budget + 6 and count > 4096 << (64 * (bands - budget) // bands):
        bands += 1
    return bands


def trie_links(distinct: DataFrame, budget: int = 4, block_rows: int = 32_768) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints (column fp) within `budget` bits."""
    bands = bands_for(distinct.count(), budget)
    cuts = [64 * i // bands for i in range(bands + 1)]
    keys = []
    for choice, some in enumerate(combinations(range(bands), bands - budget)):
        key, used = F.lit(choice).cast("long"), math.ceil(math.log2(math.comb(bands, budget)))
        for band in some:
            width = cuts[band + 1] - cuts[band]
            part = F.shiftrightunsigned("fp", cuts[band]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key, used = key.bitwiseOR(F.shiftleft(part, used)), used + width
        keys.append(key)
    grouped = distinct.select(F.explode(F.array(*keys)).alias("g"), "fp")
    units = blocked(grouped, "g", "fp", block_rows).select("g", "p", "q", "side", "fp")
    unsigned = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))
    placed = units.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q", "side", unsigned)
    return placed.mapInArrow(_walk(budget), "u long, v long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash) of every row, checkpointed: the texts are read and hashed once."""
    return checkpoint(docs.select(F.col(id_col).alias("doc_id"), fingerprint(text_col).alias("fp"), F.xxhash64(text_col).alias("text_hash")))


def components(signatures: DataFrame, budget: int = 4) -> DataFrame:
    """(fp, component_id, keeper_hash) for each distinct fingerprint of (doc_id, fp, text_hash).

    The keeper is the row of the smallest id; text_hash tells its text apart from others of that id. Both sides of the
    joins are materialised, so that adaptive execution can split a component of very many fingerprints.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    distinct = checkpoint(signatures.groupBy("fp").agg(first.alias("first")))
    reached = checkpoint(connected_components(trie_links(distinct.select("fp"), budget)))
    placed = distinct.join(reached.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = checkpoint(placed)
    best = checkpoint(placed.groupBy("root").agg(F.min("first").alias("best")))
    return placed.join(best.hint("merge"), "root").select("fp", F.col("best.id").alias("component_id"), F.col("best.hash").alias("keeper_hash"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    signatures = fingerprints(docs, id_col, text_col)
    found = components(signatures, budget)
    return signatures.join(found.hint("merge"), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4) -> DataFrame:
    """`docs` with one row of each component: that of the smallest id, and one if that id is repeated.

    Texts are fingerprinted once; a cheap hash of the text, which decides the fingerprint, finds the keepers again.
    """
    found = components(fingerprints(docs, id_col, text_col), budget)
    keep = found.select(F.col("component_id").alias("__id"), F.col("keeper_hash").alias("__hash")).distinct()
    marked = docs.withColumn("__own", F.xxhash64(text_col))
    kept = marked.join(keep.hint("merge"), marked[id_col].eqNullSafe(keep["__id"]) & (marked["__own"] == keep["__hash"]), "left_semi")
    return kept.dropDuplicates([id_col, "__own"]).select(*docs.columns)
