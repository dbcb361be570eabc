"""Language of whole texts by prediction by partial matching under frozen statistics.

For each language a tree of byte contexts up to `ORDER` bytes counts which bytes follow. A byte costs
its code length: at the longest context that the tree has, -log2 of its count over total + distinct if it
was seen there, else the escape distinct / (total + distinct) and so on in the context one byte shorter,
down to an even chance over all bytes. The counts are frozen, so a byte's cost is a fixed function of the
ORDER + 1 bytes up to it and is tabulated for every such string that any language has seen; the few other
strings walk down the escapes. The least total code length wins.

The trees are fit on a bounded sample: of each language the `SAMPLE_DOCS` distinct labelled texts of lowest hash,
whole, as far as the texts before them have fewer than `SAMPLE_BYTES` bytes together, and one at least. So a language's sample is
bounded by that number and one text, and no text is left out for its length. The scoring is a map over all whole texts
with the trees broadcast; they are hash tables whose size follows from the strings of the sample, whatever their script.

Cases: a null text, or one without a letter, gives `und` with score 0. Rows of null lang are not learned
from. With no language learned every text is `und`. Ties go to the language first in code-point order.
Equal rows are each answered; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import BROADCAST_ROWS, checkpoint

ORDER = 3
SAMPLE_DOCS = 250
#: Bytes of a language's sample; the text that reaches them is still taken whole.
SAMPLE_BYTES = 2_000_000
#: Positions that are scored at once.
_AT_ONCE = 1 << 18


def held_out(identity: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves `part`; a null id counts as empty text."""
    return F.crc32(F.coalesce(identity.cast("string"), F.lit("")).cast("binary")) % parts == part


class ContextTrees:
    """Frozen PPM trees of several languages over strings of up to ORDER + 1 bytes."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        counts = [self._count(samples[x]) for x in self.languages]
        # cost of a byte after each known string of k bytes, by language; from short to long contexts
        self._strings, self._costs, self._escapes, self._contexts = [], [], [], []
        n = len(self.languages)
        for k in range(ORDER + 1):
            strings = np.unique(np.concatenate([c[k][0] for c in counts] or [np.empty(0, np.uint64)]))
            contexts = strings >> np.uint64(8)
            known = np.unique(contexts)
            escape = np.zeros((len(known), n), dtype=np.float32)
            cost = np.zeros((len(strings), n), dtype=np.float32)
            shorter = self._known_costs(strings & np.uint64((1 << 8 * k) - 1), k - 1)
            for j, tables in enumerate(counts):
                own, number = tables[k]
                at = np.searchsorted(known, own >> np.uint64(8))
                total, distinct = np.bincount(at, number, len(known)), np.bincount(at, minlength=len(known))
                seen = total > 0
                escape[seen, j] = -np.log2(distinct[seen] / (total + distinct)[seen])
                count = np.zeros(len(strings))
                count[np.searchsorted(strings, own)] = number
                of = np.searchsorted(known, contexts)
                whole = (total + distinct)[of]
                cost[:, j] = np.where(count > 0, -np.log2(np.maximum(count, 1) / np.maximum(whole, 1)), escape[of, j] + shorter[:, j])
            self._strings.append(strings)
            self._costs.append(cost)
            self._contexts.append(known)
            self._escapes.append(escape)
        self._prepare()

    @staticmethod
    def _count(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for k in range(ORDER + 1):
            parts = [_windows(np.frombuffer(b"\n" * ORDER + t, np.uint8), k + 1)[ORDER - k :] for t in texts]
            out.append(np.unique(np.concatenate(parts or [np.empty(0, np.uint64)]), return_counts=True))
        return out

    def _known_costs(self, strings: np.ndarray, k: int) -> np.ndarray:
        """Costs of strings of k + 1 bytes by search; below order 0 an even chance."""
        n = len(self.languages)
        if k < 0:
            return np.full((len(strings), n), 8.0, dtype=np.float32)
        known, out = self._strings[k], np.empty((len(strings), n), dtype=np.float32)
        at = np.minimum(np.searchsorted(known, strings), max(len(known) - 1, 0))
        hit = known[at] == strings if len(known) else np.zeros(len(strings), dtype=bool)
        out[hit] = self._costs[k][at[hit]]
        if not hit.all():
            miss = strings[~hit]
            below = self._known_costs(miss & np.uint64((1 << 8 * k) - 1), k - 1)
            contexts = self._contexts[k]
            at = np.minimum(np.searchsorted(contexts, miss >> np.uint64(8)), max(len(contexts) - 1, 0))
            found = contexts[at] == miss >> np.uint64(8) if len(contexts) else np.zeros(len(miss), dtype=bool)
            below[found] += self._escapes[k][at[found]]
            out[~hit] = below
        return out

    def _prepare(self) -> None:
        """A hash table of the longest strings, in place of a search."""
        self._longest = StringTable(self._strings[ORDER].astype(np.uint32))
        self._table = np.vstack([self._costs[ORDER], np.zeros((1, len(self.languages)), dtype=np.float32)])

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Bits that each language needs for the whole text."""
        total = np.zeros(len(self.languages))
        data = np.frombuffer(b"\n" * ORDER + text, np.uint8)
        for i in range(0, len(text), _AT_ONCE):
            piece = data[i : i + _AT_ONCE + ORDER].astype(np.uint32)
            strings = (piece[:-3] << 24) | (piece[1:-2] << 16) | (piece[2:-1] << 8) | piece[3:]
            at = self._longest.find(strings)
            # a large table's rows are counted only where that is less work than to add them up
            uses = np.bincount(at, minlength=len(self._table)) if len(at) * 4 > len(self._table) else None
            total += uses @ self._table if uses is not None else self._table[at].sum(axis=0, dtype=np.float64)
            miss = np.flatnonzero(at == len(self._table) - 1)
            if len(miss):
                total += self._known_costs(strings[miss].astype(np.uint64), ORDER).sum(axis=0, dtype=np.float64)
        return total


class StringTable:
    """Positions of distinct 32-bit numbers by hashing with linear probes; two to four slots to a number."""

    def __init__(self, strings: np.ndarray):
        bits = max(4, int(len(strings) * 2).bit_length())
        self._shift, self._mask = np.uint32(32 - bits), np.int64((1 << bits) - 1)
        self._keys, self._at = np.zeros(1 << bits, dtype=np.uint32), np.full(1 << bits, len(strings), dtype=np.int32)
        self._none = len(strings)
        open_ = np.arange(len(strings))
        slot = self._slot(strings)
        while len(open_):
            free = np.flatnonzero(self._at[slot] == self._none)
            taken, first = np.unique(slot[free], return_index=True)
            here = free[first]
            self._keys[taken], self._at[taken] = strings[open_[here]], open_[here]
            left = np.ones(len(open_), dtype=bool)
            left[here] = False
            open_, slot = open_[left], (slot[left] + 1) & self._mask

    def _slot(self, strings: np.ndarray) -> np.ndarray:
        return ((strings * np.uint32(0x9E3779B1)) >> self._shift).astype(np.int64)

    def find(self, strings: np.ndarray) -> np.ndarray:
        """The position of each string; the number of all strings where it is unknown."""
        slot = self._slot(strings)
        out = self._at[slot]
        open_ = np.flatnonzero((self._keys[slot] != strings) & (out != self._none))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self._mask
            out[open_] = self._at[slot]
            more = (self._keys[slot] != strings[open_]) & (out[open_] != self._none)
            open_, slot = open_[more], slot[more]
        return out


def _windows(data: np.ndarray, size: int) -> np.ndarray:
    """All strings of `size` bytes as numbers."""
    n = max(len(data) - size + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> ContextTrees:
    """Trees from up to `sample` distinct texts of each language, those that hash lowest, within `sample_bytes` and one text."""
    keyed = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    distinct = checkpoint(keyed.groupBy("lang", "h").agg(F.min(F.octet_length("text")).alias("bytes")))
    # a bound on the hash leaves about four times the sample of each language, so that no task ranks rows of all partitions
    numbers = checkpoint(distinct.groupBy("lang").agg(F.count("*").alias("n")))
    low = (F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * F.col("n") <= 4 * sample
    few = distinct.join(numbers.hint("broadcast" if numbers.count() <= BROADCAST_ROWS else "merge"), "lang").where(low).drop("n")
    order = Window.partitionBy("lang").orderBy("h")
    lowest = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)  # at most `sample` short rows of a language go on
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = checkpoint(lowest.withColumn("before", before).where(F.col("before") < sample_bytes).select("lang", "h"))
    texts = keyed.join(chosen.hint("broadcast" if chosen.count() <= BROADCAST_ROWS else "merge"), ["lang", "h"]).dropDuplicates(["lang", "h"])
    samples: dict[str, list[bytes]] = {}
    for row in texts.select("lang", F.col("text").cast("binary").alias("text")).toLocalIterator():
        samples.setdefault(row["lang"], []).append(bytes(row["text"]))
    return ContextTrees(samples)


def predict(docs: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row: the winner's share of the languages' chances per byte-scaled length."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ContextTrees = shared.value
        for batch in batches:
            names, scores = [], []
            letters = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_pylist()
            for text, has in zip(batch.column(1).cast(pa.binary()), letters, strict=True):
                if not has or not own.languages:
                    names.append("und")
                    scores.append(0.0)
                    continue
                bits = own.code_lengths(text.as_py())
                best = int(np.argmin(bits))
                # chances of the languages, with a text's evidence counted as that of its root's length
                names.append(own.languages[best])
                scores.append(float(1 / np.exp2(-np.minimum((bits - bits[best]) / np.sqrt(len(text.as_py())), 1000)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows outside fold `fold` that have a language."""
    trees = fit(docs.where(~held_out(F.col(id_col), folds, fold)), text_col, lang_col)
    found = predict(docs, trees, id_col, text_col)
    return found.withColumn("held_out", held_out(F.col("doc_id"), folds, fold)).select("doc_id", "held_out", "lang_pred", "score")
