"""Removal of lines that many documents share, over levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space and with A-Z lower-cased; a key is told by 128 bits of hashes. A run is a table
of keys, bucketed and sorted by their hashes, with how many documents hold a key (up to `min_docs`) and the largest
id among them. Documents come in batches; each batch's keys are counted, dealt to the runs' buckets, and
anti-joined with each run by a merge, for which the run is neither shuffled nor sorted again: keys that a run already knows
in enough documents, and in one of a larger id, gain nothing by the batch and go. The rest become a run of their own. Two runs of one
level are merged into one of the next by a full outer merge join, again without a shuffle, so there are never more runs
than levels. Batches start at the largest ids, so a common line is settled after the first and no later batch carries it.

A line is dropped from a document if its key is known in `min_docs` documents and the document is not the one of the largest id. Each
line's hashes, written when the texts were cut, then meet the common keys, positions found come together by text, and each text's lines at other
positions are joined again. Nothing but a text's own positions is held for a text; the common keys are broadcast only where
counted under a bound.

Cases: a null or empty text is one empty line. Keys of fewer than `min_chars` code points are never dropped. Rows of one id are one document: they count once for a key,
and if theirs is the largest id, all of them keep its lines. A null id is a document smaller than all others. Repeated lines of a document count once and are
dropped or kept together; a text that loses all lines becomes empty. Empty tables give empty results. Other columns are kept; columns
n_lines and n_dropped that a table already has are replaced.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm.common import BROADCAST_ROWS, checkpoint, shared_dir

MIN_CHARS = 20
MIN_DOCS = 3
#: Batches that the query cuts its table into, by id.
BATCHES = 4
#: Keys of a batch to a bucket, about.
BUCKET_KEYS = 4_000_000
#: Texts that a task cuts at a time.
TEXTS = 256
_SPACE = " \t\n\x0b\x0c\r"
#: Stands for a null id.
_NONE = -(1 << 63)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keys_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys of all lines of all texts, and of each line its text's position and its own within the text."""
    cut = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    sizes = cut.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return pc.ascii_lower(pc.ascii_trim(cut.flatten(), characters=_SPACE)), of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _hashed(min_chars: int):
    """(doc, told, batch, text) to (doc, told, batch, pos, h, g, first) of each line that can be dropped; first: not seen above in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                keys, of, pos = keys_of(part.column("text"))
                long_ = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
                of, pos = of[long_], pos[long_].astype(np.int32)
                digests = b"".join(xxhash.xxh3_128_digest(k) for k in keys.take(pa.array(long_)).cast(pa.large_binary()).to_pylist())
                h, g = np.frombuffer(digests, dtype="<i8").reshape(-1, 2).T
                order = np.lexsort((pos, g, h, of))
                new = np.ones(len(order), dtype=bool)
                new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (of, h, g)], axis=0)
                first = np.empty(len(order), dtype=bool)
                first[order] = new
                told = [part.column(c).take(pa.array(of)) for c in ("doc", "told", "batch")]
                yield pa.RecordBatch.from_arrays([*told, pa.array(pos), pa.array(h.copy()), pa.array(g.copy()), pa.array(first)], ["doc", "told", "batch", "pos", "h", "g", "first"])

    return run


class LineRuns:
    """Runs of (h, g, docs, last), levelled: at most one run to a level between two batches.

    A document's lines must all come in one batch; batches may come in any order. `close` forgets the tables; their files stay in the shared folder.
    """

    def __init__(self, spark: SparkSession, buckets: int = 8, min_docs: int = MIN_DOCS):
        self.spark, self.buckets, self.min_docs = spark, buckets, min_docs
        self.levels: dict[int, str] = {}
        self._name = f"line_runs_{uuid.uuid4().hex}"
        self._made = 0

    def _write(self, rows: DataFrame) -> str:
        name = f"{self._name}_{self._made}"
        self._made += 1
        writer = rows.write.format("parquet").option("path", f"{shared_dir(self.spark)}/{name}")
        writer.bucketBy(self.buckets, "h", "g").sortBy("h", "g").saveAsTable(name)
        return name

    def _merged(self, one: str, other: str) -> DataFrame:
        """Both runs as one: a merge join of equal buckets, whose rows stay in their bucket."""
        a, b = self.spark.table(one), self.spark.table(other).withColumnsRenamed({"docs": "docs_b", "last": "last_b"})
        docs = F.least(F.coalesce("docs", F.lit(0)) + F.coalesce("docs_b", F.lit(0)), F.lit(self.min_docs)).cast("int")
        return a.join(b.hint("merge"), ["h", "g"], "full_outer").select("h", "g", docs.alias("docs"), F.greatest("last", "last_b").alias("last"))

    def add(self, keys: DataFrame) -> None:
        """keys: (h, g, doc: long), each pair of key and document once; no document of theirs came before."""
        counts = keys.groupBy("h", "g").agg(F.least(F.count("*"), F.lit(self.min_docs)).cast("int").alias("docs"), F.max("doc").alias("last"))
        new = counts.repartition(self.buckets, "h", "g")
        for name in self.levels.values():
            known = self.spark.table(name).where(F.col("docs") >= self.min_docs).select("h", "g", F.col("last").alias("known_last"))
            same = (new["h"] == known["h"]) & (new["g"] == known["g"]) & (F.col("known_last") >= F.col("last"))
            new = new.join(known.hint("merge"), same, "left_anti")
        run, level = self._write(new), 0
        while level in self.levels:
            held = self.levels.pop(level)
            run, old = self._write(self._merged(held, run)), (held, run)
            self._drop(*old)
            level += 1
        self.levels[level] = run

    def common(self) -> DataFrame:
        """(h, g, last): the keys of `min_docs` documents or more, materialised."""
        names = list(self.levels.values())
        if not names:
            return self.spark.createDataFrame([], "h long, g long, last long")
        while len(names) > 1:
            names = [*names[2:], self._write(self._merged(names[0], names[1]))]
        return checkpoint(self.spark.table(names[0]).where(F.col("docs") >= self.min_docs).select("h", "g", "last"))

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self._drop(*(f"{self._name}_{i}" for i in range(self._made)))
        self.levels = {}


def _distinct_keys(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """Each pair of key and document once. Only documents of several rows need a shuffle for it: all others' lines are told apart already."""
    many = checkpoint(docs.groupBy("doc").count().where("count > 1").select("doc"))
    n = many.count()
    if not n:
        return keys
    hint = "broadcast" if n <= BROADCAST_ROWS else "merge"
    one = keys.join(many.hint(hint), "doc", "left_anti")
    return one.unionByName(keys.join(many.hint(hint), "doc", "left_semi").distinct())


def hashed_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs: (doc, told, text). Their lines of `min_chars` or more as (doc, told, pos, h, g, first, batch), written once, by batch."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    bounds = docs.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)])).first()[0] or [] if batches > 1 else []
    batch = sum((F.when(F.col("doc") <= b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0)).alias("batch")
    lines = docs.select("doc", "told", batch, "text").mapInArrow(_hashed(min_chars), "doc long, told long, batch int, pos int, h long, g long, first boolean")
    lines.write.partitionBy("batch").parquet(folder)
    return spark.read.schema("doc long, told long, pos int, h long, g long, first boolean, batch int").parquet(folder)


def common_lines(lines: DataFrame, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h, g, last) of the lines that `min_docs` documents share; docs: (doc) of every row."""
    spark = lines.sparkSession
    sizes = {r["batch"]: r["count"] for r in lines.groupBy("batch").count().collect()}  # one row a batch
    runs = LineRuns(spark, max(8, -(-max(sizes.values(), default=0) // BUCKET_KEYS)), min_docs)
    keys = _distinct_keys(lines.where("first").select("batch", "doc", "h", "g"), docs)
    for b in sorted(sizes):
        runs.add(keys.where(F.col("batch") == b).select("h", "g", "doc"))
    found = runs.common()
    runs.close()
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` without the lines that stand in `min_docs` documents or more, but in the largest id's; and n_lines (before), n_dropped: long."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("doc")
    told = F.xxhash64(text_col).alias("told")  # rows of equal id and text have equal lines, so these two tell a text
    whole = docs.select(doc, told, F.col(text_col).alias("text"))
    lines = hashed_lines(whole, batches, min_chars)
    common = common_lines(lines, whole.select("doc"), min_docs)
    n = common.count()
    hits = lines.select("doc", "told", "pos", "h", "g").join(common.hint("broadcast" if n <= BROADCAST_ROWS else "merge"), ["h", "g"]).where(F.col("doc") != F.col("last"))
    # materialised, so that the join below has plain exchanges, whose large partitions adaptive execution splits
    dropped = checkpoint(hits.groupBy("doc", "told").agg(F.collect_set("pos").alias("dropped")))
    rows = docs.select(F.struct("*").alias("row"), doc, told, _lines(F.col(text_col)).alias("lines"))
    rows = rows.withColumn("row", F.col("row").dropFields(text_col)) if len(docs.columns) > 1 else rows
    met = rows.join(dropped.hint("merge"), ["doc", "told"], "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    counted = ("n_lines", "n_dropped")
    columns = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in counted]
    return met.select(*columns, F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: Numbers tell rows, and positions lines, of the tables as they lie.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT n, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT n, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT n, k.doc_id, line, pos, last IS NOT NULL AND last <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY n
"""
