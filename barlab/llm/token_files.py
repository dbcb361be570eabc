"""Token ids in binary files of patched frame-of-reference blocks, and back.

Format (little-endian), one file per range of doc_ids, in ascending order:

    magic "PFORIDS1", counts: documents, ids, blocks, exceptions (u64 each)
    per document: doc_id i64, null flag u8, number of ids u32
    per block of 128 ids: minimum u32, width u8, exceptions u8, byte offset of its packed bits u64
    packed bits of all blocks, least significant first
    per exception: position in its block u8, value less the minimum u32

A block subtracts its minimum and packs the rest at the width of its `PERCENTILE`th value; larger values
keep their low bits there and stand whole in the exception list. The offsets let a reader start anywhere.

Tasks write to the shared folder under a name of their own and then rename, so that a task that is run
again leaves the same file. Spark's binaryFile source reads the files, which may lie in any of its stores.

Cases: a null or empty text is the end id alone. Null ids come first. Equal ids are ordered by text. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.llm.common import checkpoint, shared_dir
from barlab.llm.tokens import encoder

MAGIC = b"PFORIDS1"
BLOCK = 128
PERCENTILE = 90
#: Blocks that are packed or unpacked at once.
_AT_ONCE = 8192
#: Ids in one file at most, but for a single longer document.
FILE_IDS = 8_000_000

_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u4")])
_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "u1"), ("at", "<u8")])
_PATCH = np.dtype([("place", "u1"), ("value", "<u4")])


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Heads, packed bits and exceptions of the blocks of `ids`; the last block repeats its last id."""
    heads, bits, patches, at = [], [], [], 0
    for i in range(0, len(ids), _AT_ONCE * BLOCK):
        some = ids[i : i + _AT_ONCE * BLOCK].astype("<u4")
        if len(some) % BLOCK:
            some = np.append(some, np.full(-len(some) % BLOCK, some[-1], dtype="<u4"))
        some = some.reshape(-1, BLOCK)
        low = some.min(axis=1)
        rest = some - low[:, None]
        rank = -(-PERCENTILE * BLOCK // 100) - 1
        kept = np.partition(rest, rank, axis=1)[:, rank]
        width = np.where(kept > 0, np.floor(np.log2(np.maximum(kept, 1))).astype(np.int64) + 1, 0)
        over = rest >= (np.int64(1) << width)[:, None]
        row, place = np.nonzero(over)
        head = np.zeros(len(some), dtype=_HEAD)
        head["low"], head["width"], head["exceptions"] = low, width, over.sum(axis=1)
        size = width * BLOCK // 8
        head["at"] = at + np.cumsum(size) - size
        packed = np.zeros(int(size.sum()), dtype=np.uint8)
        begin = head["at"].astype(np.int64) - at
        for w in np.unique(width):
            if w:
                of = np.flatnonzero(width == w)
                planes = np.unpackbits(rest[of].view(np.uint8).reshape(len(of), BLOCK, 4), axis=2, bitorder="little", count=None)[:, :, :w]
                rows = np.packbits(planes.reshape(len(of), -1), axis=1, bitorder="little")
                packed[begin[of][:, None] + np.arange(rows.shape[1])] = rows
        patch = np.zeros(len(row), dtype=_PATCH)
        patch["place"], patch["value"] = place, rest[row, place]
        at += len(packed)
        heads.append(head)
        bits.append(packed.tobytes())
        patches.append(patch)
    empty = [np.zeros(0, dtype=_HEAD)], [np.zeros(0, dtype=_PATCH)]
    return np.concatenate(heads or empty[0]), b"".join(bits), np.concatenate(patches or empty[1])


def decode_blocks(heads: np.ndarray, bits: np.ndarray, patches: np.ndarray, count: int) -> Iterator[np.ndarray]:
    """The ids of consecutive runs of blocks, `count` in all."""
    first = np.append(0, np.cumsum(heads["exceptions"], dtype=np.int64))
    for i in range(0, len(heads), _AT_ONCE):
        head = heads[i : i + _AT_ONCE]
        out = np.zeros((len(head), BLOCK), dtype="<u4")
        for w in np.unique(head["width"]).tolist():
            if w:
                of = np.flatnonzero(head["width"] == w)
                rows = bits[head["at"][of].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
                planes = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(of), BLOCK, w)
                whole = np.zeros((len(of), BLOCK, 32), dtype=np.uint8)
                whole[:, :, :w] = planes
                out[of] = np.packbits(whole, axis=2, bitorder="little").view("<u4")[:, :, 0]
        patch = patches[first[i] : first[min(i + _AT_ONCE, len(heads))]]
        out[np.repeat(np.arange(len(head)), head["exceptions"]), patch["place"]] = patch["value"]
        yield (out + head["low"][:, None]).reshape(-1)[: count - i * BLOCK]


def write_file(docs: np.ndarray, ids: np.ndarray) -> bytes:
    heads, bits, patches = encode_blocks(ids)
    counts = np.array([len(docs), len(ids), len(heads), len(patches)], dtype="<u8")
    return b"".join([MAGIC, counts.tobytes(), docs.tobytes(), heads.tobytes(), bits, patches.tobytes()])


def read_file(content: bytes) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """The documents' table and the ids in runs."""
    if content[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    n_docs, n_ids, n_blocks, n_patches = np.frombuffer(content, "<u8", 4, 8).tolist()
    docs = np.frombuffer(content, _DOC, n_docs, 40)
    at = 40 + docs.nbytes
    heads = np.frombuffer(content, _HEAD, n_blocks, at)
    at += heads.nbytes
    end = len(content) - n_patches * _PATCH.itemsize
    return docs, decode_blocks(heads, np.frombuffer(content, np.uint8, end - at, at), np.frombuffer(content, _PATCH, n_patches, end), n_ids)


def _writer(folder: str, path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, files = encoder(path), TaskContext.get().partitionId(), 0
        store, root = pafs.FileSystem.from_uri(folder)
        docs: list[tuple] = []
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            name = f"{root}/part-{part:07d}-{files:05d}.pfor"
            draft = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(write_file(np.array(docs, dtype=_DOC), np.concatenate(held)))
            store.move(draft, name)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([files], pa.int32()), pa.array([count], pa.int64())], ["part", "file", "ids"])

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for flat, starts in code.encode(batch.column(1)):
                lengths = np.diff(starts)
                ends = np.insert(flat, starts[1:], end_id).astype("<u4")
                held.append(ends)
                docs += [(x or 0, x is None, n + 1) for x, n in zip((next(names) for _ in range(len(lengths))), lengths.tolist(), strict=True)]
                count += len(ends)
                if count >= FILE_IDS:
                    yield flush()
                    docs, held, count, files = [], [], 0, files + 1
        if docs:
            yield flush()

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Write the ids of all documents, in ascending order of id; (part, file, ids) of each file."""
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    placed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = placed.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return checkpoint(placed.mapInArrow(_writer(folder, tokenizer, end_id), "part int, file int, ids long"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part, file = (int(x) for x in name.rsplit("/", 1)[1].removesuffix(".pfor").split("-")[1:])
            docs, runs = read_file(content.as_buffer().to_pybytes())
            size = docs["ids"].astype(np.int64)
            ends, crc, at, k = np.cumsum(size).tolist(), [0] * len(docs), 0, 0
            for run in runs:
                stop, begin = at + len(run), at
                while k < len(docs) and at < stop:
                    upto = min(ends[k], stop)
                    crc[k] = zlib.crc32(run[at - begin : upto - begin].tobytes(), crc[k])
                    at = upto
                    k += at == ends[k]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, file, np.int32)), pa.array(docs["doc_id"], mask=docs["null"].astype(bool)), pa.array(np.cumsum(size) - size), pa.array(size), pa.array(crc, pa.int64())],
                ["part", "file", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """part, file, doc_id, within, n_tokens, ids_crc32 of each document in the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")
    return files.mapInArrow(_reader, "part int, file int, doc_id long, within long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the files that this writes."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    written = write_token_files(docs, folder, tokenizer, id_col, text_col, end_id)
    # one short row for each file of some million ids; the sums before each are its first position
    order = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    first = written.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0)))
    found = read_token_files(spark, folder)
    return found.join(first.hint("merge"), ["part", "file"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
