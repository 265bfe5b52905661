"""Token-ID files (operator 5): documents in id order, their ids in frames of independent coded blocks.

The pipeline gives another order, that of training. A shard is one range of it; it holds frames of whole documents, and a frame holds a document
table and blocks of at most a million ids, coded by the mixing range coder, each with a checksum of its ids
and one of its bytes. Shards are written as Parquet files with one frame per row, so that Spark's
committer deals with lost and repeated tasks, any store that Spark can write works, and the frames of a
shard can be read by many tasks.

    frame: magic, version, counts | per document: id, whether it is null, ids | per block: ids, bytes,
           checksum of the ids, checksum of the bytes | the blocks' bytes | checksum of all before it

The text is shuffled once, to the ranges of document ids. Where a document starts among all documents is
the place in its shard plus the ids of the shards before it; the shard sizes are all that the driver sees.

Defined cases: a null text is an empty one, and such a document consists of the end id; null ids come
first; documents with the same id stand in the order of their texts' hashes, then texts; repeated rows are
written again each time; a long document is a frame of its own with many blocks; an empty table gives
no files that hold rows, and reading them gives an empty result. Only the two columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plotweave.llm.memory import returns_memory
from plotweave.llm.mixing_coder import BLOCK_IDS, decode_blocks, encode_blocks
from plotweave.llm.tokens import encoder
from plotweave.session import scratch_path, ship, small_batches

MAGIC, VERSION = b"PWTK", 2
END_ID = 0
# Ids that a frame of several documents has at most, bytes of text per shard, and those that are encoded at a time.
FRAME_IDS = BLOCK_IDS
SHARD_BYTES = 16 << 20
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20

_HEAD = struct.Struct("<4sHHII")
_COLUMNS = "shard long, frame long, n_docs long, n_ids long, start long, data binary"


def _blocks(ids: np.ndarray) -> list[np.ndarray]:
    return np.array_split(ids, -(-len(ids) // BLOCK_IDS)) if len(ids) else []


def pack_frame(doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, blocks: list[np.ndarray], payloads: list[bytes]) -> bytes:
    table = np.array([(len(b), len(p), zlib.crc32(b.astype("<u4")), zlib.crc32(p)) for b, p in zip(blocks, payloads)], "<u4").reshape(-1, 4)
    head = _HEAD.pack(MAGIC, VERSION, 0, len(doc_ids), len(blocks))
    body = b"".join([head, doc_ids.astype("<i8").tobytes(), nulls.astype("<u1").tobytes(), sizes.astype("<u8").tobytes(), table.tobytes(), *payloads])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_frame(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Document ids, nulls and sizes, the block table and the blocks' bytes, their checksums tested."""
    magic, version, _, n_docs, n_blocks = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a frame of token ids")
    if struct.unpack_from("<I", data, len(data) - 4)[0] != zlib.crc32(memoryview(data)[:-4]):
        raise ValueError("frame is damaged")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    nulls = np.frombuffer(data, "<u1", n_docs, at + 8 * n_docs)
    sizes = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    table = np.frombuffer(data, "<u4", 4 * n_blocks, at).reshape(-1, 4)
    at += 16 * n_blocks
    past = at + np.cumsum(table[:, 1].astype(np.int64))
    payloads = [data[p - int(s) : p] for p, s in zip(past.tolist(), table[:, 1])]
    for p, crc in zip(payloads, table[:, 3]):
        if zlib.crc32(p) != crc:
            raise ValueError("block is damaged")
    return doc_ids, nulls, sizes, table, payloads


def unpack_many(frames: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, nulls, sizes and all ids of each frame."""
    for data in frames:
        doc_ids, nulls, sizes, table, payloads = unpack_frame(data)
        own = decode_blocks(payloads, table[:, 0].tolist())
        for b, crc in zip(own, table[:, 2]):
            if zlib.crc32(b.astype("<u4")) != crc:
                raise ValueError("block does not decode to its ids")
        yield doc_ids, nulls, sizes, np.concatenate(own) if own else np.zeros(0, np.uint32)


def _portions(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of some batches put together: encoding many texts at a time costs less."""
    held: list[pa.RecordBatch] = []
    size = 0

    def together() -> tuple[pa.Array, pa.Array]:
        nonlocal held, size
        out = tuple(pa.concat_arrays([h.column(k) for h in held]) for k in range(2))
        held, size = [], 0
        return out

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(1).nbytes
        if size >= BATCH_BYTES:
            yield together()
    if held:
        yield together()


def _frames(batches: Iterable[pa.RecordBatch], tokenizer: str, shard: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Documents of a shard in order, encoded, as rows of frames."""
    coder = encoder(tokenizer)
    number = start = open_size = 0
    open_docs: list[tuple] = []

    def frame() -> pa.RecordBatch:
        nonlocal number, start, open_docs, open_size
        doc_ids, nulls, sizes, ids = (np.concatenate(c) for c in zip(*open_docs))
        blocks = _blocks(ids)
        data = pack_frame(doc_ids, nulls, sizes, blocks, encode_blocks(blocks))
        out = pa.RecordBatch.from_arrays(
            [*[pa.array([v], pa.int64()) for v in (shard, number, len(sizes), len(ids), start)], pa.array([data], pa.binary())],
            ["shard", "frame", "n_docs", "n_ids", "start", "data"],
        )
        number, start, open_docs, open_size = number + 1, start + len(ids), [], 0
        return out

    for column, texts in _portions(batches):
        doc_ids, nulls = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
        bare, border = coder.encode_column(texts)
        ids = np.full(len(bare) + len(texts), end_id, np.uint16 if coder.size <= 1 << 16 else np.uint32)
        for k, (a, b) in enumerate(zip(border[:-1].tolist(), border[1:].tolist())):
            ids[a + k : b + k] = bare[a:b]
        border = border + np.arange(len(border))
        # not needed while blocks are coded
        del texts, bare
        lo = 0
        while lo < len(doc_ids):
            hi = int(np.searchsorted(border, border[lo] + FRAME_IDS - open_size, side="right")) - 1
            if hi <= lo and open_size:
                yield frame()
                continue
            hi = max(hi, lo + 1)
            open_docs.append((doc_ids[lo:hi], nulls[lo:hi], np.diff(border[lo : hi + 1]), ids[border[lo] : border[hi]]))
            open_size += int(border[hi] - border[lo])
            lo = hi
    if open_docs:
        yield frame()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, order: Sequence[Column] | None = None) -> None:
    """Encode `(doc_id, text)` of all documents and write them in ascending order of `doc_id`, or of `order`."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    by = list(order) if order else [doc_id, F.xxhash64(text)]
    keys = [f"_by{k}" for k in range(len(by))]
    rows = docs.select(*[c.alias(k) for c, k in zip(by, keys)], doc_id.alias("doc_id"), text.alias("text"))
    placed = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys, "text").select("doc_id", "text")

    @returns_memory
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _frames(batches, tokenizer, TaskContext.get().partitionId(), end_id)

    # what a task holds is bounded by bytes, whatever the length of the texts
    with small_batches(spark, BATCH_ROWS):
        placed.mapInArrow(encode, _COLUMNS).write.mode("errorifexists").parquet(path)


def _placed_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames with the place of their first id among all ids."""
    frames = spark.read.schema(_COLUMNS).parquet(path)
    before, total = [], 0
    for r in sorted(frames.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["shard"]):
        before.append((r["shard"], total))
        total += r["n"]
    offsets = spark.createDataFrame(before or [(0, 0)], "shard long, _before long")
    placed = frames.join(F.broadcast(offsets), "shard")
    return placed.select((F.col("_before") + F.col("start")).alias("start"), "data")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Where each frame starts, and what is in it."""
    for b in batches:
        yield from zip(b.column(0).to_pylist(), unpack_many(data.as_py() for data in b.column(1)))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """`(doc_id, start, ids)`: every document with its ids, the end id included."""
    ship(spark)

    @returns_memory
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, (doc_ids, nulls, sizes, ids) in _decoded(batches):
            border = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=nulls.astype(bool)), pa.array(start + border[:-1]), lists], ["doc_id", "start", "ids"])

    return _placed_frames(spark, path).mapInArrow(read, "doc_id long, start long, ids array<int>")


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32)` from the files, without handing the ids to the JVM."""
    ship(spark)

    @returns_memory
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, (doc_ids, nulls, sizes, ids) in _decoded(batches):
            border = np.concatenate([[0], np.cumsum(sizes)])
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(border[:-1].tolist(), border[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64(), mask=nulls.astype(bool)), pa.array(start + border[:-1]), pa.array(sizes), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return _placed_frames(spark, path).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _through_files(spark: SparkSession, docs: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), order=order)
    return digest_token_files(spark, path)


def stored_order(docs: DataFrame) -> list[Column] | None:
    """Columns by which the rows of a table read from files stand as they were written, none for other tables.

    Spark numbers the files of a sorted table in the order of its partitions.
    """
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*place).schema
    except AnalysisException:
        return None
    return place


def op5_token_files(spark, folder: str) -> DataFrame:
    """All documents encoded, written, read back and digested."""
    return _through_files(spark, spark.read.parquet(f"{folder}/documents.parquet"))


def token_stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Last pipeline stage: the token files of what is left, in the order in which the stage before it has written its
    rows (the training order), read back and digested."""
    return _through_files(spark, docs, stored_order(docs))
