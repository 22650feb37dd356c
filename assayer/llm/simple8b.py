"""Token ids on disk: Simple-8b words in blocks of 128 ids, blocks in segments, segments in shards.

A 64-bit word has a selector in its upper four bits and 60 bits of payload: so many values of
so many bits each (``PACKINGS``). Selector 0 is the escape: the next word is one raw value. A
block starts on a word of its own and its offset is stored, so all blocks of a segment are
packed and unpacked side by side.

The file format is a Parquet folder with one row per segment: ``shard``, ``segment``, ``first``
(ids of the shard before it), ``doc_ids``, ``lengths``, ``blocks`` (word offsets, 32 bit) and
``words`` (64 bit), little-endian. Shards, segments and documents ascend by document id.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assayer.llm import words
from assayer.llm.batches import pieces, texts
from assayer.session import checkpoint_dir

BLOCK = 128
# Selector to (values in a word, bits of each); fixed values of the published code. Selector 0 is the escape.
PACKINGS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
_MANY = np.ones(16, np.int64)
for _selector, (_n, _) in PACKINGS.items():
    _MANY[_selector] = _n
_LIMITS = np.array([1 << b for b in range(64)], np.uint64)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and the word offset of each block of 128 ``values`` (unsigned 64-bit)."""
    values = np.asarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    wide = BLOCK + 60
    rows = np.zeros((blocks, wide), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:len(values)] = values
    rows[:, :BLOCK] = full.reshape(blocks, BLOCK)
    bits = np.searchsorted(_LIMITS, rows, "right").astype(np.uint8)
    selector = np.where(bits > 60, 0, 14).astype(np.uint8)
    most, reach = bits, 1   # most[i]: widest of the values i .. i + reach - 1
    for s in range(13, 0, -1):
        n, b = PACKINGS[s]
        while reach < n:
            step = min(reach, n - reach)
            shifted = np.zeros_like(most)
            shifted[:, :wide - step] = most[:, step:]
            most, reach = np.maximum(most, shifted), reach + step
        selector[most <= b] = s
    counts = np.full(blocks, BLOCK)
    counts[-1] = len(values) - BLOCK * (blocks - 1)

    at, used, steps = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64), []
    active = np.arange(blocks)
    while len(active):
        chosen = selector[active, at[active]]
        steps.append((active, at[active].copy(), used[active].copy(), chosen))
        at[active] += _MANY[chosen]
        used[active] += 1 + (chosen == 0)
        active = active[at[active] < counts[active]]
    offsets = np.append(0, np.cumsum(used))
    out = np.zeros(offsets[-1], np.uint64)
    row, begin, place, chosen = (np.concatenate(x) for x in zip(*steps))
    place = place + offsets[row]
    flat, begin = rows.ravel(), row * wide + begin
    for s, (n, b) in PACKINGS.items():
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            word = np.full(len(mine), s << 60, np.uint64)
            for j in range(n):
                word |= flat[begin[mine] + j] << np.uint64(j * b)
            out[place[mine]] = word
    raw = np.flatnonzero(chosen == 0)
    out[place[raw] + 1] = flat[begin[raw]]
    return out, offsets[:-1].astype(np.uint32)


def unpack(packed: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` values of ``pack``, all blocks at once."""
    blocks = len(offsets)
    out = np.zeros(blocks * BLOCK + 60, np.uint64)
    if not blocks:
        return out[:0]
    counts = np.full(blocks, BLOCK)
    counts[-1] = count - BLOCK * (blocks - 1)
    selectors = (packed >> np.uint64(60)).astype(np.int64)
    word, done, steps = offsets.astype(np.int64), np.zeros(blocks, np.int64), []
    active = np.arange(blocks)
    while len(active):
        chosen = selectors[word[active]]
        steps.append((active * BLOCK + done[active], word[active].copy(), chosen, counts[active] - done[active]))
        done[active] += _MANY[chosen]
        word[active] += 1 + (chosen == 0)
        active = active[done[active] < counts[active]]
    place, at, chosen, left = (np.concatenate(x) for x in zip(*steps))
    for s, (n, b) in PACKINGS.items():
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            payload, mask = packed[at[mine]], np.uint64((1 << b) - 1)
            for j in range(n):
                fits = left[mine] > j
                out[place[mine][fits] + j] = (payload[fits] >> np.uint64(j * b)) & mask
    raw = np.flatnonzero(chosen == 0)
    out[place[raw]] = packed[at[raw] + 1]
    return out[:count]


def _segments(tokenizer: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = words.load(tokenizer)
        known = words.met(tokenizer, words.library_encoder(library)) if words.is_byte_level(library) else None
        shard, first, segment = TaskContext.get().partitionId(), 0, 0
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            column = batch.column("text")
            if known:
                ids, offsets = words.encode(column, library, known)
            else:
                rows = [e.ids for e in library.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
                ids, offsets = np.array([x for r in rows for x in r], np.int64), np.append(0, np.cumsum([len(r) for r in rows]))
            lengths = np.diff(offsets)
            if end is not None:
                ids = np.insert(ids, offsets[1:], end)
                lengths = lengths + 1
            packed, blocks = pack(ids)
            yield pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
                pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64())),
                pa.array([blocks.astype("<u4").tobytes()], pa.binary()), pa.array([packed.astype("<u8").tobytes()], pa.binary()),
            ], names=["shard", "segment", "first", "n_ids", "doc_ids", "lengths", "blocks", "words"])
            first, segment = first + int(lengths.sum()), segment + 1
    return run


SEGMENTS = "shard int, segment int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, blocks binary, words binary"


def write(docs: DataFrame, tokenizer: str, path: str, end: int | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write the ids in ascending order of ``key`` to the new folder ``path``.

    ``end`` is appended to every document. A null or empty text has no other id. Null ids come
    first; rows with equal ids follow each other as they were read, so that one id need not fit
    a task. Other columns are not read. An empty table gives a folder without segments.
    """
    source = texts(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    read = source.withColumn("read", F.monotonically_increasing_id())
    ordered = read.repartitionByRange("doc_id", "read").sortWithinPartitions("doc_id", "read").drop("read")
    ordered.mapInArrow(_segments(tokenizer, end), SEGMENTS).write.option("compression", "none").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a folder, each with ``start``: ids of all documents before it."""
    stored = spark.read.schema(SEGMENTS).parquet(path)
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("total"))   # one row per file
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    return stored.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("first"))


def _documents(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("start", "doc_ids", "lengths", "blocks", "words")}
                lengths = row["lengths"].values.to_numpy().astype(np.int64)
                ids = unpack(np.frombuffer(row["words"].as_buffer(), "<u8"), np.frombuffer(row["blocks"].as_buffer(), "<u4"), int(lengths.sum()))
                ends = np.cumsum(lengths)
                columns = [row["doc_ids"].values, pa.array(row["start"].as_py() + ends - lengths), pa.array(lengths)]
                if digest:
                    flat = memoryview(ids.astype("<u4").tobytes())
                    columns.append(pa.array([zlib.crc32(flat[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.int64()))
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of a folder."""
    return segments(spark, path).mapInArrow(_documents(False), "doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>")


def audit(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of a folder: the unsigned crc32 over each document's ids as 32-bit words."""
    return segments(spark, path).mapInArrow(_documents(True), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own where all executors can write."""
    return f"{checkpoint_dir(spark)}/assayer/ids-{uuid.uuid4().hex}"
