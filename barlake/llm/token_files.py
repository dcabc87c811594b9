"""Token files: ids in patched frame-of-reference blocks.

A file is rows of segments, written and committed by Spark, so it lives wherever Spark writes and a lost task leaves
nothing behind. A segment holds the ids of consecutive documents:

    header   4 uint32: magic, documents, ids (low and high half)
    blocks   for each BLOCK ids: minimum uint32, width uint8, exceptions uint8, packed differences of `width` bits,
             then the exceptions' places (uint8 each) and differences (uint32 each)
    index    a uint64 start for each block, so any document's ids can be read alone

The width of a block is that of its difference at PERCENTILE; greater differences are exceptions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shuffle_parts
from .tokens import default_tokenizer, encoder

BLOCK = 128
PERCENTILE = 90
SEGMENT_IDS = 1 << 20
END_ID = 2
MAGIC = 0x31524650
_HEAD = 6


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """values (blocks, BLOCK), each below 2^width, as (blocks, BLOCK * width / 8) bytes."""
    columns = np.ascontiguousarray(values.T.astype(np.uint64))
    out = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).view(np.uint8).reshape(len(values), BLOCK * width // 8)


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(data).view("<u8").reshape(len(data), -1).T) if width else None
    out = np.zeros((BLOCK, len(data)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        word, shift = divmod(j * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[word + 1] << np.uint64(64 - shift))
        out[j] = x & mask
    return out.T


def encode_ids(ids: np.ndarray, documents: int = 0) -> bytes:
    """A segment of uint32 ids. The last block is filled up with its first value."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    head = np.array([MAGIC, documents, n & 0xFFFFFFFF, n >> 32], "<u4").tobytes()
    if not n:
        return head
    full = np.full(blocks * BLOCK, ids[(blocks - 1) * BLOCK], np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    apart = full - low[:, None]
    place = min(BLOCK - 1, -(-BLOCK * PERCENTILE // 100) - 1)
    chosen = np.partition(apart, place, axis=1)[:, place]
    width = np.where(chosen > 0, np.floor(np.log2(np.maximum(chosen, 1).astype(np.float64))).astype(np.int64) + 1, 0)
    over = (apart.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    extra = over.sum(axis=1)
    size = _HEAD + BLOCK * width // 8 + 5 * extra
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(starts[-1], np.uint8)
    out[starts[:-1, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts[:-1] + 4], out[starts[:-1] + 5] = width, extra
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            out[starts[rows, None] + _HEAD + np.arange(BLOCK * w // 8)] = _pack(np.where(over[rows], 0, apart[rows]), int(w))
    b, j = np.nonzero(over)
    if len(b):
        nth = np.arange(len(b)) - np.repeat(np.concatenate([[0], np.cumsum(extra)[:-1]]), extra)
        at = starts[b] + _HEAD + BLOCK * width[b] // 8
        out[at + nth] = j
        out[(at + extra[b] + 4 * nth)[:, None] + np.arange(4)] = apart[b, j].astype("<u4").view(np.uint8).reshape(-1, 4)
    return head + out.tobytes() + (starts[:-1] + len(head)).astype("<u8").tobytes()


def decode_ids(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first .. last - 1 of a segment; only the blocks that hold them are read."""
    head = np.frombuffer(data, "<u4", 4)
    if head[0] != MAGIC:
        raise ValueError("not a token segment")
    n = int(head[2]) | int(head[3]) << 32
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    from_, to = first // BLOCK, -(-last // BLOCK)
    raw = np.frombuffer(data, np.uint8)
    starts = np.frombuffer(data, "<u8", blocks, len(data) - 8 * blocks)[from_:to].astype(np.int64)
    low = raw[starts[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, extra = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    apart = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            apart[rows] = _unpack(raw[starts[rows, None] + _HEAD + np.arange(BLOCK * w // 8)], int(w))
    if extra.any():
        b = np.repeat(np.arange(len(starts)), extra)
        nth = np.arange(len(b)) - np.repeat(np.concatenate([[0], np.cumsum(extra)[:-1]]), extra)
        at = starts[b] + _HEAD + BLOCK * width[b] // 8
        apart[b, raw[at + nth]] = raw[(at + extra[b] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    return (apart + low[:, None]).ravel()[first - from_ * BLOCK : last - from_ * BLOCK]


SEGMENTS = "part int, segment int, before long, n_ids long, doc_ids array<long>, sizes array<long>, data binary"


def write_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write every row's ids and end_id to `path`, rows in ascending key order (null keys first, equal keys by text).

    A null or empty text is end_id alone. Rows are range-partitioned, so no task holds more than its range; a segment
    ends after SEGMENT_IDS ids, a row is never split over segments.
    """
    file = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(file).encode, TaskContext.get().partitionId()
        segment = before = held = 0
        docs_, sizes, parts = [], [], []

        def row() -> pa.RecordBatch:
            data = encode_ids(np.frombuffer(b"".join(parts), "<u4"), len(docs_))
            values = [part, segment, before, held, docs_, sizes, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["part", "segment", "before", "n_ids", "doc_ids", "sizes", "data"])

        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(x.as_py() or "") + end
                docs_.append(doc)
                sizes.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
                if held >= SEGMENT_IDS:
                    yield row()
                    segment, before, held = segment + 1, before + held, 0
                    docs_, sizes, parts = [], [], []
        if docs_:
            yield row()

    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = base.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    ranged.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a token file.

    Null keys are documents without a name and come first, repeated keys give a row each; a file of no documents gives
    no rows.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # bounded: one row for each range of keys
    totals = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    ahead, at = {}, 0
    for part in sorted(totals):
        ahead[part], at = at, at + totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, before, doc_ids, sizes, data = (batch.column(c)[k].as_py() for c in range(5))
                ends = np.cumsum([0, *sizes])
                ids = decode_ids(data).astype("<u4")
                if len(ids) != ends[-1]:
                    raise ValueError("a segment's ids and its documents' sizes differ")
                raw = ids.tobytes()
                out = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(ends[:-1] + before + ahead[part], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4"), pa.int32())))
                    names.append("ids")
                yield pa.record_batch(out, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return segments.select("part", "before", "doc_ids", "sizes", "data").mapInArrow(run, schema)
