"""Best-fit packing of documents into sequences, in bulk-synchronous rounds over run-length tables.

Lengths lie between 1 and the capacity, so range-sorting documents and gaps puts them into at most `capacity` runs of
equal size, whatever the number of documents: a document is its length and its rank within that length, a gap its size
and a run of sequence numbers. Every run is dealt in PARTS equal stripes, and tasks place their stripes side by side. A
round of a task sweeps its sorted documents and gaps from small to large: a document's successor is the least gap that holds
it, documents that meet at one gap take it by rank, longest first, and what is left over goes on to the next gap; then
all gaps taken shrink together, and rounds repeat, long documents before short ones. What no gap of its task holds and
does not fill a new sequence is united in a last step, in which the rest of all stripes meets the gaps of all stripes. The documents
themselves are counted, ranked and placed by distributed jobs and never gathered.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize
from .tokens import default_tokenizer, encoder

CAPACITY = 2048
SEPARATOR = 0
#: Stripes that are packed side by side.
PARTS = 8


def cut(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) per piece of each row: its token ids and the separator.

    A row of at most `capacity` ids is one piece. Longer ones are cut from the end into whole pieces, so that only the
    first may be shorter. A null or empty text is the separator alone. Ids are encoded in tasks, a text at a time.
    """
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            out: list[tuple] = []
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(x.as_py() or "") + end
                n, at = len(ids) // 4, 0
                size = n % capacity or capacity
                piece = 0
                while at < n:
                    part = ids[4 * at : 4 * (at + size)]
                    out.append((doc, piece, at, size, zlib.crc32(part), *([np.frombuffer(part, "<i4")] * keep_ids)))
                    at, size, piece = at + size, capacity, piece + 1
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], schema=pa.schema(list(zip(("doc_id", "piece", "start", "length", "ids_crc32", "ids"), kinds, strict=True))[: len(columns)]))

    return docs.select(F.col(key).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))).mapInArrow(run, schema)


Runs = dict[int, list[tuple[int, int]]]


def sweep(docs: Runs, gaps: Runs, capacity: int, stride: int) -> tuple[list[tuple[int, int, int, int, int]], Runs]:
    """One round. docs: runs (first rank, documents) by length, from which the placed ones are taken; gaps: runs (first
    sequence, sequences) by size, sequences being `stride` apart. Rows (length, first rank, documents, first sequence,
    offset) of what was placed, and the gaps after it.

    A gap takes one document, or as many of one length as it holds if more of them wait than there are gaps.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    after: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
    waiting: list[int] = []
    for size in sorted(docs.keys() | gaps.keys()):
        if size in docs:
            waiting.append(size)
        runs = list(gaps.get(size, ()))
        free = sum(n for _, n in runs)
        while runs and waiting:
            length = waiting[-1]
            own = docs[length]
            (first, n), (sequence, g) = own[-1], runs[-1]
            copies = min(size // length, max(1, -(-sum(m for _, m in own) // free)))
            taken = min(g, n // copies)
            if not taken:
                copies, taken = n, 1
            placed += [(length, first + j * taken, taken, sequence, capacity - size + j * length) for j in range(copies)]
            if size > copies * length:
                after[size - copies * length].append((sequence, taken))
            own[-1:] = [(first + copies * taken, n - copies * taken)] if n > copies * taken else []
            runs[-1:] = [(sequence + taken * stride, g - taken)] if g > taken else []
            free -= taken
            if not own:
                del docs[length]
                waiting.pop()
        if runs:
            after[size] += runs
    return placed, dict(after)


def settle(docs: Runs, gaps: Runs, capacity: int, start: int, stride: int, last: bool) -> tuple[list[tuple[int, int, int, int, int]], Runs, Runs]:
    """Rounds until nothing more is placed: rows of `sweep`, documents left over, gaps left over.

    Documents of half the capacity and more come first, then of a third, a quarter, an eighth, and the rest. What no gap
    holds opens as many new sequences as it fills, numbered from `start`, and in the last step one more.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    left: Runs = {}
    for share in (2, 3, 4, 8, capacity + 1):
        now = {n: runs for n, runs in docs.items() if n * share >= capacity}
        docs = {n: runs for n, runs in docs.items() if n * share < capacity}
        while now:
            rows, gaps = sweep(now, gaps, capacity, stride)
            placed += rows
            if now and not rows:
                total = sum(length * n for length, runs in now.items() for _, n in runs)
                opened = -(-total // capacity) if last else total // capacity
                if not opened:
                    break
                gaps.setdefault(capacity, []).append((start, opened))
                start += opened * stride
        left |= now
    return placed, left, gaps


_STATE = "kind int, size int, first long, n long, sequence long, offset int"
_DOC, _GAP, _PLACED = 0, 1, 2


def _step(runs: DataFrame, parts: int, number: int, stride: int, capacity: int, last: bool) -> DataFrame:
    """Runs of documents and gaps dealt to `parts` tasks and settled there; placed ones pass through."""
    deal = runs.where(F.col("kind") != _PLACED).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    low, high = F.expr(f"n * part div {parts}"), F.expr(f"n * (part + 1) div {parts}")
    deal = deal.select("part", "kind", "size", (F.col("first") + low * F.when(F.col("kind") == _GAP, stride).otherwise(1)).alias("first"), (high - low).alias("n")).where("n > 0")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        docs, gaps = defaultdict(list), defaultdict(list)
        for r in sorted(table.to_pylist(), key=lambda r: (r["kind"], r["size"], r["first"])):
            (docs if r["kind"] == _DOC else gaps)[r["size"]].append((r["first"], r["n"]))
        placed, left, free = settle(dict(docs), dict(gaps), capacity, number + key[0].as_py(), stride, last)
        rows = [(_PLACED, *r) for r in placed] + [(k, size, first, n, None, None) for k, runs in ((_DOC, left), (_GAP, free)) for size, own in runs.items() for first, n in own]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        columns = zip(*rows, strict=True) if rows else [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "size", "first", "n", "sequence", "offset"])

    return runs.where(F.col("kind") == _PLACED).unionByName(deal.groupBy("part").applyInArrow(run, _STATE))


def plan(counts: DataFrame, capacity: int = CAPACITY, parts: int = PARTS) -> DataFrame:
    """counts: (length, n), documents by length. Rows (length, first, n, sequence, offset) that place them all.

    Documents first .. first + n - 1 of that length go to sequences `sequence`, `sequence` + parts + 1 and so on, all at
    one offset. Rows grow with the capacity and the parts, not with the documents.
    """
    null = lambda t: F.lit(None).cast(t)
    runs = counts.select(F.lit(_DOC).alias("kind"), F.col("length").cast("int").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), null("long").alias("sequence"), null("int").alias("offset"))
    striped = materialize(_step(runs, parts, 0, parts + 1, capacity, False), "stripes")
    whole = materialize(_step(striped, 1, parts, parts + 1, capacity, True), "plan")
    return whole.where(F.col("kind") == _PLACED).select(F.col("size").alias("length"), "first", "n", "sequence", "offset")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; every sequence is gapless from 0 and holds at most `capacity`.

    pieces needs `length` (1 to capacity) and may have any other columns. Equal rows are placed one by one. Ranks
    within a length are made in two steps, within a task and over the tasks' counts, so a length that a third of all
    rows have is split like any other. An empty table gives an empty one.
    """
    own = pieces.withColumn("_part", F.spark_partition_id())
    own = materialize(own, "pieces")  # partition numbers must not change between the two passes
    sizes = own.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n"))
    # bounded by the capacity and PARTS; rows of 40 bytes
    placed = plan(sizes.groupBy("length").agg(F.sum("_n").alias("n")), capacity).toArrow()
    by_length: dict[int, np.ndarray] = {}
    table = np.stack([placed.column(c).to_numpy().astype(np.int64) for c in ("length", "first", "sequence", "offset")], axis=1)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    for rows in np.split(table, np.flatnonzero(np.diff(table[:, 0])) + 1):
        if len(rows):
            by_length[int(rows[0, 0])] = rows[:, 1:]
    shared = pieces.sparkSession.sparkContext.broadcast(by_length)
    local = F.row_number().over(Window.partitionBy("length", "_part").orderBy(F.lit(0))) - 1
    ranked = own.withColumn("_local", local).join(before.drop("_n"), ["length", "_part"]).withColumn("_rank", F.col("_local") + F.col("_before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        out = np.empty((len(length), 2), np.int64)
        length, rank = length.to_numpy(), rank.to_numpy()
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            own = shared.value[int(n)]
            found = own[np.searchsorted(own[:, 0], rank[at], "right") - 1]
            out[at, 0], out[at, 1] = found[:, 1] + (rank[at] - found[:, 0]) * (PARTS + 1), found[:, 2]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("_at", place("length", "_rank")).select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of each piece of each row of docs.

    A null or empty text is the separator alone. Repeated rows are packed one by one, null keys stay null, equal lengths
    are told apart by rank. An empty table gives no rows; other columns are not read.
    """
    return pack(cut(docs, text, key, tokenizer, capacity, keep_ids=keep_ids), capacity)
