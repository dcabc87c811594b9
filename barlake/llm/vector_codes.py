"""Vector code compression: each vector becomes a few bytes, one for each of its parts, by codebooks learned from all vectors.

The nearest entry of a part is found exactly by slicing and intersecting bitmasks. For each dimension, the entries'
coordinates are sorted, and before each place stands the mask of all entries up to it. A radius selects a range of
coordinates around the part's own in every dimension; the masks at the range's ends differ in just the entries inside it,
and the AND over all dimensions leaves those in the box. The search starts with a small radius and doubles it where the
box is empty. The best entry of a box is at some distance, and the nearest of all lies in the box of that radius: one more
intersection holds all candidates, so the answer is exact.

Rounds over all vectors are jobs: tasks search and sum, the sums are aggregated by entry; what reaches the driver is the
codebooks, a bounded table of PARTS x ENTRIES entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

PARTS = 4
ENTRIES = 256
SCALE = 1024
ROUNDS = 4
#: Integers are held to this magnitude (components of 2^17), so that squared distances and sums stay in 64 bits.
LIMIT = 1 << 27
#: Rows searched together, and pairs of a row and a candidate measured together.
ROWS, PAIRS = 8192, 1 << 17
#: A label with this share of the rows is joined by broadcast; there can be as many of them as one over it.
HOT_SHARE = 0.001


class Slices:
    """Sorted coordinates and prefix masks of a codebook: entries is (entries, dimensions), of integers."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        m, w = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, 0).T)
        words = -(-m // 64)
        self.masks = np.zeros((w, m + 1, words), np.uint64)
        for j in range(w):
            bits = np.zeros((m, words), np.uint64)
            bits[np.arange(m), order[:, j] // 64] = np.uint64(1) << (order[:, j] % 64).astype(np.uint64)
            self.masks[j, 1:] = np.bitwise_or.accumulate(bits, axis=0)
        # a first radius: half the usual distance of an entry to its nearest other one, per dimension
        some = entries[: min(m, 64)]
        apart = np.abs(some[:, None, :] - entries[None, :, :]).max(axis=2)
        apart[np.arange(len(some)), np.arange(len(some))] = apart.max(initial=0)
        self.first = max(1, int(np.median(apart.min(axis=1))) // 2) if m > 1 else 1

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """One mask for each row of x: the entries that lie within its radius in every dimension."""
        found = np.full((len(x), self.masks.shape[2]), ~np.uint64(0))
        for j in range(x.shape[1]):
            low = np.searchsorted(self.sorted[j], x[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[j], x[:, j] + radius, "right")
            found &= self.masks[j, high] & ~self.masks[j, low]
        return found

    def _best(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared distance, entry) of the nearest candidate of each row, of equal ones the lower; -1 without any."""
        least, entry = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), -1)
        masks = self.candidates(x, radius)
        counts = np.bitwise_count(masks).sum(axis=1, dtype=np.int64)
        if not counts.any():
            return least, entry
        cuts = np.searchsorted(np.cumsum(counts), np.arange(PAIRS, counts.sum() + PAIRS, PAIRS), "left") + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            rows, bits = np.nonzero(np.unpackbits(masks[a:b].view(np.uint8), axis=1, bitorder="little"))
            if not len(rows):
                continue
            apart = x[a:b][rows] - self.entries[bits]
            square = np.einsum("ij,ij->i", apart, apart)
            heads = np.flatnonzero(np.diff(rows, prepend=-1))
            low = np.minimum.reduceat(square, heads)
            at = rows[heads] + a
            least[at] = low
            tie = np.where(square == np.repeat(low, np.diff(np.append(heads, len(rows)))), bits, np.iinfo(np.int64).max)
            entry[at] = np.minimum.reduceat(tie, heads)
        return least, entry

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(squared distance, entry) of the nearest entry of each row of x, of equal ones the lower."""
        least, entry = np.full(len(x), -1), np.full(len(x), -1)
        open_, radius = np.arange(len(x)), self.first
        while len(open_):
            low, got = self._best(x[open_], np.full(len(open_), radius))
            hit = got >= 0
            least[open_[hit]], entry[open_[hit]] = low[hit], got[hit]
            open_, radius = open_[~hit], radius * 2
        # the nearest of all is no farther than the best in the first box, so it is within that distance in each dimension
        bound = np.sqrt(least.astype(np.float64)).astype(np.int64) + 1
        return self._best(x, bound)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, n_parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ROWS rows with their vectors as (rows, parts, dimensions); zeros make up a length that parts do not divide."""
    per = -(-width // n_parts)
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            x = np.zeros((batch.num_rows, per * n_parts), np.int64)
            x[:, :width] = batch.column("ints").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield batch, x.reshape(-1, n_parts, per)


def _sums(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(part, entry, rows, sums): one row for each task and entry that it met."""
    n_parts, n_entries, per = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in sent.value]
        sums, rows = np.zeros((n_parts, n_entries, per), np.int64), np.zeros((n_parts, n_entries), np.int64)
        for _, x in _blocks(batches, width, n_parts):
            for p in range(n_parts):
                _, entry = slices[p].nearest(x[:, p])
                np.add.at(sums[p], entry, x[:, p])
                rows[p] += np.bincount(entry, minlength=n_entries)
        part, entry = np.nonzero(rows)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * per), pa.array(sums[part, entry].ravel()))
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(rows[part, entry]), flat], ["part", "entry", "rows", "sums"])

    return vectors.select("ints").mapInArrow(run, "part int, entry int, rows long, sums array<long>")


def kept_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, ints) of the vectors that are not null and hold neither null nor non-finite components."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ints = F.transform(x, lambda v: F.greatest(F.least(F.floor(v * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return vectors.where(whole).select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), ints.alias("ints"))


def learn(vectors: DataFrame, n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The vectors that codebooks can hold, and the codebooks: (parts, entries, dimensions) of integers.

    vectors: of kept_vectors. Codebooks start as the parts of the vectors with the smallest keys (null keys last, of
    equal keys the smaller vector); fewer vectors than entries make as many entries. Vectors of another length than the
    first one's have no code and are left out.
    """
    order = [F.col("key").asc_nulls_last(), "ints"]
    first = vectors.orderBy(*order).limit(1).collect()
    width = len(first[0]["ints"]) if first else 0
    if not width:
        return vectors.limit(0), np.zeros((n_parts, 0, 0), np.int64)
    vectors = vectors.where(F.size("ints") == width)
    starts = vectors.orderBy(*order).limit(n_entries).collect()
    per = -(-width // n_parts)
    whole = np.zeros((len(starts), per * n_parts), np.int64)
    whole[:, :width] = [r["ints"] for r in starts]
    books = np.ascontiguousarray(whole.reshape(-1, n_parts, per).transpose(1, 0, 2))
    for _ in range(rounds):
        summed = _sums(vectors, books, width).groupBy("part", "entry").agg(F.sum("rows").alias("rows"), *(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(per)))
        for r in summed.collect():  # a row for each entry in use
            books[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["rows"]
    return vectors, books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(key, label, code, error): the entries of the parts, two hex digits each, and the squared distance to them."""
    n_parts, n_entries, per = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    kind = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in sent.value]
        for batch in batches:
            for block, x in _blocks(iter([batch]), len(batch.column("ints")[0]) if batch.num_rows else 0, n_parts):
                error, codes = np.zeros(len(x), np.int64), np.zeros((len(x), n_parts), np.uint8)
                for p in range(n_parts):
                    least, entry = slices[p].nearest(x[:, p])
                    error += least
                    codes[:, p] = entry
                text = codes.tobytes().hex()
                shown = [text[i : i + 2 * n_parts] for i in range(0, len(text), 2 * n_parts)]
                yield pa.record_batch([block.column("key"), block.column("label"), pa.array(shown, pa.string()), pa.array(error)], ["key", "label", "code", "error"])

    return vectors.mapInArrow(run, f"key long, label {kind}, code string, error long")


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors of a label summed; labels of many rows are joined by broadcast, the others by shuffle."""
    total = coded.count()
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "label_errors")
    hot = sums.where(F.col("rows") >= total * HOT_SHARE).select(F.col("label").alias("_label"), "label_error")
    cold = sums.where(F.col("rows") < total * HOT_SHARE).select(F.col("label").alias("_label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_label"))
    many = coded.join(F.broadcast(hot), same).drop("_label")  # at most 1 / HOT_SHARE rows
    few = coded.join(F.broadcast(hot), same, "left_anti").join(cold, same).drop("_label")
    return many.union(few)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Codes of all vectors, with the errors of each label: vec_id, code, error, label_error, codebooks_sha256.

    Null vectors and vectors with null or non-finite components are dropped, as are those of another length than the
    vector of the smallest key (empty ones, if that is empty: all). A length that PARTS does not divide is made up with
    zeros; components beyond 2^17 count as 2^17. Null keys, repeated keys and repeated rows are rows like any other, and
    null labels are one label. An empty table gives an empty one.
    """
    kept, books = learn(materialize(kept_vectors(vectors, key, vector, label), "vectors"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = materialize(encode(kept, books), "coded")
    return _with_label_errors(coded).select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
