"""Document fingerprints: threshold-scaled sketches of character shingles.

A text's sketch holds every hash of its shingles (SHINGLE consecutive code points) that lies under a fixed fraction of the
hash space, so that sketches of a hundred and of a million characters keep the same hashes of what they share: containment
can be estimated between very unequal texts, and the sketch of a union is the union of the sketches. Texts with few such
hashes keep their LEAST smallest ones, which merges alike. Two sketches are compared below the bound up to which both are
complete.

Sketches are made row by row, without a shuffle. Where each document is compared with its neighbour in key order, texts
are sorted by range once; a task sees each text and the next one, and gets the first text of the task after it as a guest.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_parts
from .textops import mix64

SHINGLE = 12
#: One in so many hashes is kept, but at least LEAST of a text.
SCALE = 64
LEAST = 32
HASH_BITS = 48
LIMIT = (1 << HASH_BITS) // SCALE
#: Code points and texts hashed together; longer texts are hashed in overlapping runs. A text's number and a hash share 64 bits.
SLICE_CHARS = 1 << 15
SLICE_TEXTS = 1 << (64 - HASH_BITS)
#: Keys sampled for each bound of the range sort; they decide how even tasks are, not what is found.
SAMPLED = 128

_U = np.uint64
_STEPS = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)]
_PAD = "\U0010ffff"


def _fold_table() -> np.ndarray:
    """Code points as they are hashed: A-Z as a-z, white space of ASCII as a space."""
    table = np.arange(128, dtype=np.uint32)
    table[65:91] += 32
    table[9:14] = 32
    return table


_FOLD = _fold_table()


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A hash for each run of SHINGLE code points; runs of 2, 4 and 8 are hashed once for all that hold them."""
    low = codes < 128
    codes = np.where(low, _FOLD[np.where(low, codes, 0)], codes)
    run = codes.astype(np.uint64) * _STEPS[0]
    for k, step in zip((1, 2, 4), _STEPS[1:], strict=True):
        four, run = run, run[:-k] * step + run[k:]
    n = len(codes) - SHINGLE + 1
    found = run[:n] * _STEPS[0] + four[8 : 8 + n]
    return mix64(found) >> _U(64 - HASH_BITS)


def _least_of(owners: np.ndarray, found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, rank in the owner), sorted and without repeats."""
    both = np.sort((owners.astype(np.uint64) << _U(HASH_BITS)) | found)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    owners, found = (both >> _U(HASH_BITS)).astype(np.int64), both & _U((1 << HASH_BITS) - 1)
    return owners, found, np.arange(len(found)) - np.searchsorted(owners, np.arange(n))[owners]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of texts that are hashed together, as one array of hashes and its offsets."""
    texts = [t.ljust(SHINGLE, _PAD) if t else "" for t in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    found = _hashes(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    inside = np.ones(ends[-1], bool)
    inside[(ends[lengths > 0][:, None] - np.arange(1, SHINGLE)).ravel()] = False
    inside = inside[: len(found)]
    at = np.flatnonzero(inside & (found < _U(LIMIT)))
    n = len(texts)
    owners, kept, _ = _least_of(np.searchsorted(ends, at, "right"), found[at], n)
    few = np.bincount(owners, minlength=n) < LEAST
    if few.any():
        at = np.flatnonzero(inside & np.repeat(few, lengths)[: len(found)])
        more, small, rank = _least_of(np.searchsorted(ends, at, "right"), found[at], n)
        more, small = more[rank < LEAST], small[rank < LEAST]
        many = ~few[owners]
        owners, kept, _ = _least_of(np.concatenate([owners[many], more]), np.concatenate([kept[many], small]), n)
    return kept, np.append(np.searchsorted(owners, np.arange(n)), len(kept))


def _long(text: str) -> np.ndarray:
    """The sketch of a text of any length."""
    under, least = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for at in range(0, max(1, len(text) - SHINGLE + 1), SLICE_CHARS):
        run = text[at : at + SLICE_CHARS + SHINGLE - 1].ljust(SHINGLE, _PAD)
        found = _hashes(np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32))
        under = np.union1d(under, found[found < _U(LIMIT)])
        least = np.union1d(least, found)[:LEAST]
    return under if len(under) >= LEAST else least


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts that are hashed together; a long text is one of its own."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= SLICE_CHARS) and end - at < SLICE_TEXTS:
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sketches of texts, each ascending, one after the other. Empty texts have empty ones."""
    parts, sizes = [], [np.zeros(1, np.int64)]
    for at, end in _runs(texts):
        if len(texts[at]) > SLICE_CHARS:
            kept = _long(texts[at])
            offsets = np.array([0, len(kept)])
        else:
            kept, offsets = _joined(texts[at:end])
        parts.append(kept)
        sizes.append(np.diff(offsets))
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.cumsum(np.concatenate(sizes))


def written(hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Fingerprints as text: eight base64 letters for each hash, in ascending order of hashes."""
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets * 8), pa.py_buffer(base64.b64encode(raw))).cast(pa.string())


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(np.uint64)


def _complete_to(sketch: np.ndarray) -> int:
    """The bound below which a sketch has all hashes of its text."""
    if len(sketch) < LEAST:
        return 1 << HASH_BITS
    return max(LIMIT, int(sketch[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Estimates of the share of a that is in b, of b that is in a, and of their Jaccard similarity.

    Equal sketches, two empty ones too, have 1. Where a sketch has nothing below the bound up to which both are complete
    (an empty text, or a few words against a long text), nothing is known and the estimates are 0.
    """
    if np.array_equal(a, b):
        return 1.0, 1.0, 1.0
    bound = _U(min(_complete_to(a), _complete_to(b)))
    a, b = a[: np.searchsorted(a, bound)], b[: np.searchsorted(b, bound)]
    if not len(a) or not len(b):
        return 0.0, 0.0, 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / len(a), both / len(b), both / (len(a) + len(b) - both)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts taken together, as a set of shingles."""
    bound = min(_complete_to(a), _complete_to(b))
    both = np.union1d(a, b)
    both = both[both < _U(bound)]
    under = both[both < _U(LIMIT)]
    return under if len(under) >= LEAST else both[:LEAST]


def fingerprint_documents(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint of the whole text in a column of the given name, row by row; null texts are empty ones."""
    out = [*docs.columns, name]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = written(*sketches(batch.column(text).fill_null("").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], out)

    return docs.mapInArrow(run, kinds)


def contained(a: str, b: str) -> Column:
    """Columns of two fingerprints: struct of a_in_b, b_in_a and jaccard; null fingerprints are empty ones."""

    @F.pandas_udf("a_in_b double, b_in_a double, jaccard double")
    def run(x, y):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([containment(read(p or ""), read(q or "")) for p, q in zip(x, y, strict=True)], columns=["a_in_b", "b_in_a", "jaccard"])

    return run(F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit("")))


def _key_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in the order that neighbours have: descending key (null last), then by the text's hash.

    The last part tells equal rows apart, of which any order gives the same result, so that many of them can be split.
    """
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(key).isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit(0)).cast("long").alias("down"),
        F.xxhash64(own).alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("row"), F.col(key).cast("long").alias("key"), own.alias("text"),
    )


ORDER = ["none", "down", "hash", "row"]


def _bounds(keyed: DataFrame, parts: int) -> list[tuple]:
    """Keys at which parts begin, the first of all rows among them; parts of about equal bytes, by a sample of the keys."""
    total = keyed.count()
    if not total:
        return []
    keys = keyed.select(*ORDER, (F.octet_length("text") + 64).alias("weight"))
    first = tuple(keys.select(*ORDER).orderBy(*ORDER).limit(1).collect()[0])
    step = max(1, total // (SAMPLED * parts))
    sample = sorted(map(tuple, keys.where(F.pmod(F.xxhash64(*ORDER), F.lit(step)) == 0).collect()))
    bounds, share, done = [first], sum(x[4] for x in sample) / parts, 0
    for *at, weight in sample:
        if done >= share * len(bounds) and tuple(at) > bounds[-1]:
            bounds.append(tuple(at))
        done += weight
    return bounds


def _part(bounds: list[tuple]) -> Column:
    """The part of a row: how many bounds lie at or below its key, less one."""
    sides = [np.array([b[k] for b in bounds], np.int64) for k in range(4)]

    @F.pandas_udf("int")
    def run(none, down, hash_, row):  # noqa: ANN001, ANN202
        import pandas as pd

        keys = [np.concatenate([s, c.to_numpy(np.int64)]) for s, c in zip(sides, (none, down, hash_, row), strict=True)]
        order = np.lexsort(keys[::-1])  # stable: a bound comes before the row that it is
        below = np.empty(len(order), np.int32)
        below[order] = np.cumsum(order < len(bounds)) - 1
        return pd.Series(below[len(bounds) :])

    return run(*ORDER)


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of an edited form of it, and how like they are.

    The next document is the one of the next lower key, after the last the first; keys may be repeated (the text's hash
    decides) or null (after all others). The edited text has its last third (rounded down) of code points replaced by as
    many of the next text's first ones, or all. near_edited and near_next are the greater of the two containments
    between the text's fingerprint and the edited one or the next document's; jaccard_edited and jaccard_next estimate
    the similarity of the same pairs. Null texts are empty ones, empty texts have the empty fingerprint, which is like
    itself only (1) and nothing else (0). A single document is its own next one. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    keyed = _key_of(docs, key, text)
    parts = shuffle_parts(spark)
    bounds = _bounds(keyed, parts)
    out = f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"
    if not bounds:
        return spark.createDataFrame([], out)
    # each part's first text visits the part before it; as many rows as parts
    heads = spark.createDataFrame([(*b[:3], (i - 1) % len(bounds)) for i, b in enumerate(bounds)], "none int, down long, hash long, part int")
    visited = keyed.where(F.col("down").isin([b[1] for b in bounds])).join(F.broadcast(heads.drop("part").distinct()), ORDER[:3], "left_semi")
    guests = heads.join(visited.groupBy(*ORDER[:3]).agg(F.first("text").alias("text")), ORDER[:3])
    shape = ["guest", *ORDER, "key", "text", "part"]
    own = keyed.withColumn("part", _part(bounds)).withColumn("guest", F.lit(0)).select(*shape)
    rows = own.union(guests.withColumns({"guest": F.lit(1), "row": F.lit(0).cast("long"), "key": F.lit(None).cast("long")}).select(*shape))
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("guest", *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str, np.ndarray] | None = None
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            for at, end in _runs(texts):
                found, offsets = sketches(texts[at:end])
                nows = [(k, t, found[a:b]) for k, t, a, b in zip(keys[at:end], texts[at:end], offsets[:-1], offsets[1:], strict=True)]
                befores = ([held] if held else []) + nows[:-1]
                if befores:
                    yield _compared(befores, nows[-len(befores) :], key)
                held = nows[-1]

    return dealt.select("key", "text").mapInArrow(run, out)


def _compared(rows: list[tuple], nexts: list[tuple], key: str) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for (_, t, _), (_, n, _) in zip(rows, nexts, strict=True)]
    hashes, offsets = sketches(edited)
    near = []
    for (_, _, own), (_, _, other), a, b in zip(rows, nexts, offsets[:-1], offsets[1:], strict=True):
        near.append([(max(x, y), z) for x, y, z in (containment(own, hashes[a:b]), containment(own, other))])
    sizes = np.cumsum([0, *(len(r[2]) for r in rows)])
    columns = [
        pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]), written(np.concatenate([r[2] for r in rows]), sizes), written(hashes, offsets),
        *(pa.array([n[i][j] for n in near], pa.float64()) for j in (0, 1) for i in (0, 1)),
    ]
    return pa.RecordBatch.from_arrays(columns, [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "jaccard_edited", "jaccard_next"])
