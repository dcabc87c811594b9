"""Benchmark decontamination by one Aho-Corasick automaton over the words of normalised test items."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, unused
from .textops import buffers, let_go, new_store

WINDOW = 10
#: Bytes of normalised items in one automaton, which takes about 100 times that. A benchmark is one automaton; one of more
#: bytes is dealt to several, and the documents are read once for each of them.
AUTOMATON_BYTES = 4 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: ASCII bytes other than 0-9, A-Z and a-z end a word; bytes of other characters belong to words.
_NORMAL = bytes(x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in _LOWER)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Automaton:
    """The windows of some items over an alphabet of words: a symbol for each word of the items, one for all others.

    A window is n consecutive words of an item, or all its words if they are fewer. What is found is counted in words,
    so a place in the scanned symbols is the number of the word in the text.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.symbols: dict[bytes, str] = {}
        self.machine = ahocorasick.Automaton()
        held: dict[str, set[str]] = {}
        for item, text in items:
            words = text.split()
            line = "".join([self.symbols.setdefault(w, chr(1 + len(self.symbols) + (0x800 if len(self.symbols) >= 0xD7FF else 0))) for w in words])
            for i in range(max(1, len(line) - n + 1)):
                names = held.setdefault(line[i : i + n], set())
                if item is not None:
                    names.add(item)
        for window, names in held.items():
            self.machine.add_word(window, (len(window), tuple(names)))
        if held:
            self.machine.make_automaton()
        self.empty = not held

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, words, items) of each occurrence."""
        if not self.empty:
            for end, (size, names) in self.machine.iter("".join(map(self.symbols.get, words, repeat("\0")))):
                yield end + 1 - size, size, names


    def hits(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Of a normalised text the number of words, the stretches of words that are hit, in order, and the items found."""
        words = text.split()
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for first, size, names in sorted(self.scan(words), key=lambda x: x[0]):
            if found and first <= found[-1][1]:
                found[-1] = (found[-1][0], max(found[-1][1], first + size))
            else:
                found.append((first, first + size))
            items.update(names)
        return len(words), found, items


def pieces_of(normal: bytes, n: int) -> Iterator[bytes]:
    """A normalised item, a long one in pieces that share n - 1 words, so that they have all its windows and no others."""
    most = AUTOMATON_BYTES // 16
    if len(normal) <= most:
        yield normal
        return
    words = normal.split()
    ends = np.cumsum([len(w) + 1 for w in words])
    at = 0
    while True:
        end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + n)
        yield b" ".join(words[at:end])
        if end >= len(words):
            return
        at = end - (n - 1)


def build(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> list[DataFrame]:
    """(item, piece) of the items with words, normalised, as a table for each automaton; no items make one empty table.

    Equal rows count once. Items of null id are kept without a name. Pieces are dealt by hash, so that a part has half of
    AUTOMATON_BYTES on average.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            normal = [b" ".join(words_of(t.encode())) for t in batch.column(1).to_pylist()]
            made = [(i, p) for i, t in zip(batch.column(0).to_pylist(), normal, strict=True) if t for p in pieces_of(t, n)]
            yield pa.record_batch([pa.array([i for i, _ in made], pa.string()), pa.array([p for _, p in made], pa.binary())], ["item", "piece"])

    pieces = materialize(rows.mapInArrow(run, "item string, piece binary"), "benchmark")
    total = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    parts = 1 if total <= AUTOMATON_BYTES else -(-2 * total // AUTOMATON_BYTES)
    number = F.pmod(F.xxhash64("piece"), F.lit(parts))
    return [pieces.where(number == k) for k in range(parts)]


_kept: dict[str, Automaton] = new_store()


def _automaton(name: str, items: list[tuple[str | None, bytes]], n: int) -> Automaton:
    """The automaton of a part, made once in a worker and kept for its next batches and tasks; one at a time."""
    let_go(but=_kept)
    if name not in _kept:
        _kept.clear()
        _kept[name] = Automaton(items, n)
    return _kept[name]


def _sent(part: DataFrame) -> tuple[str, Broadcast]:
    return uuid.uuid4().hex, part.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["piece"])) for r in part.collect()])


def _offsets(normal: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of words as byte offsets of the original text: normalising keeps one byte for one byte."""
    if not found:
        return []
    inside = ~np.isin(np.frombuffer(normal, np.uint8), [9, 10, 11, 12, 13, 32])
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    return [(int(starts[a]), int(ends[b - 1])) for a, b in found]


def _normal(texts: pa.Array) -> list[bytes]:
    data, offsets = buffers(texts)
    raw = data.tobytes().translate(_NORMAL)
    return [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def scan_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", n: int = WINDOW) -> DataFrame:
    """Per row of docs: (doc_id, n_words, n_hit, items array<string>, spans array<struct<start, end>>).

    A document word is hit when it lies inside an occurrence of a window of any item; spans are the maximal stretches
    of hit words as byte offsets of the UTF-8 text. Null and empty texts have no words. Items whose text is null or has
    no words have no windows; an item of null id has windows but no name, so it hits words and is not among the items;
    items with equal windows are all named. With no items nothing is hit. Repeated rows each give their row, other
    columns are not read, and memory follows the longest batch of texts. With several automata, docs are read once for
    each, as any table that is read again they must give the same rows in the same order, and what is found in a row is
    put together by the row's number.
    """
    parts = build(benchmark, n=n)
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = _found(base, parts[0], n, True)
    for part in parts[1:]:
        found = found.union(_found(base, part, n, False))
    if len(parts) > 1:
        flat = lambda c: F.flatten(F.collect_list(c))
        found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(flat("hits")).alias("hits"), F.array_sort(F.array_distinct(flat("items"))).alias("items"))
        found = found.withColumn("hits", F.aggregate("hits", F.slice("hits", 1, 1), _joined))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["last"] - h["first"])
    spans = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", spans.alias("spans"))


def _joined(done: Column, hit: Column) -> Column:
    """Stretches in order, with one more that may go on from the last of them."""
    old = F.element_at(done, -1)
    later = F.greatest(old["last"], hit["last"])
    more = F.struct(old["first"].alias("first"), later.alias("last"), old["start"].alias("start"), F.greatest(old["end"], hit["end"]).alias("end"))
    return F.when(hit["first"] <= old["last"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(more))).otherwise(F.concat(done, F.array(hit)))


_HIT = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))


def _found(base: DataFrame, part: DataFrame, n: int, all_rows: bool) -> DataFrame:
    """(row, doc_id, n_words, hits, items) of what one automaton finds; rows without a hit only where all are asked for."""
    name, shared = _sent(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(name, shared.value, n)
        for batch in batches:
            normal = _normal(batch.column(2))
            rows = [machine.hits(x) for x in normal]
            hits = [[dict(zip(("first", "last", "start", "end"), (a, b, c, d), strict=True)) for (a, b), (c, d) in zip(r[1], _offsets(x, r[1]), strict=True)] for x, r in zip(normal, rows, strict=True)]
            out = pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array(hits, _HIT), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))],
                ["row", "doc_id", "n_words", "hits", "items"],
            )
            yield out if all_rows else out.filter(pa.array([bool(h) for h in hits], pa.bool_()))

    return base.mapInArrow(run, "row long, doc_id long, n_words long, hits array<struct<first: long, last: long, start: long, end: long>>, items array<string>")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of a scan."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", n: int = WINDOW) -> DataFrame:
    """docs without the rows whose own text holds a window of the benchmark; all columns kept, in one pass.

    The verdict is made row by row beside the row itself, so null and repeated keys are no matter. A row without words
    stays; with no items all rows stay. With several automata, docs are read once for each, and the numbers of the rows
    that go are joined to the rows.
    """
    parts = build(benchmark, n=n)
    if len(parts) > 1:
        row = unused(docs, "_row")
        numbered = docs.withColumn(row, F.monotonically_increasing_id())
        base = numbered.select(F.col(row).alias("row"), F.lit(0).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        gone = _found(base, parts[0], n, False).select("row")
        for part in parts[1:]:
            gone = gone.union(_found(base, part, n, False).select("row"))
        return numbered.join(gone.distinct().withColumnRenamed("row", row), row, "left_anti").select(*docs.columns)
    at = docs.columns.index(text)
    name, shared = _sent(parts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(name, shared.value, n)
        for batch in batches:
            clean = [next(machine.scan(x.split()), None) is None for x in _normal(batch.column(at))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
