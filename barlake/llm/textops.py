"""Vectorised word hashing over Arrow string columns.

A column of texts is one byte buffer with offsets. Words are found and hashed for a whole slice of that buffer
at once, so the cost per word is a few array operations and no Python object is made for it.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed together; longer texts are cut at white space, so memory stays bounded for texts of any length.
SLICE_BYTES = 1 << 20

#: Stores of what a Python worker makes once and keeps for its next tasks, one for each module that has such things.
_stores: list[dict] = []

_U = np.uint64
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_STEP = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def new_store() -> dict:
    """An empty store that `let_go` knows."""
    _stores.append({})
    return _stores[-1]


def let_go(but: dict | None = None) -> None:
    """Empty all stores but one. Spark's workers outlive a stage: what they keep for it stays in memory during all later
    stages, unless the tasks of those let go of it."""
    full = [s for s in _stores if s and s is not but]
    for s in full:
        s.clear()
    if full:
        gc.collect()
        pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix64((np.arange(256, dtype=np.uint64) + _U(1)) * _STEP)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True


def _powers(n: int, _kept: list = [np.ones(1, np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(_kept[0]) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _kept[0] = np.cumprod(steps, dtype=np.uint64)
    return _kept[0]


def hash_words_of(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data: bytes of some texts, firsts: where each begins. Returns a hash per word and its first byte's place."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = firsts[firsts < len(data)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    span = np.diff(np.append(starts, len(data)))
    tail = data[starts[0] :]
    place = np.arange(len(tail), dtype=np.int64) - np.repeat(starts - starts[0], span)
    value = _BYTE_VALUE[_LOWER[tail]] * _powers(int(span.max()))[place]
    value *= inside[starts[0] :]
    return mix64(np.add.reduceat(value, starts - starts[0])), starts


def _pieces(text: np.ndarray, size: int | None = None) -> Iterator[np.ndarray]:
    """A long text in parts that end where a word ends."""
    at, size = 0, size or SLICE_BYTES
    while len(text) - at > size:
        cut = at + size
        gaps = np.flatnonzero(_IS_SPACE[text[cut:]]) if not _IS_SPACE[text[cut]] else np.zeros(1, np.int64)
        cut = cut + int(gaps[0]) if len(gaps) else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, row after the last, word hashes, offsets of the rows in them).

    Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased.
    """
    let_go()
    data, offsets = buffers(texts)
    n, row = len(offsets) - 1, 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        part = data[offsets[row] : offsets[last]]
        if last == row + 1 and len(part) > SLICE_BYTES:
            found = np.concatenate([hash_words_of(x, np.zeros(1, np.int64))[0] for x in _pieces(part)])
            yield row, last, found, np.array([0, len(found)])
        else:
            firsts = offsets[row : last + 1] - offsets[row]
            found, starts = hash_words_of(part, firsts[:-1])
            yield row, last, found, np.searchsorted(starts, firsts)
        row = last


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n consecutive words; order within the run counts."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * _STEP + words[k : len(words) - n + 1 + k]
    return mix64(out)
