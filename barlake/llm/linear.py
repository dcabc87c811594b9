"""Hashed word n-grams, logistic regression by follow-the-regularised-leader, and scores as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textops import _BYTE_VALUE, _LOWER, SLICE_BYTES, _pieces, _powers, buffers, let_go, mix64

#: Size of the hashed feature space.
BITS = 20
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_REPEAT = _U(0x6A09E667F3BCC908)

#: 0 white space, 1 letters and digits (all of those beyond ASCII), 2 marks
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def _tokens(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each maximal run of one kind (words, marks), A-Z lower-cased."""
    return _sized_tokens(data, firsts)[:2]


def _sized_tokens(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and bytes of each maximal run of one kind, and the value of each byte at its place in its run."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind = _KIND[data]
    begins = np.empty(len(data), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[firsts[firsts < len(data)]] = True
    starts = np.flatnonzero(begins)
    span = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, span)
    values = _BYTE_VALUE[_LOWER[data]] * _powers(int(span.max()))[place]
    hashes = mix64(np.add.reduceat(values, starts))
    real = kind[starts] > 0
    return hashes[real], starts[real], span[real], values


def row_parts(data: np.ndarray, offsets: np.ndarray, row: int, last: int, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, where each row begins and the end): a run of rows, or the parts of a single long one, of some `size` bytes."""
    part, size = data[offsets[row] : offsets[last]], size or 4 * SLICE_BYTES
    if last == row + 1 and len(part) > size:
        for piece in _pieces(part, size):
            yield piece, np.array([0, len(piece)])
    else:
        yield part, offsets[row : last + 1] - offsets[row]


def features(texts: pa.Array, max_n: int = 2) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, row after the last, row of each feature, its index, its value).

    Features are the distinct hashed n-grams (1 to max_n) of a text's tokens with value 1 + ln(count), and one that
    counts words equal to the word before. A long text is taken in parts that end at white space; their counts are
    added, and the last tokens of a part go before the next one's, so that the parts cannot be told from the whole.
    """
    let_go()
    data, offsets = buffers(texts)
    n, row = len(offsets) - 1, 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        keys, counts, carried = [], [], np.zeros(0, np.uint64)
        for part, firsts in row_parts(data, offsets, row, last):
            hashes, starts = _tokens(part, np.unique(firsts[:-1]))
            owner = np.searchsorted(firsts, starts, "right") - 1
            old = len(carried)
            hashes, owner = np.concatenate([carried, hashes]), np.concatenate([np.zeros(old, np.int64), owner])
            carried = hashes[len(hashes) - min(len(hashes), max_n - 1) :]
            same = np.zeros(len(hashes), bool)
            same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
            plain = np.where(same, _REPEAT, hashes)
            grams, owners = [plain[old:]], [owner[old:]]
            run = hashes
            for k in range(1, max_n):
                run = run[:-1] * _STEP + plain[k:]
                inside = owner[k:] == owner[: len(owner) - k]
                inside[: max(old - k, 0)] = False  # what ends in a part before is counted there
                grams.append(mix64(run)[inside])
                owners.append(owner[k:][inside])
            flat = (np.concatenate(owners).astype(_U) << _U(BITS)) | (np.concatenate(grams) >> _U(64 - BITS))
            found, c = np.unique(flat, return_counts=True)
            keys.append(found)
            counts.append(c)
        if len(keys) > 1:
            flat, place = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(place, np.concatenate(counts), len(flat))
        else:
            flat, count = keys[0], counts[0]
        yield row, last, (flat >> _U(BITS)).astype(np.int64), (flat & _U((1 << BITS) - 1)).astype(np.int64), 1 + np.log(count)
        row = last


def feature_rows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for first, last, owner, index, value in features(texts):
        ends = np.searchsorted(owner, np.arange(last - first + 1))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield index[a:b].astype(np.int32), value[a:b].astype(np.float32)


class Ftrl:
    """Weights (a bias first) of a logistic regression, by follow-the-regularised-leader updates, one row at a time."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.arange(len(self.z))[at] == 0, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], passes: int = 4) -> Ftrl:
        """rows: (indices, values, label from 0 to 1). The order of a pass is fixed by its number."""
        for k in range(passes):
            for r in np.random.default_rng(k).permutation(len(rows)):
                index, value, label = rows[r]
                at, x = np.concatenate([[0], index.astype(np.int64) + 1]), np.concatenate([[1.0], value])
                w = self.weights(at)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
                sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
                self.z[at] += g - sigma * w
                self.n[at] += g * g
        return self


def score(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = []
    for first, last, owner, index, value in features(texts):
        out.append(np.bincount(owner, weights[index + 1] * value, last - first) + weights[0])
    return 1 / (1 + np.exp(-np.clip(np.concatenate(out) if out else np.zeros(0), -35, 35)))
