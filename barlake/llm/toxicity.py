"""Toxicity by weak supervision.

1. Voters. Words, word beginnings, spellings (small letters, figures read as letters, stretched letters once) and four
   patterns (stretched letters, letters mixed with figures, repeated words, capitals) that go with toxic or with clean
   labels in the training rows, once or twice and more, become voters: all of them whose damped odds ratio is
   clear of a ratio. A voter speaks for its side or is silent.
2. Label model. All documents vote; a document's votes are a sparse list. Rounds of expectation maximisation in Spark
   sum for each voter how often it is right when it speaks, and for each pair of one side how far it agrees beyond that
   (its correlation); the sums grow with the voters, not with the documents. Correlated voters share their weight. A
   document for which no voter speaks is at a level of its own: the one with which the posteriors of all documents have the
   share of toxic rows on average.
3. Classifier. A linear model over hashed words, beginnings, spellings and patterns is fitted to the posteriors of
   bounded samples of labelled rows, in which a row's own label votes too, and of unlabelled ones, and scores every text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .linear import BITS, _sized_tokens
from .quality_model import SAMPLE_ROWS, bounded_sample, fit, held_out, scorer, within_bytes
from .shared import materialize, unused
from .textops import _BYTE_VALUE, _IS_SPACE, _LOWER, _powers, buffers, let_go, mix64

#: What was chosen on splits inside the training rows. ratio: a voter's odds ratio, less one standard deviation, is this
#: at least, for one side or the other; unlabelled: rows without a label for each labelled row the classifier learns from.
SETTINGS = {"ratio": 10, "l1": 0.1, "passes": 5, "alpha": 0.5, "raised_in": 3, "unlabelled": 1.0}
#: Rounds of expectation maximisation over all documents at most, and the weight of the labelled rows in them.
ROUNDS, DAMP = 8, 20
#: Share of labels that are right.
LABEL = 0.999
#: Bytes of texts whose terms are made together: a byte takes 55 to 100 bytes of arrays. Longer texts are cut at white space.
SLICE_BYTES = 1 << 18
#: Pairs of votes taken together, or all of one vote: a pair takes some 90 bytes of arrays.
PAIRS = 1 << 18
#: Lengths in bytes of the word beginnings looked at; only words that go on count.
BEGINNINGS = (4, 5, 6, 7)
_U = np.uint64
_TWICE = _U(0x5BD1E995C0B3A7F1)
_SALT = mix64(np.arange(1, 9, dtype=np.uint64))
_SPELLING = _U(0x94D049BB133111EB)
_STRETCHED, _MIXED, _AGAIN, _CAPITALS = mix64(np.arange(101, 105, dtype=np.uint64))
#: The letter that a byte is read as, 0 for marks.
_READ = _LOWER.copy()
_READ[:48] = _READ[58:65] = _READ[91:97] = _READ[123:128] = 0
_READ[list(b"013457@$")] = list(b"oieastas")
_FIGURE = np.isin(np.arange(256), list(b"0123456789@$"))


def _terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, row after the last, row of each term, its 64-bit code): words and beginnings."""
    let_go()
    data, offsets = buffers(texts)
    n, row = len(offsets) - 1, 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        owners, codes, before = [], [], None
        for part, firsts in linear.row_parts(data, offsets, row, last, 4 * SLICE_BYTES):
            hashes, starts, size, values = _sized_tokens(part, firsts[:-1])
            owner = _rows_of(starts, firsts)
            owners.append(owner)
            codes.append(hashes)
            spelled, before = _spellings(part, firsts, before)
            for places, found in spelled:
                owners.append(_rows_of(places, firsts))
                codes.append(found)
            upto = np.append(_U(0), np.cumsum(values))
            for k in BEGINNINGS:  # each among the words that went on before
                more = size > k
                owner, starts, size = owner[more], starts[more], size[more]
                codes.append(mix64((upto[starts + k] - upto[starts]) ^ _SALT[k - 1]))
                owners.append(owner)
        yield row, last, np.concatenate(owners), np.concatenate(codes)
        row = last


def _spellings(data: np.ndarray, firsts: np.ndarray, before: np.uint64 | None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.uint64 | None]:
    """(places, codes) of each word's spelling and of the patterns that words show, and the last spelling.

    before: the last spelling of the part before, if the text goes on from there.
    """
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = firsts[firsts < len(data)]
    begins[heads] = inside[heads]
    at = np.flatnonzero(inside & (_READ[data] > 0))
    if not len(at):
        return [], before
    word, read = np.cumsum(begins)[at], _READ[data[at]]
    more = np.zeros(len(at), bool)
    more[1:] = (word[1:] == word[:-1]) & (read[1:] == read[:-1])
    long = at[np.flatnonzero(more[1:] & more[:-1] & (data[at[1:]] >= 65)) + 1]
    raw = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    size = np.diff(np.append(raw, len(at)))
    figures = np.add.reduceat(_FIGURE[data[at]].astype(np.int64), raw)
    capitals = np.add.reduceat(((data[at] >= 65) & (data[at] <= 90)).astype(np.int64), raw)
    mixed, loud = at[raw[(figures > 0) & (figures < size)]], at[raw[(capitals == size) & (size > 3)]]
    at, word, read = at[~more], word[~more], read[~more]
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    span = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, span)
    codes = mix64(np.add.reduceat(_BYTE_VALUE[read] * _powers(int(span.max()))[place], starts) ^ _SPELLING)
    firsts_of = at[starts]
    row = np.searchsorted(firsts, firsts_of, "right")
    same = np.append(codes[:1] == before if before is not None else False, (codes[1:] == codes[:-1]) & (row[1:] == row[:-1]))
    patterns = ((long, _STRETCHED), (mixed, _MIXED), (firsts_of[same], _AGAIN), (loud, _CAPITALS))
    return [(firsts_of, codes), *((places, np.full(len(places), code)) for places, code in patterns)], codes[-1]


def _rows_of(places: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The row of each place; places ascend."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(np.searchsorted(places, firsts)))


def term_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for first, last, owner, index, value in _hashed(texts):
        ends = np.searchsorted(owner, np.arange(last - first + 1))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield index[a:b].astype(np.int32), value[a:b].astype(np.float32)


def _hashed(texts: pa.Array, useful: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """useful: which indices of terms said once or more are looked at; all without it."""
    for first, last, owner, code in _terms(texts):
        if useful is not None:
            some = np.flatnonzero(useful[code >> _U(64 - BITS)])
            owner, code = owner[some], code[some]
        once, count = np.unique((owner.astype(_U) << _U(BITS)) | (code >> _U(64 - BITS)), return_counts=True)
        twice = once[count > 1]
        twice = np.sort(twice ^ (_TWICE & _U((1 << BITS) - 1)))
        flat = np.concatenate([once, twice])
        owner = (flat >> _U(BITS)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        yield first, last, owner[order], (flat[order] & _U((1 << BITS) - 1)).astype(np.int64), np.ones(len(flat))


def term_score(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    # a term without a weight, said once or twice, adds nothing
    useful = weights[1:] != 0
    useful = useful | useful[np.arange(1 << BITS) ^ int(_TWICE & _U((1 << BITS) - 1))]
    out = [np.bincount(o, weights[i + 1] * v, last - first) + weights[0] for first, last, o, i, v in _hashed(texts, useful)]
    return 1 / (1 + np.exp(-np.clip(np.concatenate(out) if out else np.zeros(0), -35, 35)))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = np.asarray(batch.column(2)) > 0.5
        for first, last, owner, code in _terms(batch.column(1)):
            order = np.lexsort((owner, code))
            owner, code = owner[order], code[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            often = np.diff(np.append(at, len(code))) > 1
            toxic = y[first:last][owner[at]]
            term, place = np.unique(code[at], return_inverse=True)
            counts = [np.bincount(place, w, len(term)).astype(np.int64) for w in (toxic, ~toxic, toxic & often, ~toxic & often)]
            yield pa.record_batch([pa.array(term.view(np.int64)), *map(pa.array, counts)], ["term", "t1", "c1", "t2", "c2"])


def lexicon(sample: DataFrame, ratio: float = SETTINGS["ratio"]) -> tuple[list[tuple[int, int, float]], float]:
    """((term code, times, damped share of toxic rows where it is said) of all voters, share of toxic rows).

    A voter's log odds ratio of being said in toxic and in clean rows, damped by half a row in each cell and
    less its standard deviation, is ln(ratio) away from 0 at least. Terms are those of a bounded sample, and so are the voters.
    """
    counts = sample.select("_id", "text", "y").mapInArrow(_term_counts, "term long, t1 long, c1 long, t2 long, c2 long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("t1", "c1", "t2", "c2")])
    size = sample.groupBy().agg(F.sum(F.expr("cast(y > 0.5 as long)")).alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = size["t"] or 0, (size["n"] or 0) - (size["t"] or 0)
    if not toxic or not clean:
        return [], 0.0
    prior = toxic / (toxic + clean)
    both = counts.select("term", F.explode(F.array(*[F.struct(F.lit(k).alias("times"), F.col(f"t{k}").alias("t"), F.col(f"c{k}").alias("c")) for k in (1, 2)])).alias("x")).select("term", "x.*").where("t + c > 0")
    odds = F.expr(f"ln((t + 0.5) / ({toxic} - t + 0.5)) - ln((c + 0.5) / ({clean} - c + 0.5))")
    spread = F.expr(f"sqrt(1 / (t + 0.5) + 1 / ({toxic} - t + 0.5) + 1 / (c + 0.5) + 1 / ({clean} - c + 0.5))")
    found = both.where(F.abs(odds) > spread + math.log(ratio)).select("term", "times", F.expr(f"(t + 2 * {prior}D) / (t + c + 2)").alias("share")).orderBy("term", "times")
    return [(r["term"], r["times"], r["share"]) for r in found.collect()], prior


def _votes(texts: pa.Array, voters: list[tuple[int, int, float]]) -> pa.Array:
    """For each row the list of voters that speak."""
    terms, times = np.array([v[0] for v in voters], np.int64).view(np.uint64), np.array([v[1] for v in voters])
    known, place = np.unique(terms, return_inverse=True)
    of = np.full((3, len(known)), -1)
    of[times, place] = np.arange(len(voters))
    sizes, spoken = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
    may = np.zeros(1 << BITS, bool)
    may[known >> _U(64 - BITS)] = True
    for first, last, owner, code in _terms(texts):
        some = np.flatnonzero(may[code >> _U(64 - BITS)])  # few of the others
        owner, code = owner[some], code[some]
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = np.flatnonzero(known[at] == code)
        said, count = np.unique(owner[hit] * len(known) + at[hit], return_counts=True)
        row, term = said // len(known), said % len(known)
        both = np.concatenate([of[1][term], np.where(count > 1, of[2][term], -1)])
        row, both = np.tile(row, 2)[both >= 0], both[both >= 0]
        spoken.append(both[np.lexsort((both, row))])
        sizes.append(np.bincount(row, minlength=last - first))
    ends = np.cumsum(np.concatenate(sizes))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(spoken), pa.int32()))


class LabelModel:
    """Posterior of the toxic class from sparse votes: (voters that speak, row after row; where each row ends).

    A silent voter says nothing; rows without votes are at the prior, moved so that all rows have it on average where
    `calibrated`. shares: first estimates of the share of toxic rows where a voter speaks, refined here
    for the side it is on. Voters of one side that speak together more than their shares in its class explain are
    correlated, and where they do speak together they divide the weight by that.
    """

    def __init__(self, shares: list[float], prior: float, calibrated: bool = True):
        self.first, self.prior = np.clip(np.array(shares, float), 1e-3, 0.999), float(np.clip(prior, 1e-4, 0.5))
        self.share, self.toxic = self.first, self.first >= self.prior
        self.calibrated, self.shift = calibrated, 0.0
        self.pairs, self.correlation = np.zeros(0, np.int64), np.zeros(0)

    def posterior(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        base = np.log(self.prior / (1 - self.prior))
        weight = (np.log(self.share / (1 - self.share)) - base)[at]
        shared = np.ones(len(at))
        if len(self.pairs):
            for first, last, a, b in _together(ends):
                i, j = np.minimum(at[a], at[b]), np.maximum(at[a], at[b])
                key = i * len(self.share) + j
                k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                shared[first:last] += np.bincount(a - first, np.where(self.pairs[k] == key, self.correlation[k], 0.0), last - first)
        sizes = np.diff(ends)
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weight / shared, len(sizes))
        return 1 / (1 + np.exp(-np.clip(base + self.shift + total, -35, 35)))

    def sums(self, at: np.ndarray, ends: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each voter spoke and that in toxic rows, with all rows at the end; pairs (i * voters + j, i < j) of one side and their weight in its class."""
        w, v = n * self.posterior(at, ends), len(self.share)
        row = np.repeat(np.arange(len(n)), np.diff(ends))
        each = np.array([np.append(np.bincount(at, x[row], v), x.sum()) for x in (n, w)])
        keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
        waiting = 0
        for _, _, a, b in _together(ends):
            own = (at[a] < at[b]) & (self.toxic[at[a]] == self.toxic[at[b]])
            a, b = a[own], b[own]
            key, place = np.unique(at[a] * v + at[b], return_inverse=True)
            keys.append(key)
            weights.append(np.bincount(place, np.where(self.toxic[at[a]], w[row[a]], (n - w)[row[a]]), len(key)))
            waiting += len(key)
            if waiting > max(PAIRS, len(keys[0])):
                keys, weights, waiting = *([x] for x in _added(keys, weights)), 0
        return each, *_added(keys, weights)

    def update(self, each: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> float:
        """The greatest change of a share or of the shift, from the sums of all rows."""
        pairs, place = np.unique(keys, return_inverse=True)
        weights = np.bincount(place, weights, len(pairs))
        before, (seen, right) = self.share, each
        share = (right[:-1] + DAMP * self.first) / (seen[:-1] + DAMP)
        self.share = np.where(self.toxic, np.clip(share, self.prior, 0.999), np.clip(share, 1e-3, self.prior))
        total = np.maximum(np.where(self.toxic, right[-1], seen[-1] - right[-1]), 1e-9)
        rate = np.where(self.toxic, right[:-1], seen[:-1] - right[:-1]) / total
        sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
        i, j = pairs // len(rate), pairs % len(rate)
        found = np.clip((weights / total[i] - rate[i] * rate[j]) / (sd[i] * sd[j]), 0, 1)
        self.pairs, self.correlation = pairs[found > 0], found[found > 0]
        shift = self.shift
        if self.calibrated:
            mean = float(np.clip(right[-1] / max(seen[-1], 1.0), 1e-6, 1 - 1e-6))
            self.shift += math.log(self.prior / (1 - self.prior)) - math.log(mean / (1 - mean))
        return max(float(np.abs(self.share - before).max()), abs(self.shift - shift))


def _added(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, and the sum of its weights."""
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, np.concatenate(weights), len(key))


def _together(ends: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of votes with about `most` pairs (PAIRS): (first vote, vote after the last, a, b): all pairs of one of
    them, a, with another vote of its row. A row with many votes is in several runs."""
    sizes, most = np.diff(ends), most or PAIRS
    others = np.repeat(sizes - 1, sizes)  # of each vote
    start = np.repeat(ends[:-1], sizes)
    done = np.append(0, np.cumsum(others))
    vote = 0
    while vote < len(others):
        last = max(vote + 1, int(np.searchsorted(done, done[vote] + most, "right")) - 1)
        count = others[vote:last]
        a = np.repeat(np.arange(vote, last), count)
        b = np.repeat(start[vote:last] - (done[vote:last] - done[vote]), count) + np.arange(len(a))
        b += b >= a  # past the vote itself
        yield vote, last, a, b
        vote = last


def _flat(votes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = votes.value_lengths().to_numpy(zero_copy_only=False)
    return votes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(sizes)).astype(np.int64)


def label_model(patterns: dict[int, int], accuracy: list[float], rounds: int = 50, prior: float | None = None) -> dict[int, float]:
    """Posterior of the toxic class for each vote pattern (bit j: voter j speaks) of a small table of counts.

    Without a prior it is the share of rows that the voters, as right as they are said to be, speak for.
    """
    keys = sorted(patterns)
    bits = np.array([[k >> j & 1 for j in range(len(accuracy))] for k in keys], bool).reshape(len(keys), len(accuracy))
    n = np.array([patterns[k] for k in keys], float)
    if not keys or not bits.any():
        return dict.fromkeys(keys, prior or 0.0)
    at, ends = np.nonzero(bits)[1], np.append(0, np.cumsum(bits.sum(axis=1)))
    model = LabelModel(accuracy, prior if prior is not None else n[bits.any(axis=1)].sum() / n.sum() * float(np.mean(accuracy)), prior is not None)
    for _ in range(rounds):
        if model.update(*model.sums(at, ends, n)) < 1e-6:
            break
    return dict(zip(keys, model.posterior(at, ends).tolist(), strict=True))


def fit_voters(docs: DataFrame, voters: list[tuple[int, int, float]], prior: float, text: str) -> LabelModel:
    """The label model of all documents. Each round is one job over their vote lists; equal lists are counted together."""
    model = LabelModel([v[2] for v in voters], prior)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    @F.arrow_udf("array<int>")
    def vote(texts: pa.Array) -> pa.Array:
        return _votes(texts, shared.value)

    lists = docs.select(vote(F.col(text).cast("string")).alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    lists = materialize(lists, "votes")
    for _ in range(ROUNDS):
        now = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            m = now.value
            k = np.arange(len(m.share) + 1)
            each, keys, weights = np.zeros((2, len(k))), np.zeros(0, np.int64), np.zeros(0)
            for batch in batches:
                more, *pairs = m.sums(*_flat(batch.column(0)), batch.column(1).to_numpy().astype(float))
                each, (keys, weights) = each + more, _added([keys, pairs[0]], [weights, pairs[1]])
            kind, at = np.repeat([0, 1, 2], [len(k), len(k), len(keys)]), np.concatenate([k, k, keys])
            yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(at), pa.array(np.concatenate([*each, weights]))], ["kind", "at", "x"])

        # bounded by voters and pairs of voters
        found = lists.mapInArrow(run, "kind int, at long, x double").groupBy("kind", "at").agg(F.sum("x").alias("x")).where("x <> 0").toArrow()
        kind, at, x = (found.column(c).to_numpy() for c in ("kind", "at", "x"))
        each = np.zeros((2, len(voters) + 1))
        for row in (0, 1):
            each[row, at[kind == row]] = x[kind == row]
        if model.update(each, at[kind == 2], x[kind == 2]) < 1e-3:
            break
    return model


def unlabelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, key: str, text: str, rows: int) -> DataFrame:
    """(_id, text, y null) of at most `rows` rows without a label: those with the least hash of their id."""
    own = docs.where(usable & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"))
    known = labels.where("toxic is not null").select(F.col(key).cast("long").alias("_id"))
    chosen = own.join(known, "_id", "left_anti").distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return within_bytes(texts.join(F.broadcast(chosen), "_id").withColumn("y", F.lit(None).cast("double")))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS, usable: Column | None = None, settings: dict | None = None) -> np.ndarray:
    """Weights of the classifier. Labels are read only of rows whose crc32(id) mod 3 is not 1, or of those `usable`.

    The classifier learns the posteriors of at most `rows` labelled rows, in which a row's own label votes too, and of
    as many rows without a label.
    """
    settings = SETTINGS | (settings or {})
    usable = ~held_out(F.col(key), 3, 1) if usable is None else usable
    sample = materialize(bounded_sample(docs, labels, "toxic", usable, key, text, rows), "labelled")
    voters, prior = lexicon(sample, settings["ratio"])
    if not voters:
        return fit(sample.select("_id", "text", F.lit(prior).alias("y")), term_features, l1=settings["l1"], passes=settings["passes"], alpha=settings["alpha"], raised_in=settings["raised_in"])
    model = fit_voters(docs, voters, prior, text)
    known = docs.sparkSession.sparkContext.broadcast((voters, model))

    @F.arrow_udf("double")
    def soft(texts: pa.Array, labels: pa.Array) -> pa.Array:
        voters, model = known.value
        y = labels.to_numpy(zero_copy_only=False)
        # the row's own label is one more voter, for either side; without one there is none
        own = np.where(np.isnan(y), model.prior, np.where(y > 0.5, LABEL, 1 - LABEL))
        p = np.clip(model.posterior(*_flat(_votes(texts, voters))), 1e-12, 1 - 1e-12)
        return pa.array(1 / (1 + np.exp(-(np.log(p / (1 - p)) + np.log(own / (1 - own)) - math.log(model.prior / (1 - model.prior))))))

    more = unlabelled_sample(docs, labels, usable, key, text, int(rows * settings["unlabelled"]))
    judged = sample.select("_id", "text", "y").union(more).select("_id", "text", soft(F.col("text"), F.col("y")).alias("y"))
    # written first, so that no task needs two Python workers at once
    return fit(materialize(judged, "judged"), term_features, l1=settings["l1"], passes=settings["passes"], alpha=settings["alpha"], raised_in=settings["raised_in"])


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.7, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; score is the probability that a text is toxic.

    A null or empty text is scored by the bias alone. Without usable labels there are no voters and nothing is toxic.
    An empty table gives no rows. Repeated rows each give their row, equal texts have equal scores, a score at the
    threshold is toxic; other columns are not read. Conflicting labels of one id count as 1.
    """
    score = scorer(docs, train(docs, labels, text, key, rows), text, term_score)
    out = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key).cast("long"), 3, 1).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.7, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rows that score at least the threshold, all columns kept.

    Null and empty texts are scored by the bias alone, and without usable labels nothing goes. Rows of equal text go or
    stay together, whatever their keys, null keys included.
    """
    weights, name = train(docs, labels, text, key, rows), unused(docs, "_score")
    return docs.withColumn(name, scorer(docs, weights, text, term_score)).where(F.col(name) < threshold).drop(name)
