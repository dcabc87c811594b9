"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import linear
from .shared import materialize, unused

#: Labelled rows that a classifier is fitted on, at most: those with the least hash of their id, as far as their texts
#: have so many bytes together.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 128 << 20
L1, PASSES = 2.0, 3


def held_out(key: Column, mod: int, rest: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % mod == rest


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, key: str, text: str, rows: int) -> DataFrame:
    """(text, y) of at most `rows` labelled rows and SAMPLE_BYTES; the sample of ids is small enough to be sent to every task.

    Of repeated ids the text of the least hash counts, and label 1 before label 0.
    """
    ids = labels.where(usable & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id")).agg(F.max(F.col(label).cast("double")).alias("y"))
    chosen = ids.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    own = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return within_bytes(own.join(F.broadcast(chosen), "_id"))


def within_bytes(rows: DataFrame) -> DataFrame:
    """(_id, text, y), one row an id, as far as the texts have SAMPLE_BYTES together in the order of the ids' hashes.

    rows: a bounded sample (_id, text, y), of which only keys and sizes are put in order.
    """
    one = rows.groupBy("_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").alias("y"))
    order = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = one.select("_id", F.sum(F.octet_length("text")).over(order).alias("_sum")).where(F.col("_sum") <= SAMPLE_BYTES).select("_id")
    return one.join(F.broadcast(sizes), "_id").select("_id", "text", "y")


def fit(sample: DataFrame, featurise=linear.feature_rows, l1: float = L1, passes: int = PASSES, alpha: float = 0.1, raised_in: int = 0) -> np.ndarray:
    """Weights, the bias first, from a bounded sample (text, y). Tasks make the features, only those reach the driver.

    With raised_in, only features of that many rows of label 1 count that are twice as usual there as elsewhere; tasks
    count them and leave the others out, so that few reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(featurise(batch.column(1)))
            yield pa.record_batch(
                [batch.column(0), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([v.astype(np.float16).tobytes() for _, v in rows], pa.binary()), batch.column(2)],
                ["id", "i", "v", "y"],
            )

    made = sample.select("_id", "text", "y").mapInArrow(run, "id long, i binary, v binary, y double")
    if raised_in:
        made = _raised(materialize(made, "features"), raised_in)
    rows = [(r["id"], np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float16), r["y"]) for r in made.toLocalIterator()]
    rows.sort(key=lambda r: r[0])
    return linear.Ftrl(l1=l1, alpha=alpha).fit([r[1:] for r in rows], passes).weights().astype(np.float32)


def _raised(made: DataFrame, raised_in: int) -> DataFrame:
    """made (id, i, v, y) with only the features of `fit`'s raised_in; their table is no larger than the feature space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << linear.BITS), np.int64)
        for batch in batches:
            for i, y in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                seen[int(y > 0.5), np.frombuffer(i, np.int32)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(seen[1, at]), pa.array(seen[0, at])], ["at", "high", "low"])

    highs, rows = made.agg(F.count_if(F.col("y") > 0.5), F.count(F.lit(1))).first()
    sums = made.mapInArrow(count, "at int, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    some = sums.where((F.col("high") >= raised_in) & (F.col("high") / max(highs, 1) > 2 * F.col("low") / max(rows - highs, 1)))
    keep = np.zeros(1 << linear.BITS, bool)
    keep[some.select("at").toArrow().column("at").to_numpy()] = True
    shared = made.sparkSession.sparkContext.broadcast(keep)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
            v = [np.frombuffer(x, np.float16) for x in batch.column(2).to_pylist()]
            kept = [shared.value[x] for x in i]
            columns = [batch.column(0), pa.array([x[k].tobytes() for x, k in zip(i, kept, strict=True)], pa.binary()), pa.array([x[k].tobytes() for x, k in zip(v, kept, strict=True)], pa.binary()), batch.column(3)]
            yield pa.record_batch(columns, ["id", "i", "v", "y"])

    return made.mapInArrow(thin, made.schema)


def scorer(docs: DataFrame, weights: np.ndarray, text: str, score=linear.score):
    """A vectorised function of the text; the weights (fixed size, 4 MB) are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(score(texts, shared.value), pa.float64())

    return run(F.col(text).cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; score is the probability of label 1.

    Fitted on labels of rows whose crc32(id) mod 5 is not 0; only texts are inputs. A null or empty text is scored by
    the bias alone. Without usable labels every score is 0.5. Repeated rows each give their row; other columns are not
    read. Conflicting labels of one id count as 1.
    """
    train = bounded_sample(docs, labels, "quality", ~held_out(F.col(key), 5, 0), key, text, rows)
    score = scorer(docs, fit(train), text)
    out = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key).cast("long"), 5, 0).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, fit_on: DataFrame | None = None, text: str = "text", key: str = "doc_id", threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without rows scored below the threshold, all columns kept; fitted on labelled rows of fit_on or docs.

    Null and empty texts are scored by the bias alone, and without usable labels (every score is 0.5) all rows stay. Rows of
    equal text go or stay together, whatever their keys, null keys included. A score at the threshold stays.
    """
    train = bounded_sample(docs if fit_on is None else fit_on, labels, "quality", ~held_out(F.col(key), 5, 0), key, text, rows)
    name = unused(docs, "_score")
    return docs.withColumn(name, scorer(docs, fit(train), text)).where(F.col(name) >= threshold).drop(name)
