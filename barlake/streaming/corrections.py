"""Streams of bars that are corrected: of several versions of a bar the one seen last wins.

Two ways. latest_bars keeps a bar open until the watermark has passed it and then gives its last version once. merge_bars
takes corrections at any time: each batch reduces its versions to one a bar and adds them to a dataset by batch, which is
read as the newest version of each bar and can be compacted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .once import read_ledger, start_ledger

VALUES = ("open", "high", "low", "close", "volume")


def _newest(values: Sequence[str], seen: Sequence[str | Column]) -> Column:
    return F.max_by(F.struct(*values), F.struct(*seen)).alias("_bar")


def latest_bars(bars: DataFrame, late: str = "10 minutes", seen: str = "seen_at", values: Sequence[str] = VALUES) -> DataFrame:
    """(timestamp, symbol, values) of each bar, once, when the watermark has passed it: the version with the highest seen.

    bars: a stream of versions (timestamp, symbol, values, seen), in any order. Versions that come after their bar left
    are dropped; give a watermark that covers the corrections, or merge.
    """
    open_ = bars.withWatermark("timestamp", late).groupBy("timestamp", "symbol").agg(_newest(values, [seen, *values]))
    return open_.select("timestamp", "symbol", "_bar.*")


def _shape(versions: StructType, values: Sequence[str], seen: str) -> StructType:
    return StructType([versions[c] for c in ("timestamp", "symbol", *values, seen)])


def merge_bars(spark: SparkSession, path: str, versions: StructType, run: str, seen: str = "seen_at", values: Sequence[str] = VALUES) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch's versions of bars to the dataset at path, one a bar and batch."""
    shape = _shape(versions, values, seen)
    start_ledger(spark, path, shape)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("timestamp", "symbol").agg(_newest([*values, seen], [seen, *values])).select("timestamp", "symbol", "_bar.*")
        rows.select(*shape.fieldNames()).write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return write


def merged_bars(spark: SparkSession, path: str, versions: StructType, seen: str = "seen_at", values: Sequence[str] = VALUES) -> DataFrame:
    """The newest version of each bar of a merged dataset."""
    rows = read_ledger(spark, path, _shape(versions, values, seen))
    return rows.groupBy("timestamp", "symbol").agg(_newest([*values, seen], [seen, *values])).select("timestamp", "symbol", "_bar.*")


def compact_bars(spark: SparkSession, path: str, into: str, versions: StructType, seen: str = "seen_at", values: Sequence[str] = VALUES) -> None:
    """Write a merged dataset anew, one version a bar; readers and the stream go on with the new path."""
    rows = merged_bars(spark, path, versions, seen, values).withColumns({"run": F.lit("compacted"), "batch": F.lit(-1).cast("long")})
    rows.write.partitionBy("run", "batch").parquet(into)
