"""Sinks that take each bar once, however often a stream, or one of its batches, is run.

A ledger is a folder of Parquet files by run and batch. A batch always writes its own folder, so running it again writes
the same rows and not more of them; what other batches hold decides which rows are new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PLACE = "run string, batch long"


def start_ledger(spark: SparkSession, path: str, schema: StructType) -> None:
    """Make an empty ledger where there is none; one that is there stays as it is."""
    rows = spark.createDataFrame([], schema).withColumns({"run": F.lit("-"), "batch": F.lit(-1).cast("long")})
    rows.write.partitionBy("run", "batch").mode("ignore").parquet(path)


def read_ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, *StructType.fromDDL(_PLACE).fields])).option("basePath", path).parquet(path)


def run_name(checkpoint: str) -> str:
    """The name of a stream in a ledger: batch numbers count from zero for each checkpoint."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def once_per_bar(path: str, schema: StructType, run: str, keys: Sequence[str], at: str, process: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes the rows of bars that are newer than any in the ledger for their keys.

    The newest bar in the ledger is the mark of a key; a batch does not see its own former rows, nor those of later
    batches of its run, so that it does the same when it is run again. Rows of one batch that share keys and bar count
    once. process turns new rows into records of the schema, with the keys and the bar's time.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        others = read_ledger(spark, path, schema).where((F.col("run") != run) | (F.col("batch") < number))
        marks = others.groupBy(*keys).agg(F.max(at).alias("_mark"))
        new = batch.dropDuplicates([*keys, at]).join(marks, list(keys), "left").where(F.col("_mark").isNull() | (F.col(at) > F.col("_mark"))).drop("_mark")
        records = process(new) if process else new
        records.select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return write


def append_once(path: str, schema: StructType, run: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends every row of a batch, once for each run and batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return write


def run_into(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what its source holds now; a later run with the same checkpoint adds only what is new."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
