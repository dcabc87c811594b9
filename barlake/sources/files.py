"""Landed files and datasets: bars as a partitioned dataset, bundles, results and ledgers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barlake.operators.universe import merge_adjacent

from .bars import BAR_SCHEMA, select_bars, upsert

BAR_DATASET = T.StructType([*BAR_SCHEMA.fields, T.StructField("year", T.IntegerType())])


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as a dataset partitioned by year and clustered by symbol; a year that is written again is replaced."""
    rows = bars.withColumn("year", F.year("timestamp"))
    rows.repartition("year", "symbol").sortWithinPartitions("year", "symbol", "timestamp").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def read_bars(spark: SparkSession, path: str, symbols: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """What a dataset holds of the symbols in an inclusive time range; other years are not listed, other names not decoded."""
    rows = spark.read.schema(BAR_DATASET).parquet(path)
    if start is not None:
        rows = rows.where(F.col("year") >= F.year(F.lit(start).cast("timestamp")))
    if end is not None:
        rows = rows.where(F.col("year") <= F.year(F.lit(end).cast("timestamp")))
    return select_bars(rows, symbols, start, end).drop("year")


def refresh_bars(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Put fresh bars in or over those of the dataset; only the years that they touch are rewritten."""
    years = [r["y"] for r in fresh.select(F.year("timestamp").alias("y")).distinct().orderBy("y").collect()]  # calendar years
    old = spark.read.schema(BAR_DATASET).parquet(path).where(F.col("year").isin(years)).drop("year")
    # staged first, as years are read and replaced; readers do not see the folder, and what fails before the swap changes nothing
    staged = f"{path.rstrip('/')}/_refresh-{uuid.uuid4().hex}"
    upsert(old, fresh.select(*old.columns)).write.parquet(staged)
    write_bars(spark.read.schema(BAR_SCHEMA).parquet(staged), path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def constituents(lists: DataFrame, months: DataFrame) -> DataFrame:
    """(symbol, start, end) of dated member lists: each month has the members of the last list at or before its start.

    lists: (date, members), members a comma-joined text; a name's -YYYYMM suffix (a former member's) is cut and its dot becomes a dash.
    months: (month), first days. Adjacent months are merged.
    """
    dates = lists.select(F.col("date").alias("_d"), F.lit(0).alias("_side")).distinct().unionByName(months.select(F.col("month").alias("_d"), F.lit(1).alias("_side")).distinct())
    last = F.last(F.when(F.col("_side") == 0, F.col("_d")), ignorenulls=True).over(Window.orderBy("_d", "_side"))  # a calendar table
    of_month = dates.withColumn("date", last).where("_side = 1 and date is not null").select(F.col("_d").alias("month"), "date")
    names = of_month.join(lists, "date").select("month", F.explode(F.split("members", ",")).alias("m"))
    symbol = F.regexp_replace(F.regexp_replace(F.upper(F.trim("m")), r"-\d{6}$", ""), r"\.", "-")
    rows = names.select(symbol.alias("symbol"), F.col("month").alias("start"), F.last_day("month").alias("end")).where("symbol <> ''").distinct()
    return merge_adjacent(rows)


def read_bundles(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(file, json) of each JSON document in a folder and those below it, one to a file."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("json"))


def save_results(path: str, tables: dict[str, DataFrame], key: str = "run_id") -> None:
    """Result tables (equity, trades, targets, metrics ...) under path/name, partitioned by run; a run saved again is replaced."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{path.rstrip('/')}/{name}")


def append_ledger(records: DataFrame, path: str) -> None:
    """Records put behind those that a JSON-lines ledger holds."""
    records.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
