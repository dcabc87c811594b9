"""Materialisation and small helpers that the text operators share."""

from __future__ import annotations

import gc
import math
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a Python worker gets at once, and the setting that says so. Spark's own default of 64 MB, held by
#: the JVM and the worker at the same time, takes most of what a small executor has beside its heap.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver was started; once for each application.

    Batches are held to BATCH_BYTES, unless the session has a size of its own.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING) == f"{_BATCH_DEFAULT}b":
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f"{package.name}/{f.relative_to(package)}")
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
        found = _own_dirs[app]
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps left: Spark deletes shuffle files and broadcasts once a collection of the driver's
    heap finds that nobody refers to them, which by itself may be long after; the heap shrinks, and the driver's Python
    gives freed memory back. Results do not depend on it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    for _ in range(2):  # what the first one frees still holds others
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two_at_least(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))
