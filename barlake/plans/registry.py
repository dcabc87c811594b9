"""Query registry and the tables that queries share, as DataFrames and as the same SQL text for a second engine."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.sources.bars import densify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BARS = """
d AS (SELECT {session} AS session, l_suppkey % {symbols} AS k, AVG(l_discount) - 0.05 AS r, AVG(l_tax) - 0.04 AS g,
  MAX(l_discount) AS hi, MAX(l_tax) AS lo, SUM(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
e AS (SELECT *, ROUND(100 * EXP(SUM(0.2 * r) OVER (PARTITION BY k ORDER BY session)), 4) AS close FROM d),
f AS (SELECT *, ROUND(COALESCE(LAG(close) OVER (PARTITION BY k ORDER BY session), close) * (1 + 0.0987654321 * g), 4) AS open FROM e),
bars AS (SELECT session AS timestamp, CONCAT('S', CAST(k AS VARCHAR(4))) AS symbol, open,
  ROUND(GREATEST(open, close) * (1 + 0.0123456789 * hi), 4) AS high,
  ROUND(LEAST(open, close) * (1 - 0.0123456789 * lo), 4) AS low, close, q * 1000 AS volume FROM f)"""
_DAY, _WEEK = "CAST(l_shipdate AS DATE)", "CAST(DATE_TRUNC('week', l_shipdate) AS DATE)"
PANELS = {"daily10": (_DAY, 10), "daily5": (_DAY, 5), "weekly10": (_WEEK, 10), "weekly5": (_WEEK, 5)}

PANEL_SQL = """
panel AS (SELECT t.timestamp, s.symbol, b.open, b.high, b.low, b.close, b.volume
  FROM (SELECT DISTINCT timestamp FROM bars) t CROSS JOIN (SELECT DISTINCT symbol FROM bars) s
  LEFT JOIN bars b ON b.timestamp = t.timestamp AND b.symbol = s.symbol),
p AS (SELECT *, close / LAG(close) OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS r FROM panel)"""


def bars_sql(panel: str = "daily10") -> str:
    session, symbols = PANELS[panel]
    return _BARS.format(session=session, symbols=symbols)


def with_bars(select: str, panel: str = "daily10", extra: str = "") -> str:
    return f"WITH {bars_sql(panel)}{',' + extra if extra else ''}\n{select}"


def with_panel(select: str, panel: str = "daily10", extra: str = "") -> str:
    return with_bars(select, panel, PANEL_SQL + ("," + extra if extra else ""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its timestamps, which carry no zone, are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def bars(spark: SparkSession, sf_dir: str, panel: str = "daily10") -> DataFrame:
    """Bars derived from lineitem. They are kept, as a query reads them several times; equal ones are kept once."""
    return bars_of(spark, table(spark, sf_dir, "lineitem"), panel, PANELS[panel][1]).persist(StorageLevel.MEMORY_AND_DISK)


def bars_of(spark: SparkSession, lines: DataFrame, panel: str, symbols: int) -> DataFrame:
    """Bars of the given lines, a symbol being the supplier's number modulo symbols."""
    return spark.sql("WITH " + _BARS.format(session=PANELS[panel][0], symbols=symbols).replace("FROM lineitem", "FROM {lines}") + " SELECT * FROM bars", lines=lines)


def work_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; a local one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", "") or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back, for a query that reads it several times."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def panel_of(spark: SparkSession, sf_dir: str, panel: str = "daily10") -> DataFrame:
    from barlake.functions.factors import ts_returns

    return densify(bars(spark, sf_dir, panel)).withColumn("r", ts_returns("close", 1))


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def query(sql: str | None = None):
    def keep(f):
        register(f.__name__, f, sql)
        return f

    return keep
