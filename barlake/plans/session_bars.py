"""Bars of trading sessions derived from lineitem: eight bars a week's session, names that grow with the suppliers.

N0 serves as benchmark. The same table as a DataFrame and as SQL of a second engine; constants are odd so that no
rounding lies on a tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.sources.bars import MARKET_ZONE

from .registry import table

CLOCKS = (600, 690, 735, 750, 765, 780, 870, 960)
BENCHMARK = "N0"
_CLOCK = "[" + ", ".join(map(str, CLOCKS)) + "]"

#: Tables rb and, with local times, rc.
SESSION_SQL = f"""ln AS (SELECT CAST(DATE_TRUNC('week', l_shipdate) AS DATE) AS session, 'N' || CAST(l_suppkey % (SELECT GREATEST(5, COUNT(*) // 20) FROM supplier) AS VARCHAR) AS symbol, {_CLOCK}[1 + (l_orderkey * 7 + l_linenumber) % 8] AS clk, l_discount, l_tax, l_quantity FROM lineitem),
lb AS (SELECT session, symbol, clk, ROUND(100 * (1 + 0.0365432109 * (MAX(l_discount) - 0.05) + 0.0123456789 * (MIN(l_tax) - 0.04)), 4) AS open, ROUND(100 * (1 + 0.0987654321 * (AVG(l_discount) - 0.05) + 0.0123456789 * (AVG(l_tax) - 0.04)), 4) AS close,
  ROUND(0.0987654321 * MAX(l_tax), 4) AS up, ROUND(0.0897654321 * MAX(l_discount), 4) AS down, SUM(l_quantity) * 1000 AS volume FROM ln GROUP BY 1, 2, 3),
rb AS (SELECT timezone('UTC', timezone('America/New_York', CAST(session AS TIMESTAMP) + clk * INTERVAL 1 MINUTE)) AS timestamp, symbol, session, open, GREATEST(open, close) + up AS high, LEAST(open, close) - down AS low, close, volume FROM lb),
rc AS (SELECT *, timezone('America/New_York', timezone('UTC', timestamp)) AS l FROM rb)"""


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(timestamp, symbol, session, open, high, low, close, volume)."""
    names = F.greatest(F.lit(5), F.floor(F.count(F.lit(1)) / 20)).alias("names")
    many = table(spark, sf_dir, "supplier").agg(names)  # one row
    clock = F.get(F.array(*map(F.lit, CLOCKS)), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 8).cast("int"))
    symbol = F.concat(F.lit("N"), (F.col("l_suppkey") % F.col("names")).cast("string"))
    lines = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(many)).select(F.to_date(F.date_trunc("week", "l_shipdate")).alias("session"), symbol.alias("symbol"), clock.alias("clk"), "l_discount", "l_tax", "l_quantity")
    cells = lines.groupBy("session", "symbol", "clk").agg(
        F.round(100 * (1 + 0.0365432109 * (F.max("l_discount") - 0.05) + 0.0123456789 * (F.min("l_tax") - 0.04)), 4).alias("open"), F.round(100 * (1 + 0.0987654321 * (F.avg("l_discount") - 0.05) + 0.0123456789 * (F.avg("l_tax") - 0.04)), 4).alias("close"),
        F.round(0.0987654321 * F.max("l_tax"), 4).alias("up"), F.round(0.0897654321 * F.max("l_discount"), 4).alias("down"), (F.sum("l_quantity") * 1000).alias("volume"),
    )
    local = F.to_timestamp(F.timestamp_seconds(F.unix_timestamp(F.col("session").cast("timestamp")) + F.col("clk") * 60))
    return cells.select(
        F.to_utc_timestamp(local, MARKET_ZONE).alias("timestamp"), "symbol", "session", "open", (F.greatest("open", "close") + F.col("up")).alias("high"), (F.least("open", "close") - F.col("down")).alias("low"), "close", "volume"
    )
