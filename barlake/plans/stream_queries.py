"""Queries of streams: corrected bars, bars taken once, events of fills and their ledger.

Sources are Parquet folders of the session's shared folder, written from the given tables in files that the stream reads
one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barlake.streaming import corrections, fills, jobs, once

from .intraday_queries import _work_dir
from .registry import query, table

def _in_files(rows: DataFrame, path: str, number) -> DataFrame:  # noqa: ANN001
    """rows as a stream that reads them file by file, in the order of number (0, 1, 2, ...)."""
    spark = rows.sparkSession
    for k in range(4):
        rows.where(number == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


# ---- versions of bars: a bar's later events correct it, and every fourth event comes in a file of its own, out of order

_VERSIONS = """v AS (SELECT date_trunc('hour', ts) AS timestamp, event_type AS symbol, 100 + 0.0123456789 * value AS close, 1 + event_id % 100 AS volume, (event_id * 7919) % 100003 AS seen_at FROM events)"""


def _versions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    close = 100 + 0.0123456789 * F.col("value")
    return e.select(F.date_trunc("hour", "ts").alias("timestamp"), F.col("event_type").alias("symbol"), *[close.alias(c) for c in ("open", "high", "low", "close")], (1 + F.col("event_id") % 100).alias("volume"), ((F.col("event_id") * 7919) % 100003).alias("seen_at"), (F.col("event_id") % 4).alias("number"))


def _shown(bars: DataFrame) -> DataFrame:
    return bars.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "symbol", F.round("close", 6).alias("close"), "volume")


@query(f"WITH {_VERSIONS}, w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY timestamp, symbol ORDER BY seen_at DESC, close DESC, volume DESC) AS k FROM v) SELECT timestamp, symbol, ROUND(close, 6) AS close, volume FROM w WHERE k = 1")
def k02_corrected_bars(spark, sf_dir):
    """Corrected and late bars in files out of order, merged batch by batch: as the newest of each bar in one table."""
    base = _work_dir(spark)
    rows = _versions(spark, sf_dir)
    stream = _in_files(rows, f"{base}/in", F.col("number"))
    once.run_into(stream, corrections.merge_bars(spark, f"{base}/bars", stream.schema, "k02"), f"{base}/checkpoint")
    return _shown(corrections.merged_bars(spark, f"{base}/bars", stream.schema))


@query(f"WITH {_VERSIONS}, w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY timestamp, symbol ORDER BY seen_at DESC, close DESC, volume DESC) AS k FROM v) SELECT timestamp, symbol, ROUND(close, 6) AS close, volume FROM w WHERE k = 1 AND timestamp <= (SELECT MAX(timestamp) FROM v) - INTERVAL 6 HOUR")
def k02_closed_bars(spark, sf_dir):
    """Bars that stay open for corrections until the watermark has passed them; all versions come in time."""
    base = _work_dir(spark)
    rows = _versions(spark, sf_dir)
    day = F.datediff("timestamp", F.lit("2024-01-01"))
    # files by weeks, so that versions are late by less than a bar
    stream = _in_files(rows.withColumn("number", F.least(F.floor(day / 7), F.lit(3))), f"{base}/in", F.col("number"))
    out = corrections.latest_bars(stream, "6 hours")
    jobs.run_available(out, base)
    return _shown(spark.read.schema(out.schema).parquet(f"{base}/data"))


# ---- each bar once

@query("SELECT symbol, ts AS timestamp, ROUND(100 + 0.0123456789 * value, 6) AS close FROM (SELECT *, 'U' || CAST(user_id AS VARCHAR) AS symbol FROM events)")
def k03_once_per_bar(spark, sf_dir):
    """A stream run twice and one of its batches run again: every bar is in the ledger once."""
    base = _work_dir(spark)
    e = table(spark, sf_dir, "events")
    bars = e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").alias("timestamp"), (100 + 0.0123456789 * F.col("value")).alias("close"))
    week = F.least(F.floor(F.datediff("timestamp", F.lit("2024-01-01")) / 7), F.lit(3))
    shape = bars.schema
    stream = _in_files(bars, f"{base}/in", week)
    once.start_ledger(spark, f"{base}/ledger", shape)
    sink = once.once_per_bar(f"{base}/ledger", shape, once.run_name(f"{base}/checkpoint"), ["symbol"], "timestamp")
    once.run_into(stream, sink, f"{base}/checkpoint")
    once.run_into(stream, sink, f"{base}/checkpoint")  # nothing is new
    sink(bars.where(week == 1), 1)  # a batch that is run again
    again = once.once_per_bar(f"{base}/ledger", shape, once.run_name(f"{base}/lost"), ["symbol"], "timestamp")
    once.run_into(stream, again, f"{base}/lost")  # and a stream whose checkpoint was lost
    found = once.read_ledger(spark, f"{base}/ledger", shape)
    return found.select("symbol", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.round("close", 6).alias("close"))


# ---- events of fills

_FILLS = """WITH RECURSIVE q AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, epoch_us(ts) // 1000 AS ms, 100 + 0.0123456789 * value - 0.01 AS bid, 100 + 0.0123456789 * value + 0.0012345 * (event_id % 11) AS ask,
  100 + 0.0123456789 * value + 0.0123 * (event_id % 9 - 4) AS reference_price, CASE WHEN event_type IN ('view', 'click') THEN -0.01 * (1 + event_id % 3) ELSE 0.0 END AS target_weight, event_id % 7 <> 0 AS shortable, event_id % 5 <> 0 AS easy_to_borrow FROM events),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ms) AS k FROM q),
st AS (SELECT symbol, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS quantity, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS pending, CAST(-1 AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS action, CAST(0 AS DOUBLE) AS held, CAST(0 AS DOUBLE) AS entered, CAST(0 AS DOUBLE) AS wanted, CAST(-1 AS BIGINT) AS before FROM (SELECT DISTINCT symbol FROM q)
  UNION ALL SELECT symbol, k, CASE action WHEN 'entry' THEN -pending * 100000 / bid WHEN 'exit' THEN 0 ELSE quantity END, CASE action WHEN 'entry' THEN bid WHEN 'exit' THEN 0 ELSE entry END, LEAST(target_weight, 0), ms, action, quantity, entry, pending, last FROM (
    SELECT n.*, st.quantity, st.entry, st.pending, st.last, CASE WHEN st.quantity > 0 AND st.pending >= 0 THEN CASE WHEN n.ask > 0 AND n.reference_price * 1.0002 >= n.ask THEN 'exit' ELSE 'missed_exit' END
      WHEN st.quantity = 0 AND st.pending < 0 THEN CASE WHEN n.shortable AND n.easy_to_borrow AND n.bid > 0 AND n.reference_price * 0.9998 <= n.bid THEN 'entry' ELSE 'blocked_entry' END END AS action
    FROM st JOIN n ON n.symbol = st.symbol AND n.k = st.k + 1)),
ev AS (SELECT st.symbol, n.ms, st.before AS signal, st.action, CASE st.action WHEN 'exit' THEN 'marketable' WHEN 'entry' THEN 'marketable_etb' WHEN 'missed_exit' THEN 'limit_not_marketable' ELSE CASE WHEN n.shortable AND n.easy_to_borrow THEN 'limit_not_marketable' ELSE 'not_easy_to_borrow' END END AS reason,
    st.wanted AS target_weight, n.reference_price, n.bid, n.ask, CASE WHEN n.bid > 0 AND n.ask > n.bid THEN (n.ask - n.bid) / ((n.ask + n.bid) / 2) * 10000 END AS spread_bps,
    CASE st.action WHEN 'entry' THEN n.bid WHEN 'exit' THEN n.ask ELSE 0 END AS fill_price, CASE st.action WHEN 'entry' THEN st.quantity WHEN 'blocked_entry' THEN 0 ELSE st.held END AS quantity, CASE WHEN st.action = 'exit' THEN (st.entered - n.ask) * st.held ELSE 0 END AS pnl
  FROM st JOIN n USING (symbol, k) WHERE st.action IS NOT NULL),
un AS (SELECT st.symbol, st.last, st.pending, st.quantity, COALESCE(LEAD(st.last) OVER (PARTITION BY st.symbol ORDER BY st.k), (SELECT MAX(ms) FROM q) - 600000) AS until FROM st),
no AS (SELECT symbol, last + 14400000 * UNNEST(RANGE(1, CAST(GREATEST(CEIL((until - last) / 14400000.0), 1) AS BIGINT))) AS ms, last AS signal, 'missed_exit' AS action, 'no_quote' AS reason, pending AS target_weight, 0.0 AS reference_price, 0.0 AS bid, 0.0 AS ask, CAST(NULL AS DOUBLE) AS spread_bps, 0.0 AS fill_price, quantity, 0.0 AS pnl
  FROM un WHERE quantity > 0 AND pending >= 0 AND until > last)
SELECT symbol, ms AS observed_ms, signal AS signal_ms, action, reason, ROUND(target_weight, 6) AS target_weight, ROUND(reference_price, 6) AS reference_price, ROUND(spread_bps, 6) AS spread_bps, ROUND(fill_price, 6) AS fill_price, ROUND(quantity, 6) AS quantity, ROUND(pnl, 6) AS pnl
FROM (SELECT * FROM ev UNION ALL SELECT * FROM no)"""


def _quotes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mid, n = 100 + 0.0123456789 * F.col("value"), F.col("event_id")
    short = F.when(F.col("event_type").isin("view", "click"), -0.01 * (1 + n % 3)).otherwise(0.0)
    easy = n % 5 != 0
    return e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").alias("timestamp"), (mid - 0.01).alias("bid"), (mid + 0.0012345 * (n % 11)).alias("ask"), (mid + 0.0123 * (n % 9 - 4)).alias("reference_price"),
        short.alias("target_weight"), (n % 7 != 0).alias("shortable"), easy.alias("easy_to_borrow"), F.when(easy, "easy_to_borrow").otherwise("hard_to_borrow").alias("borrow_status"),
    )


def _fill_stream(spark, sf_dir, base: str) -> DataFrame:
    week = F.least(F.floor(F.datediff("timestamp", F.lit("2024-01-01")) / 7), F.lit(3))
    return fills.fill_events(_in_files(_quotes(spark, sf_dir), f"{base}/in", week), wait_minutes=240)


def _events_shown(events: DataFrame) -> DataFrame:
    return events.select("symbol", F.unix_millis("observed_at").alias("observed_ms"), F.unix_millis("signal_timestamp").alias("signal_ms"), "action", "reason", *[F.round(c, 6).alias(c) for c in ("target_weight", "reference_price", "spread_bps", "fill_price", "quantity", "pnl")])


@query(_FILLS)
def k04_fill_events(spark, sf_dir):
    """Entries, exits, blocked entries and missed exits of all symbols, told by quotes and by timers."""
    base = _work_dir(spark)
    out = _fill_stream(spark, sf_dir, base)
    jobs.run_available(out, base)
    return _events_shown(spark.read.schema(out.schema).parquet(f"{base}/data"))


@query(_FILLS)
def k05_event_ledger(spark, sf_dir):
    """The same events appended to a ledger batch by batch, the stream being run twice: none is there twice."""
    base = _work_dir(spark)
    out = _fill_stream(spark, sf_dir, base)
    shape = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in out.dtypes))
    once.start_ledger(spark, f"{base}/ledger", shape)
    sink = once.append_once(f"{base}/ledger", shape, once.run_name(f"{base}/checkpoint"))
    once.run_into(out, sink, f"{base}/checkpoint")
    once.run_into(out, sink, f"{base}/checkpoint")
    return _events_shown(once.read_ledger(spark, f"{base}/ledger", shape))
