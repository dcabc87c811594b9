"""Queries of intraday operators and streams over bars made of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlake.operators import intraday as I
from barlake.sources import bars as B
from barlake.streaming import jobs

from .registry import query
from .registry import work_dir as _work_dir
from .strategy_queries import _rounded, _scores
from .table_queries import _resample_sql, _ticks

_RB = f"rb AS ({_resample_sql(15)}), rc AS (SELECT *, timezone('America/New_York', timezone('UTC', timestamp)) AS l FROM rb)"
_W = "OVER (PARTITION BY symbol, session ORDER BY timestamp)"


def _bars15(spark, sf_dir):
    return _rounded(B.resample_sessions(_ticks(spark, sf_dir), 15))


def _ntz(df):
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")) if "timestamp" in df.columns else df


_DAY = """dy AS (SELECT symbol, session, ARG_MIN(open, timestamp) AS first_open, ARG_MAX(close, timestamp) AS session_close FROM rb GROUP BY 1, 2),
dz AS (SELECT symbol, session, first_open, LAG(session_close) OVER w AS prior_close, LAG(session_close) OVER w / LAG(session_close, 2) OVER w - 1 AS prior_return FROM dy WINDOW w AS (PARTITION BY symbol ORDER BY session))"""


@query(
    f"WITH {_RB}, {_DAY} SELECT rb.timestamp, rb.symbol, LEAD(open) {_W.replace('symbol, session', 'rb.symbol, rb.session').replace('BY timestamp', 'BY rb.timestamp')} AS next_open, first_open, prior_close, ROUND(prior_return, 6) AS prior_return, ROUND(first_open / prior_close - 1, 6) AS gap FROM rb JOIN dz ON dz.symbol = rb.symbol AND dz.session = rb.session"
)
def b03_session_attributes(spark, sf_dir):
    return _ntz(_rounded(I.session_attributes(_bars15(spark, sf_dir)).select("timestamp", "symbol", "next_open", "first_open", "prior_close", "prior_return", "gap")))


_VW = f"vw AS (SELECT *, SUM((high + low + close) / 3 * volume) {_W} / NULLIF(SUM(volume) {_W}, 0) AS vwap, FIRST_VALUE(open) {_W} AS fo, ABS(close - COALESCE(LAG(close) {_W}, open)) AS step, EXTRACT(hour FROM l) * 60 + EXTRACT(minute FROM l) AS clock FROM rc), oe AS (SELECT *, close / fo - 1 AS opening_return, ABS(close - fo) / NULLIF(SUM(step) {_W}, 0) AS efficiency FROM vw)"


@query(f"WITH {_RB}, {_VW} SELECT timestamp, symbol, ROUND(vwap, 6) AS vwap FROM vw")
def d16_session_vwap(spark, sf_dir):
    return _ntz(_rounded(I.session_vwap(_bars15(spark, sf_dir)).select("timestamp", "symbol", "vwap")))


@query(f"WITH {_RB} SELECT timestamp, symbol, ROUND(close / LAG(close, 2) {_W} - 1, 6) AS horizon FROM rb")
def d17_horizon_return(spark, sf_dir):
    return _ntz(_rounded(I.horizon_return(_bars15(spark, sf_dir), 2).select("timestamp", "symbol", "horizon")))


@query(f"WITH {_RB}, {_VW} SELECT timestamp, symbol, ROUND(opening_return, 6) AS opening_return, ROUND(efficiency, 6) AS efficiency FROM oe")
def d23_opening_efficiency(spark, sf_dir):
    return _ntz(_rounded(I.opening_efficiency(_bars15(spark, sf_dir)).select("timestamp", "symbol", "opening_return", "efficiency")))


def _daily_sql(up: bool) -> str:
    test = "opening_return >= 0.0005 AND close >= vwap" if up else "opening_return <= -0.0005 AND close <= vwap"
    score = "opening_return" if up else "-opening_return"
    return f"""WITH {_RB}, {_VW}, ch AS (SELECT symbol, session, s, ROW_NUMBER() OVER (PARTITION BY session ORDER BY ROUND(s, 9) DESC, symbol) AS k FROM (SELECT *, {score} AS s FROM oe WHERE clock = 630 AND {test})),
cw AS (SELECT symbol, session, s, LEAST(0.4, 1.0 / COUNT(*) OVER (PARTITION BY session)) AS wt FROM ch WHERE k <= 3)
SELECT oe.timestamp, oe.symbol, ROUND(CASE WHEN clock < 945 THEN wt ELSE 0.0 END, 6) AS target_weight, ROUND(s, 6) AS score FROM oe JOIN cw ON cw.symbol = oe.symbol AND cw.session = oe.session WHERE clock BETWEEN 630 AND 945"""


@query(_daily_sql(False))
def e14_daily_reversal(spark, sf_dir):
    return _ntz(_rounded(I.once_daily_reversal(_bars15(spark, sf_dir), 630, 945, 0.0005, 3, 0.4)))


@query(_daily_sql(True))
def e15_daily_continuation(spark, sf_dir):
    return _ntz(_rounded(I.once_daily_reversal(_bars15(spark, sf_dir), 630, 945, 0.0005, 3, 0.4, continuation=True)))


_BOOK = f"""{_RB}, {_VW}, bk AS (SELECT *, LEAST(2, COUNT(*) OVER (PARTITION BY session) // 2) AS side, ROW_NUMBER() OVER (PARTITION BY session ORDER BY ROUND(opening_return, 9) DESC, symbol) AS hi,
  ROW_NUMBER() OVER (PARTITION BY session ORDER BY ROUND(opening_return, 9), symbol DESC) AS lo FROM oe WHERE clock = 630),
bs AS (SELECT *, CASE WHEN hi <= side THEN 1.0 WHEN lo <= side THEN -1.0 END AS sg FROM bk),
bw AS (SELECT timestamp, session, symbol, sg, sg * LEAST(0.3, 1.0 / COUNT(*) OVER (PARTITION BY session)) AS target_weight, opening_return AS score FROM bs WHERE sg IS NOT NULL)"""


@query(f"WITH {_BOOK} SELECT timestamp, session, symbol, ROUND(target_weight, 6) AS target_weight, ROUND(score, 6) AS score FROM bw")
def e20_neutral_book(spark, sf_dir):
    return _ntz(_rounded(I.neutral_book(_bars15(spark, sf_dir), 630, 2, 0.3)))


@query(
    f"""WITH {_BOOK}, nx AS (SELECT *, LEAD(open) {_W} AS nxt, EXTRACT(hour FROM l) * 60 + EXTRACT(minute FROM l) AS clock FROM rc)
SELECT bw.symbol, bw.session, ROUND(sg * (COALESCE(x.nxt, x.close) * (1 - sg * 0.0008) / (e.nxt * (1 + sg * 0.0008)) - 1), 6) AS leg_return
FROM bw JOIN nx e ON e.timestamp = bw.timestamp AND e.symbol = bw.symbol JOIN nx x ON x.symbol = bw.symbol AND x.session = bw.session AND x.clock = 900 WHERE e.nxt IS NOT NULL"""
)
def g05_leg_returns(spark, sf_dir):
    b = _bars15(spark, sf_dir)
    return _rounded(I.leg_returns(b, I.neutral_book(b, 630, 2, 0.3), 900, 8.0).select("symbol", "session", "leg_return"))


@query(
    f"WITH {_RB}, cv AS (SELECT session, timestamp, AVG(close) AS equity FROM rb GROUP BY 1, 2), dd AS (SELECT session, ARG_MAX(equity, timestamp) AS equity FROM cv GROUP BY 1) SELECT session, ROUND(equity, 6) AS equity, ROUND(equity / LAG(equity) OVER (ORDER BY session) - 1, 6) AS daily_return FROM dd"
)
def b05_session_rollup(spark, sf_dir):
    curve = _bars15(spark, sf_dir).groupBy("session", "timestamp").agg(F.avg("close").alias("equity"))
    return _rounded(I.session_rollup(curve))


@query()
def e05_buffered_selection(spark, sf_dir):
    s = _scores(spark, sf_dir).where("score is not null")
    rank = F.row_number().over(Window.partitionBy("timestamp").orderBy(F.col("score").desc(), "symbol"))
    sector = F.concat(F.lit("G"), (F.substring("symbol", 2, 2).cast("int") % 3).cast("string"))
    ranked = s.select(F.lit(0).alias("variant_id"), "timestamp", "symbol", rank.alias("rank"), sector.alias("sector"))
    return I.buffered_selection(ranked, 3, 5, 2)


@query(
    """WITH t AS (SELECT ts, event_type AS symbol, MIN(100 + 0.0123456789 * value) AS price, MIN(1 + event_id % 100) AS volume FROM events GROUP BY 1, 2), b AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS timestamp FROM t)
SELECT timestamp, symbol, ROUND(ARG_MIN(price, ts), 6) AS open, ROUND(MAX(price), 6) AS high, ROUND(MIN(price), 6) AS low, ROUND(ARG_MAX(price, ts), 6) AS close, CAST(SUM(volume) AS BIGINT) AS volume
FROM b WHERE timestamp <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2"""
)
def k01_stream_bars(spark, sf_dir):
    """The events table as a stream of ticks, run to its end; what the stream wrote is read back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ticks = raw.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("symbol"), (100 + 0.0123456789 * F.col("value")).alias("price"), (1 + F.col("event_id") % 100).alias("volume"))
    path = _work_dir(spark)
    out = jobs.stream_bars(ticks)
    jobs.run_available(out, path)
    return _ntz(_rounded(spark.read.schema(out.schema).parquet(f"{path}/data")))


