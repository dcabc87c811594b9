"""Queries of ingest, universes, joins in time, statistics, orders and lineage."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from barlake.operators import lineage, orders, statistics, universe
from barlake.operators import weights as W
from barlake.sources import bars as B
from barlake.sources import ingest

from .registry import bars, panel_of, query, register, table, with_bars, with_panel
from .strategy_queries import _S, _rounded

# ---- sources

_RAW = """raw AS (SELECT timestamp, symbol, open, high, low, close, volume, 1 AS ingest_seq FROM bars
  UNION ALL SELECT timestamp, LOWER(symbol), open, high, low, close + 1, volume, 2 FROM bars WHERE EXTRACT(day FROM timestamp) = 7
  UNION ALL SELECT timestamp, symbol, 0, high, low, close, volume, 3 FROM bars WHERE EXTRACT(day FROM timestamp) = 9)"""


def _raw(spark, sf_dir):
    b = bars(spark, sf_dir)
    day = F.dayofmonth("timestamp")
    one = b.withColumn("ingest_seq", F.lit(1))
    two = b.where(day == 7).withColumn("symbol", F.lower("symbol")).withColumn("close", F.col("close") + 1).withColumn("ingest_seq", F.lit(2))
    return one.unionByName(two).unionByName(b.where(day == 9).withColumn("open", F.lit(0.0)).withColumn("ingest_seq", F.lit(3)))


@query(
    with_bars(
        """SELECT timestamp, symbol, open, high, low, close, volume FROM (SELECT timestamp, UPPER(symbol) AS symbol, open, high, low, close, volume,
  ROW_NUMBER() OVER (PARTITION BY timestamp, UPPER(symbol) ORDER BY ingest_seq DESC) AS k FROM raw WHERE open > 0 AND close > 0) WHERE k = 1""",
        extra=_RAW,
    )
)
def a02_conform(spark, sf_dir):
    return B.conform(_raw(spark, sf_dir))


@query(with_bars("SELECT timestamp, symbol, close FROM bars WHERE symbol IN ('S1', 'S2') AND timestamp BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'"))
def a01_select_bars(spark, sf_dir):
    return B.select_bars(bars(spark, sf_dir), ["s1", "S2"], "1995-01-01", "1995-12-31").select("timestamp", "symbol", "close")


@query(
    with_bars(
        """SELECT b.timestamp, b.symbol, CASE WHEN EXTRACT(day FROM b.timestamp) <= 5 THEN b.close * 2 ELSE b.close END AS close
FROM bars b WHERE b.timestamp >= DATE '1996-01-01'"""
    )
)
def a04_rolling_upsert(spark, sf_dir):
    b = bars(spark, sf_dir)
    fresh = b.where(F.dayofmonth("timestamp") <= 5).withColumn("close", F.col("close") * 2)
    return B.upsert(b, fresh, start=datetime.date(1996, 1, 1)).select("timestamp", "symbol", "close")


_TICKS = """ticks AS (SELECT ts AS timestamp, event_type AS symbol, 100 + 0.0123456789 * value AS price, 1 + event_id % 100 AS volume FROM events),
loc AS (SELECT *, timezone('America/New_York', timezone('UTC', timestamp)) AS l FROM ticks)"""


def _ticks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    price = 100 + 0.0123456789 * F.col("value")
    return e.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("symbol"), *[price.alias(c) for c in ("open", "high", "low", "close")], (1 + F.col("event_id") % 100).cast("double").alias("volume"))


@query(f"WITH {_TICKS} SELECT timestamp, symbol, ROUND(price, 6) AS close FROM loc WHERE CAST(l AS DATE) < DATE '2024-01-15'")
def a05_completed_sessions(spark, sf_dir):
    out = B.completed_sessions(_ticks(spark, sf_dir), "2024-01-15 12:00:00")
    return out.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "symbol", F.round("close", 6).alias("close"))


@query(f"WITH {_TICKS} SELECT symbol, CAST(COUNT(*) AS BIGINT) AS n FROM loc WHERE CAST(l AS DATE) <= DATE '2024-01-15' GROUP BY symbol")
def a06_available_at_close(spark, sf_dir):
    return B.available_at_close(_ticks(spark, sf_dir), "2024-01-15 22:00:00", False).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def _resample_sql(minutes: int) -> str:
    return f"""WITH {_TICKS}, m AS (SELECT *, CAST(EXTRACT(hour FROM l) * 60 + EXTRACT(minute FROM l) AS INTEGER) AS mi FROM loc),
k AS (SELECT *, CAST(l AS DATE) AS session, 570 + ((mi - 570) // {minutes} + 1) * {minutes} AS endm FROM m WHERE mi BETWEEN 570 AND 959)
SELECT symbol, session, timezone('UTC', timezone('America/New_York', CAST(session AS TIMESTAMP) + endm * INTERVAL 1 MINUTE)) AS timestamp,
  ROUND(ARG_MIN(price, timestamp), 6) AS open, ROUND(MAX(price), 6) AS high, ROUND(MIN(price), 6) AS low, ROUND(ARG_MAX(price, timestamp), 6) AS close, CAST(SUM(volume) AS DOUBLE) AS volume
FROM k GROUP BY symbol, session, endm
HAVING timezone('UTC', timezone('America/New_York', CAST(session AS TIMESTAMP) + endm * INTERVAL 1 MINUTE)) <= (SELECT MAX(timestamp) FROM ticks) + INTERVAL 1 MINUTE"""


def _resampled(minutes):
    def run(spark, sf_dir):
        out = _rounded(B.resample_sessions(_ticks(spark, sf_dir), minutes))
        return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))

    return run


for _m in (15, 30, 60):

    register(f"b01_resample_{_m}", _resampled(_m), _resample_sql(_m))


@query(
    f"""WITH {_TICKS}, m AS (SELECT *, CAST(EXTRACT(hour FROM l) * 60 + EXTRACT(minute FROM l) AS INTEGER) AS mi FROM loc)
SELECT timestamp + INTERVAL 15 MINUTE AS timestamp, symbol, volume::DOUBLE AS volume FROM m WHERE mi BETWEEN 570 AND 959 AND mi + 15 <= 960"""
)
def b02_label_bar_ends(spark, sf_dir):
    out = B.label_bar_ends(_ticks(spark, sf_dir), 15)
    return out.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "symbol", "volume")


@query(with_bars("SELECT CAST(DATE_TRUNC('month', timestamp) AS DATE) AS month, MAX(timestamp) AS timestamp FROM bars GROUP BY 1"))
def b06_month_ends(spark, sf_dir):
    return universe.month_ends(bars(spark, sf_dir))


@query(with_bars("SELECT symbol, MIN(timestamp) AS first, MAX(timestamp) AS last, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(DISTINCT timestamp) FROM bars), 6) AS share FROM bars GROUP BY symbol"))
def b07_coverage(spark, sf_dir):
    return _rounded(universe.coverage(bars(spark, sf_dir)))


@query(
    with_bars(
        f"""SELECT symbol, COALESCE(MAX(CASE WHEN gap > 3 THEN timestamp END), MIN(timestamp)) AS start
FROM (SELECT symbol, timestamp, DATE_DIFF('day', LAG(timestamp) OVER ({_S}), timestamp) AS gap FROM bars) GROUP BY symbol"""
    )
)
def b08_continuous_start(spark, sf_dir):
    return universe.continuous_start(bars(spark, sf_dir), 3)


@query(with_panel("SELECT timestamp, symbol, close, volume FROM panel"))
def b09_densify(spark, sf_dir):
    return B.densify(bars(spark, sf_dir)).select("timestamp", "symbol", "close", "volume")


@query(with_bars("SELECT timestamp, CAST(place AS INTEGER) AS place FROM (SELECT timestamp, ROW_NUMBER() OVER (ORDER BY timestamp) - 1 AS place FROM (SELECT DISTINCT timestamp FROM bars)) WHERE place % 7 = 0"))
def b12_rebalance_days(spark, sf_dir):
    return W.rebalance_days(bars(spark, sf_dir), 7)


@query(
    """SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'exchange' WHEN LENGTH('T' || CAST(p_partkey AS VARCHAR)) > 4 THEN 'symbol_length'
  WHEN regexp_matches(UPPER(p_type), 'PROMO|ECONOMY') THEN 'security_type' ELSE 'candidate' END AS classification FROM part"""
)
def a12_classify_assets(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_type").alias("name"), F.col("p_brand").alias("exchange"))
    return p.select("p_partkey", ingest.classify_asset("symbol", "name", "exchange", bad_exchanges=("Brand#11",), max_length=4, type_pattern="PROMO|ECONOMY").alias("classification"))


_FACTS = """fa AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS symbol, CAST(EXTRACT(year FROM o_orderdate) AS INTEGER) AS fy, CAST(EXTRACT(quarter FROM o_orderdate) AS INTEGER) AS fp,
  o_orderpriority AS concept, SUM(o_totalprice) AS val FROM orders GROUP BY 1, 2, 3, 4),
w AS (SELECT symbol, fy, fp, MAX(CASE WHEN concept = '1-URGENT' THEN val END) AS revenue, MAX(CASE WHEN concept = '2-HIGH' THEN val END) AS income,
  MAX(CASE WHEN concept = '5-LOW' THEN val END) AS assets FROM fa GROUP BY 1, 2, 3)"""


def _facts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 50).cast("string").alias("symbol"), F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("fp"), F.col("o_orderpriority").alias("concept")).agg(F.sum("o_totalprice").alias("val"))


@query(
    f"""WITH {_FACTS} SELECT c.symbol, c.fy, c.fp, ROUND(c.income / NULLIF(ABS(c.assets), 0), 6) AS return_on_assets,
  ROUND((c.revenue - p.revenue) / GREATEST(ABS(p.revenue), 1e-9), 6) AS revenue_growth FROM w c LEFT JOIN w p ON p.symbol = c.symbol AND p.fy = c.fy - 1 AND p.fp = c.fp"""
)
def a11_fundamental_features(spark, sf_dir):
    names = {"1-URGENT": "revenue", "2-HIGH": "income", "5-LOW": "assets"}
    return _rounded(ingest.fundamental_features(_facts(spark, sf_dir), names)).select("symbol", "fy", "fp", "return_on_assets", "revenue_growth")


@query(f"WITH {_FACTS} SELECT symbol, fy, fp, concept, ROUND(val, 2) AS val FROM fa")
def a10_nested_facts(spark, sf_dir):
    """Facts packed into the nested form and read back."""
    packed = ingest.pack_facts(_facts(spark, sf_dir))
    return ingest.unpack_facts(packed).select("symbol", "fy", "fp", "concept", F.round("val", 2).alias("val"))


# ---- universes and joins in time

_CAND = f"""h AS (SELECT *, close * volume AS dollar, ROW_NUMBER() OVER ({_S}) AS history FROM bars),
c AS (SELECT *, CASE WHEN COUNT(dollar) OVER ({_S} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN MEDIAN(dollar) OVER ({_S} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS median_dollar FROM h),
me AS (SELECT MAX(timestamp) AS timestamp FROM bars GROUP BY DATE_TRUNC('month', timestamp)),
cand AS (SELECT timestamp, symbol, close, history, median_dollar FROM c WHERE history >= 40 AND close >= 80 AND median_dollar >= 0 AND timestamp IN (SELECT timestamp FROM me)),
sel AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY timestamp ORDER BY median_dollar DESC, symbol) AS liquidity_rank FROM cand),
chosen AS (SELECT * FROM sel WHERE liquidity_rank <= 4)"""
_PERIODS = """, mo AS (SELECT timestamp, ROW_NUMBER() OVER (ORDER BY timestamp) AS pos, LEAD(timestamp) OVER (ORDER BY timestamp) AS nxt FROM (SELECT DISTINCT timestamp FROM chosen)),
da AS (SELECT timestamp, LEAD(timestamp) OVER (ORDER BY timestamp) AS after, LAG(timestamp) OVER (ORDER BY timestamp) AS before FROM (SELECT DISTINCT timestamp FROM bars)),
ru AS (SELECT symbol, pos - ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY pos) AS run, chosen.timestamp, pos, nxt FROM chosen JOIN mo USING (timestamp)),
rr AS (SELECT symbol, run, MIN(timestamp) AS first, ARG_MAX(nxt, pos) FILTER (WHERE TRUE) AS x, MAX(pos) AS lastpos FROM ru GROUP BY 1, 2),
r2 AS (SELECT rr.symbol, rr.first, mo.nxt AS dropped FROM rr JOIN mo ON mo.pos = rr.lastpos),
causal AS (SELECT symbol, da.after AS "start", dropped AS "end" FROM r2 LEFT JOIN da ON da.timestamp = r2.first)"""


def _candidates(spark, sf_dir):
    return universe.monthly_candidates(bars(spark, sf_dir), 20, 40, 80.0, 0.0)


@query(with_bars("SELECT timestamp, symbol, close, CAST(history AS INTEGER) AS history, ROUND(median_dollar, 4) AS median_dollar FROM cand", extra=_CAND))
def i01_monthly_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).withColumn("median_dollar", F.round("median_dollar", 4))


@query(with_bars("SELECT timestamp, symbol, CAST(liquidity_rank AS INTEGER) AS liquidity_rank FROM chosen", extra=_CAND))
def i02_top_liquid(spark, sf_dir):
    return universe.top_liquid(_candidates(spark, sf_dir), 4).select("timestamp", "symbol", "liquidity_rank")


def _periods(spark, sf_dir, causal=True):
    return universe.membership_periods(universe.top_liquid(_candidates(spark, sf_dir), 4), bars(spark, sf_dir), causal)


@query(with_bars('SELECT r2.symbol, r2.first AS "start", da.before AS "end" FROM r2 LEFT JOIN da ON da.timestamp = r2.dropped', extra=_CAND + _PERIODS))
def i03_membership_periods(spark, sf_dir):
    return _periods(spark, sf_dir, False)


@query(with_bars("SELECT * FROM causal", extra=_CAND + _PERIODS))
def i04_causal_periods(spark, sf_dir):
    return _periods(spark, sf_dir)


@query(
    with_bars(
        """SELECT symbol, MIN("start") AS "start", NULLIF(MAX(e), DATE '9999-12-31') AS "end" FROM (
  SELECT *, SUM(brk) OVER (PARTITION BY symbol ORDER BY "start", e) AS island FROM (
    SELECT *, CASE WHEN reach IS NULL OR DATE_DIFF('day', reach, "start") > 40 THEN 1 ELSE 0 END AS brk FROM (
      SELECT *, MAX(e) OVER (PARTITION BY symbol ORDER BY "start", e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
        SELECT symbol, "start", COALESCE("end", DATE '9999-12-31') AS e FROM causal WHERE "start" IS NOT NULL)))) GROUP BY symbol, island""",
        extra=_CAND + _PERIODS,
    )
)
def i06_merge_adjacent(spark, sf_dir):
    return universe.merge_adjacent(_periods(spark, sf_dir), 40)


@query(
    with_bars(
        """SELECT symbol, GREATEST(CAST(MIN("start") - INTERVAL 90 DAY AS DATE), DATE '1992-06-01') AS "start",
  LEAST(CAST(MAX(COALESCE("end", DATE '1998-11-30')) + INTERVAL 2 DAY AS DATE), DATE '1998-11-30') AS "end" FROM causal GROUP BY symbol""",
        extra=_CAND + _PERIODS,
    )
)
def i07_fetch_windows(spark, sf_dir):
    return universe.fetch_windows(_periods(spark, sf_dir), first="1992-06-01", last="1998-11-30")


@query(
    with_bars(
        'SELECT timestamp, symbol, ROUND(1.0 / COUNT(*) OVER (PARTITION BY timestamp), 6) AS target_weight, 1.0 AS score FROM bars b WHERE EXISTS (SELECT 1 FROM causal m WHERE m.symbol = b.symbol AND b.timestamp >= m."start" AND (m."end" IS NULL OR b.timestamp <= m."end"))',
        extra=_CAND + _PERIODS,
    )
)
def e04_membership_weights(spark, sf_dir):
    return W.membership_weights(bars(spark, sf_dir), _periods(spark, sf_dir)).withColumn("target_weight", F.round("target_weight", 6))


@query(
    with_bars(
        """SELECT b.timestamp, b.symbol, f.val FROM bars b ASOF LEFT JOIN (SELECT 'S' || CAST(CAST(symbol AS INTEGER) % 10 AS VARCHAR) AS symbol,
  CAST(MAKE_DATE(fy, fp * 3 - 2, 1) + INTERVAL 3 MONTH + INTERVAL 41 DAY AS DATE) AS seen, ROUND(SUM(val), 2) AS val FROM fa GROUP BY 1, 2) f
  ON f.symbol = b.symbol AND f.seen <= b.timestamp""",
        extra=_FACTS,
    )
)
def f01_as_of_join(spark, sf_dir):
    f = _facts(spark, sf_dir)
    known = F.date_add(F.add_months(F.make_date("fy", F.col("fp") * 3 - 2, F.lit(1)), 3), 40)
    f = f.groupBy(F.concat(F.lit("S"), (F.col("symbol").cast("int") % 10).cast("string")).alias("symbol"), known.alias("available_at")).agg(F.round(F.sum("val"), 2).alias("val"))
    return universe.as_of(bars(spark, sf_dir), f, ["val"]).select("timestamp", "symbol", "val")


_FEED = "second AS (SELECT timestamp, symbol, close * (1 + 0.0001 * (EXTRACT(day FROM timestamp) - 15)) AS close, volume FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY timestamp, symbol) AS k FROM bars) WHERE k % 17 <> 0)"


@query(
    with_bars(
        """SELECT COUNT(bps) AS common, CAST(COUNT(CASE WHEN cb IS NULL THEN 1 END) AS BIGINT) AS left_only, CAST(COUNT(CASE WHEN ca IS NULL THEN 1 END) AS BIGINT) AS right_only,
  ROUND(QUANTILE_CONT(bps, 0.5), 6) AS median_bps, ROUND(QUANTILE_CONT(bps, 0.95), 6) AS p95_bps, ROUND(QUANTILE_CONT(bps, 0.99), 6) AS p99_bps, ROUND(QUANTILE_CONT(vb / va, 0.5), 6) AS volume_ratio
FROM (SELECT a.close AS ca, b.close AS cb, a.volume AS va, b.volume AS vb, ABS(a.close - b.close) / ((a.close + b.close) / 2) * 10000 AS bps FROM bars a FULL JOIN second b ON a.timestamp = b.timestamp AND a.symbol = b.symbol)""",
        extra=_FEED,
    )
)
def f05_feed_agreement(spark, sf_dir):
    from pyspark.sql.window import Window

    b = bars(spark, sf_dir)
    k = F.row_number().over(Window.orderBy("timestamp", "symbol"))
    second = b.withColumn("k", k).where("k % 17 <> 0").withColumn("close", F.col("close") * (1 + 0.0001 * (F.dayofmonth("timestamp") - 15))).drop("k")
    return _rounded(universe.feed_agreement(b, second))


@query(
    with_panel(
        """SELECT x.symbol AS a, y.symbol AS b, COUNT(*) AS n, ROUND(COVAR_SAMP(x.r, y.r), 10) AS cov, ROUND(COVAR_POP(x.r, y.r) / NULLIF(STDDEV_POP(x.r) * STDDEV_POP(y.r), 0), 6) AS corr
FROM p x JOIN p y ON x.timestamp = y.timestamp AND x.symbol < y.symbol WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 20""",
        "weekly10",
    )
)
def f06_pair_statistics(spark, sf_dir):
    out = universe.pair_statistics(panel_of(spark, sf_dir, "weekly10"), "r", 20)
    return out.select("a", "b", "n", F.round("cov", 10).alias("cov"), F.round("corr", 6).alias("corr"))


@query(
    with_panel(
        """SELECT (SELECT COUNT(*) FROM x) AS n_left, (SELECT COUNT(*) FROM y) AS n_right, (SELECT COUNT(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)) AS n_both,
  (SELECT COUNT(*) FROM (SELECT * FROM x UNION SELECT * FROM y)) AS n_union, ROUND((SELECT COUNT(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)) / (SELECT COUNT(*) FROM (SELECT * FROM x UNION SELECT * FROM y)), 6) AS jaccard""",
        extra="x AS (SELECT timestamp, symbol FROM p WHERE r > 0.002), y AS (SELECT timestamp, symbol FROM p WHERE r > 0.004 OR r < -0.01)",
    )
)
def f08_signal_overlap(spark, sf_dir):
    p = panel_of(spark, sf_dir)
    out = _rounded(universe.overlap(p.where("r > 0.002"), p.where("r > 0.004 or r < -0.01"), ["timestamp", "symbol"]))
    return out.withColumn("jaccard", F.coalesce("jaccard", F.lit(float("nan"))))  # two empty sets: 0 / 0 is NaN in its SQL


# ---- statistics

_CUST = """ret AS (SELECT l_suppkey AS variant_id, CAST(l_shipdate AS DATE) AS timestamp, AVG(l_discount) - 0.05 AS daily_return FROM lineitem GROUP BY 1, 2),
mt AS (SELECT variant_id, COUNT(*) AS n, AVG(daily_return) * SQRT(252.0) / NULLIF(STDDEV_POP(daily_return), 0) AS sharpe, SUM(daily_return) AS total_return FROM ret GROUP BY 1)"""
_P = """pv AS (SELECT variant_id, CASE WHEN z >= 0 THEN tail ELSE 1 - tail END AS p_value FROM (SELECT *, 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * EXP(-z * z) AS tail
  FROM (SELECT *, 1 / (1 + 0.3275911 * ABS(z)) AS t FROM (SELECT variant_id, sharpe / SQRT(252.0) * SQRT(CAST(n AS DOUBLE)) / SQRT(2.0) AS z FROM mt))))"""


def _variant_metrics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    ret = lines.groupBy(F.col("l_suppkey").alias("variant_id"), F.to_date("l_shipdate").alias("timestamp")).agg((F.avg("l_discount") - 0.05).alias("daily_return"))
    sharpe = F.try_divide(F.avg("daily_return") * F.sqrt(F.lit(252.0)), F.stddev_pop("daily_return"))
    return ret, ret.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n"), sharpe.alias("sharpe"), F.sum("daily_return").alias("total_return"))


@query(f"WITH {_CUST}, {_P} SELECT variant_id, ROUND(p_value, 6) AS p_value FROM pv")
def h16_sharpe_pvalue(spark, sf_dir):
    _, m = _variant_metrics(spark, sf_dir)
    return m.select("variant_id", F.round(statistics.sharpe_pvalue(F.col("sharpe"), F.col("n")), 6).alias("p_value"))


@query(
    f"""WITH {_CUST}, {_P}, r AS (SELECT variant_id, ROUND(p_value, 6) AS p_value FROM pv), k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p_value, variant_id) AS k, COUNT(*) OVER () AS m FROM r)
SELECT variant_id, p_value, COALESCE(k <= MAX(CASE WHEN p_value <= 0.6 * k / m THEN k END) OVER (), FALSE) AS rejected FROM k"""
)
def h17_bh_fdr(spark, sf_dir):
    return statistics.benjamini_hochberg(h16_sharpe_pvalue(spark, sf_dir), 0.6)


@query(
    f"""WITH {_CUST} SELECT variant_id, ARRAY_TO_STRING(LIST_FILTER([CASE WHEN NOT COALESCE(total_return > 0, FALSE) THEN 'return' END, CASE WHEN NOT COALESCE(sharpe >= 0.3, FALSE) THEN 'sharpe' END], lambda x: x IS NOT NULL), ',') AS failed,
  CASE WHEN COALESCE(total_return > 0 AND sharpe >= 0.3, FALSE) THEN 'pass' ELSE 'fail' END AS verdict FROM mt"""
)
def h15_promotion_gates(spark, sf_dir):
    _, m = _variant_metrics(spark, sf_dir)
    out = statistics.gates(m, (("return", "total_return", ">", 0.0), ("sharpe", "sharpe", ">=", 0.3)))
    return out.select("variant_id", F.array_join("failed", ",").alias("failed"), "verdict")


def held_suppliers(spark, sf_dir):
    """Daily returns of suppliers as variants, bought once at 10 bps, beside those of every tenth supplier."""
    ret, _ = _variant_metrics(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").where("l_suppkey % 10 = 0")
    s0 = lines.groupBy(F.to_date("l_shipdate").alias("timestamp")).agg((F.avg("l_discount") - 0.05).alias("benchmark_return"))
    first = ret.groupBy("variant_id").agg(F.min("timestamp").alias("_first"))
    rows = ret.join(first, "variant_id").withColumn("turnover", (F.col("timestamp") == F.col("_first")).cast("double")).drop("_first")
    return rows.withColumn("daily_return", F.col("daily_return") - F.col("turnover") * 0.001).join(s0, "timestamp", "left")


@query()
def h15_promotion_gates_all_eight(spark, sf_dir):
    """All eight gates; the SQL given for h15_promotion_gates has two. A variant is bought once, at 10 bps; S0 is the benchmark."""
    out = statistics.gates(statistics.promotion_metrics(held_suppliers(spark, sf_dir)), statistics.PROMOTION_GATES)
    return out.select("variant_id", F.array_join("failed", ",").alias("failed"), "verdict")


@query(
    f"""WITH {_CUST}, b AS (SELECT variant_id, MAX(timestamp) AS lt, MIN(timestamp) AS ft, QUANTILE_DISC(timestamp, 0.5) AS q FROM ret GROUP BY 1),
fm AS (SELECT variant_id, CASE WHEN timestamp < DATE '1996-01-01' THEN 'train' ELSE 'test' END AS fold, ROUND(AVG(daily_return) * SQRT(252.0) / NULLIF(STDDEV_POP(daily_return), 0), 6) AS sharpe FROM ret GROUP BY 1, 2),
g AS (SELECT variant_id, MAX(CASE WHEN fold = 'train' THEN sharpe END) AS train, MAX(CASE WHEN fold = 'test' THEN sharpe END) AS test FROM fm GROUP BY 1)
SELECT *, LEAST(train, test) AS robust, CAST(ROW_NUMBER() OVER (ORDER BY LEAST(train, test) DESC NULLS LAST, test DESC NULLS LAST, variant_id) AS INTEGER) AS place FROM g"""
)
def h05_robust_score(spark, sf_dir):
    ret, _ = _variant_metrics(spark, sf_dir)
    fold = F.when(F.col("timestamp") < F.lit("1996-01-01").cast("date"), "train").otherwise("test")
    sharpe = F.round(F.try_divide(F.avg("daily_return") * F.sqrt(F.lit(252.0)), F.stddev_pop("daily_return")), 6)
    return statistics.robust_score(ret.groupBy("variant_id", fold.alias("fold")).agg(sharpe.alias("sharpe")))


_MONTHLY = """mr AS (SELECT l_suppkey % 10 AS variant_id, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS timestamp, AVG(l_discount) - 0.05 AS daily_return FROM lineitem GROUP BY 1, 2),
my AS (SELECT *, CAST(EXTRACT(year FROM timestamp) AS INTEGER) AS y FROM mr),
fo AS (SELECT DISTINCT y AS year FROM my WHERE y - 3 >= (SELECT MIN(y) FROM my)),
tn AS (SELECT fo.year, my.*, EXP(SUM(LN(1 + daily_return)) OVER (PARTITION BY year, variant_id ORDER BY timestamp)) AS equity FROM my JOIN fo ON my.y BETWEEN fo.year - 3 AND fo.year - 1),
tq AS (SELECT *, equity / MAX(equity) OVER (PARTITION BY year, variant_id ORDER BY timestamp) - 1 AS dd FROM tn),
ob AS (SELECT year, variant_id, COALESCE(AVG(daily_return) * SQRT(252.0) / NULLIF(STDDEV_POP(daily_return), 0), 0) - 0.25 * ABS(MIN(dd)) AS objective FROM tq GROUP BY 1, 2),
wf AS (SELECT year, variant_id, objective FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY year ORDER BY ROUND(objective, 9) DESC, variant_id) AS k FROM ob) WHERE k = 1)"""


def _monthly(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy((F.col("l_suppkey") % 10).alias("variant_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("timestamp")).agg((F.avg("l_discount") - 0.05).alias("daily_return"))


@query(f"WITH {_MONTHLY} SELECT year, variant_id, ROUND(objective, 6) AS objective FROM wf")
def h07_walk_forward(spark, sf_dir):
    return _rounded(statistics.walk_forward(_monthly(spark, sf_dir)))


@query(f"WITH {_MONTHLY} SELECT my.timestamp, my.variant_id, ROUND(my.daily_return, 6) AS daily_return FROM my JOIN wf ON wf.year = my.y AND wf.variant_id = my.variant_id")
def h07_stitched_returns(spark, sf_dir):
    r = _monthly(spark, sf_dir)
    return _rounded(statistics.stitch(r, statistics.walk_forward(r)))


# ---- orders and accounts

_ORD = """od AS (SELECT o_custkey AS account, o_orderkey AS client_order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 50.0 AS quantity, 30.0 AS reference_price FROM orders),
fi AS (SELECT l_orderkey AS client_order_id, SUM(l_quantity) AS filled_quantity, ROUND(30.0 * (1 + AVG(l_tax) / 100), 6) AS filled_average_price FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1),
sf AS (SELECT od.*, COALESCE(fi.filled_quantity, 0) <= 0 AS missed, COALESCE(fi.filled_quantity / quantity, 0.0) AS fill_rate,
  CASE WHEN COALESCE(fi.filled_quantity, 0) > 0 THEN CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END * (filled_average_price - reference_price) / reference_price * 10000 END AS shortfall_bps FROM od LEFT JOIN fi USING (client_order_id))"""


def _shortfall(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("client_order_id"), F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(50.0).alias("quantity"), F.lit(30.0).alias("reference_price"))
    f = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("client_order_id")).agg(F.sum("l_quantity").alias("filled_quantity"), F.round(30.0 * (1 + F.avg("l_tax") / 100), 6).alias("filled_average_price"))
    return orders.implementation_shortfall(o, f)


@query(f"WITH {_ORD} SELECT client_order_id, side, missed, ROUND(fill_rate, 6) AS fill_rate, ROUND(shortfall_bps, 4) AS shortfall_bps FROM sf")
def j02_implementation_shortfall(spark, sf_dir):
    return _shortfall(spark, sf_dir).select("client_order_id", "side", "missed", F.round("fill_rate", 6).alias("fill_rate"), F.round("shortfall_bps", 4).alias("shortfall_bps"))


@query(
    f"""WITH {_ORD}, k AS (SELECT account, AVG(shortfall_bps) AS mean_bps FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY account ORDER BY client_order_id DESC) AS k FROM sf WHERE NOT missed) WHERE k <= 20 GROUP BY account)
SELECT a.account, ROUND(mean_bps, 6) AS mean_bps, COALESCE(mean_bps > 2.0, FALSE) AS active FROM (SELECT DISTINCT account FROM sf) a LEFT JOIN k USING (account)"""
)
def j03_kill_switch(spark, sf_dir):
    return _rounded(orders.kill_switch(_shortfall(spark, sf_dir)))


_ACC = """acc AS (SELECT c_custkey AS account, 20000 + c_acctbal AS equity, 5000.0 AS buying_power FROM customer),
px AS (SELECT 'P' || CAST(l_suppkey % 20 AS VARCHAR) AS symbol, ROUND(AVG(l_extendedprice / l_quantity) / 10, 2) AS price FROM lineitem GROUP BY 1),
pos AS (SELECT o_custkey AS account, 'P' || CAST(l_suppkey % 20 AS VARCHAR) AS symbol, SUM(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2),
tg AS (SELECT DISTINCT o_custkey AS account, 'P' || CAST(o_orderkey % 20 AS VARCHAR) AS symbol, 0.0987654321 AS target_weight FROM orders)"""


def _accounts(spark, sf_dir):
    c, o, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    acc = c.select(F.col("c_custkey").alias("account"), (20000 + F.col("c_acctbal")).alias("equity"), F.lit(5000.0).alias("buying_power"))
    symbol = F.concat(F.lit("P"), (F.col("l_suppkey") % 20).cast("string")).alias("symbol")
    px = lines.groupBy(symbol).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / 10, 2).alias("price"))
    pos = o.join(lines.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("account"), symbol).agg(F.sum("l_quantity").alias("quantity"))
    tg = o.select(F.col("o_custkey").alias("account"), F.concat(F.lit("P"), (F.col("o_orderkey") % 20).cast("string")).alias("symbol"), F.lit(0.0987654321).alias("target_weight")).distinct()
    return pos, tg, px, acc


@query(
    f"""WITH {_ACC}, b AS (SELECT account, symbol, px.price, equity, buying_power, COALESCE(target_weight, 0.0) AS tw, COALESCE(quantity, 0.0) AS q,
  COALESCE(target_weight, 0.0) * equity - COALESCE(quantity, 0.0) * price AS change FROM tg FULL JOIN pos USING (account, symbol) JOIN px USING (symbol) JOIN acc USING (account)),
f AS (SELECT *, CASE WHEN change > 0 THEN 'buy' ELSE 'sell' END AS side FROM b WHERE price > 0 AND change <> 0 AND (ABS(change) >= 10 OR (tw = 0 AND q <> 0))),
g AS (SELECT *, buying_power + SUM(CASE WHEN side = 'sell' THEN -change ELSE 0 END) OVER (PARTITION BY account) AS budget,
  COALESCE(SUM(CASE WHEN side = 'buy' THEN change ELSE 0 END) OVER (PARTITION BY account ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM f),
h AS (SELECT *, CASE WHEN side = 'buy' THEN LEAST(change, GREATEST(budget - earlier, 0)) ELSE -change END AS notional FROM g)
SELECT account, symbol, side, ROUND(notional, 2) AS notional, price AS reference_price FROM h WHERE side = 'sell' OR notional >= 10"""
)
def j01_rebalance_orders(spark, sf_dir):
    out = orders.rebalance_orders(*_accounts(spark, sf_dir))
    return out.select("account", "symbol", "side", F.round("notional", 2).alias("notional"), "reference_price")


@query(
    f"""WITH {_ACC}, r AS (SELECT account, symbol, COALESCE(target_weight, 0.0) AS target_weight, COALESCE(quantity, 0.0) * price / NULLIF(equity, 0) AS weight, COALESCE(quantity, 0.0) AS q
  FROM tg FULL JOIN pos USING (account, symbol) LEFT JOIN px USING (symbol) JOIN acc USING (account))
SELECT account, symbol, ROUND(target_weight, 6) AS target_weight, ROUND(weight, 6) AS weight, ROUND(weight - target_weight, 6) AS drift, CASE WHEN weight IS NULL THEN 'missing_price' WHEN target_weight = 0 AND q <> 0 THEN 'unexpected'
  WHEN ABS(weight - target_weight) > 0.02 THEN 'drift' ELSE 'ok' END AS status FROM r"""
)
def j04_reconcile(spark, sf_dir):
    return _rounded(orders.reconcile(*_accounts(spark, sf_dir)))


_EQ = "eq AS (SELECT l_suppkey AS account, CAST(l_shipdate AS DATE) AS timestamp, ROUND(1000 + SUM(l_quantity) * 3, 4) AS equity FROM lineitem GROUP BY 1, 2)"


def _equities(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("account"), F.to_date("l_shipdate").alias("timestamp")).agg(F.round(1000 + F.sum("l_quantity") * 3, 4).alias("equity"))


@query(
    f"""WITH {_EQ}, s AS (SELECT *, ROW_NUMBER() OVER w AS seq, equity / LAG(equity) OVER w - 1 AS ret, equity / MAX(equity) OVER w - 1 AS dd FROM eq WINDOW w AS (PARTITION BY account ORDER BY timestamp)),
g AS (SELECT account, ARG_MAX(dd, timestamp) AS drawdown, MAX(seq) - COALESCE(MAX(CASE WHEN COALESCE(ret, 0) >= 0 THEN seq END), 0) AS down_streak FROM s GROUP BY account)
SELECT account, ROUND(drawdown, 6) AS drawdown, down_streak, CASE WHEN drawdown <= -0.1 THEN 'halt' WHEN drawdown <= -0.05 OR down_streak >= 3 THEN 'warn' ELSE 'ok' END AS verdict FROM g"""
)
def j07_circuit_breaker(spark, sf_dir):
    return _rounded(orders.circuit_breaker(_equities(spark, sf_dir)))


@query(
    f"""WITH {_EQ} SELECT account, timestamp AS session, equity, ROUND(equity / LAG(equity) OVER w - 1, 6) AS daily_return, ROUND(equity / FIRST_VALUE(equity) OVER w - 1, 6) AS cumulative_return
FROM eq WINDOW w AS (PARTITION BY account ORDER BY timestamp)"""
)
def a17_performance_ledger(spark, sf_dir):
    e = _equities(spark, sf_dir).withColumnRenamed("timestamp", "session")
    twice = e.withColumn("taken_at", F.lit(2)).unionByName(e.withColumn("equity", F.col("equity") - 1).withColumn("taken_at", F.lit(1)))
    return _rounded(orders.performance_ledger(twice)).drop("taken_at")


# ---- lineage

_EV = """ev AS (SELECT user_id AS candidate, ts AS seen_at, CASE event_type WHEN 'view' THEN 'quarantine' WHEN 'click' THEN 'shadow' WHEN 'purchase' THEN 'paper' ELSE 'rejected' END AS state, event_id FROM events)"""


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "view", "quarantine").when(F.col("event_type") == "click", "shadow").when(F.col("event_type") == "purchase", "paper").otherwise("rejected")
    return e.select(F.col("user_id").alias("candidate"), F.col("ts").alias("seen_at"), state.alias("state"), "event_id")


@query(
    f"""WITH {_EV}, t AS (SELECT candidate, event_id, LAG(state) OVER (PARTITION BY candidate ORDER BY seen_at, event_id) AS "from", state AS "to" FROM ev)
SELECT candidate, event_id, "from", "to" FROM t WHERE "from" IS NOT NULL AND NOT (("from" = 'quarantine' AND "to" IN ('shadow', 'rejected')) OR ("from" = 'shadow' AND "to" IN ('paper', 'rejected')) OR ("from" = 'paper' AND "to" = 'rejected'))"""
)
def l02_transition_audit(spark, sf_dir):
    return lineage.illegal_transitions(_events(spark, sf_dir)).select("candidate", "event_id", "from", "to")


@query(f"WITH {_EV} SELECT candidate, ARG_MAX(state, STRUCT_PACK(a := seen_at, b := event_id)) AS state FROM ev GROUP BY candidate")
def l03_current_state(spark, sf_dir):
    return lineage.current_state(_events(spark, sf_dir))


@query(
    """WITH a AS (SELECT l_orderkey AS run, l_linenumber AS key, SUM(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2), b AS (SELECT l_orderkey AS run, l_linenumber AS key, SUM(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT run, key, CAST(CAST(a.v AS BIGINT) AS VARCHAR) AS "left", CAST(CAST(b.v AS BIGINT) AS VARCHAR) AS "right" FROM a FULL JOIN b USING (run, key) WHERE a.v IS DISTINCT FROM b.v AND key <> 7"""
)
def l04_compare_manifests(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    side = lambda cond: lines.where(cond).groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("key")).agg(F.sum("l_quantity").cast("long").cast("string").alias("value"))
    return lineage.compare_manifests(side("l_returnflag <> 'R'"), side("l_returnflag <> 'N'"), volatile=(7,))


@query("SELECT s_suppkey, LEFT(sha256('{\"name\":\"' || s_name || '\",\"nation\":' || CAST(s_nationkey AS VARCHAR) || '}'), 16) AS fingerprint FROM supplier")
def l05_config_fingerprint(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", lineage.fingerprint({"nation": F.col("s_nationkey"), "name": F.col("s_name")}).alias("fingerprint"))


