"""Queries of the small table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import orders, tables
from barlake.operators import evaluate as V

from .registry import bars, panel_of, query, table, with_bars, with_panel
from .strategy_queries import _EVAL, _METRICS, _portfolio, _rounded
from .table_queries import _ACC, _accounts

_S = "PARTITION BY symbol ORDER BY timestamp"


@query(
    """WITH g AS (SELECT event_type AS symbol, CAST(EXTRACT(epoch FROM date_trunc('second', ts)) - EXTRACT(epoch FROM date_trunc('second', LAG(ts) OVER (PARTITION BY event_type ORDER BY ts))) AS BIGINT) // 60 AS minutes FROM events),
c AS (SELECT symbol, minutes, COUNT(*) AS n FROM g WHERE minutes BETWEEN 1 AND 60 GROUP BY 1, 2)
SELECT symbol, minutes FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY n DESC, minutes) AS k FROM c) WHERE k = 1"""
)
def b04_bar_interval(spark, sf_dir):
    return tables.bar_interval(table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp")))


@query(with_bars('SELECT MAX(a) AS "start", MIN(b) AS "end" FROM (SELECT symbol, MIN(timestamp) AS a, MAX(timestamp) AS b FROM bars GROUP BY symbol)'))
def b11_common_window(spark, sf_dir):
    return tables.common_window(bars(spark, sf_dir))


@query(
    with_bars(
        "SELECT symbol, n, CAST(place AS INTEGER) AS place FROM (SELECT symbol, n, ROW_NUMBER() OVER (ORDER BY n DESC, symbol) AS place FROM (SELECT symbol, COUNT(*) AS n FROM bars WHERE symbol IN (SELECT 'S' || CAST(s_suppkey % 7 AS VARCHAR) FROM supplier) GROUP BY symbol)) WHERE place <= 5"
    )
)
def f12_priority_universe(spark, sf_dir):
    preferred = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), (F.col("s_suppkey") % 7).cast("string")).alias("symbol"))
    return tables.priority_universe(bars(spark, sf_dir), preferred, 5)


@query(
    with_panel(
        f"SELECT timestamp, symbol, ROUND(last * 0.9, 6) AS exit_price FROM (SELECT *, MAX(CASE WHEN close IS NOT NULL THEN seq END) OVER (PARTITION BY symbol ORDER BY seq) AS seen, LAST_VALUE(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq) AS last FROM q) WHERE close IS NULL AND seq - seen = 2",
        extra=f"q AS (SELECT timestamp, symbol, close, ROW_NUMBER() OVER ({_S}) AS seq FROM p)",
    )
)
def g07_missing_price_exits(spark, sf_dir):
    return _rounded(tables.missing_price_exits(panel_of(spark, sf_dir), 2, 0.1))


@query(
    """SELECT CAST(l_shipdate AS DATE) AS session, CAST(l_suppkey AS VARCHAR) AS symbol, ROUND(SUM(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE -l_extendedprice END - l_tax), 2) AS pnl, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS gross FROM lineitem GROUP BY 1, 2"""
)
def g09_position_pnl(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session"), F.col("l_suppkey").cast("string").alias("symbol"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_extendedprice").alias("notional"), F.col("l_tax").alias("fees"))
    return tables.position_pnl(t).withColumn("pnl", F.round("pnl", 2)).withColumn("gross", F.round("gross", 2))


@query(
    with_panel(
        """SELECT COUNT(*) AS n, ROUND(SUM(a.daily_return + b.r), 6) AS total, ROUND(AVG(CASE WHEN a.daily_return <> 0 THEN 1.0 ELSE 0.0 END), 6) AS left_active, ROUND(AVG(CASE WHEN b.r <> 0 THEN 1.0 ELSE 0.0 END), 6) AS right_active,
  ROUND(AVG(CASE WHEN a.daily_return <> 0 AND b.r <> 0 THEN 1.0 ELSE 0.0 END), 6) AS both_active FROM port a JOIN (SELECT timestamp, r FROM p WHERE symbol = 'S1') b ON a.timestamp = b.timestamp""",
        "weekly10",
        _EVAL,
    )
)
def g10_combine_streams(spark, sf_dir):
    other = panel_of(spark, sf_dir, "weekly10").where("symbol = 'S1'").select("timestamp", F.col("r").alias("daily_return"))
    return _rounded(tables.combine_streams(_portfolio(spark, sf_dir), other))


@query(with_panel(f"SELECT year, ROUND(sharpe + cagr + 0.5 * max_drawdown - 0.01 * annual_turnover, 4) AS objective FROM (SELECT CAST(EXTRACT(year FROM timestamp) AS INTEGER) AS year, {_METRICS} FROM dd GROUP BY 1)", "weekly10", _EVAL))
def h08_declared_objective(spark, sf_dir):
    m = _rounded(V.metrics(V.equity_curve(_portfolio(spark, sf_dir)).withColumn("year", F.year("timestamp")), ("year",)))
    return tables.declared_objective(m).select("year", F.round("objective", 4).alias("objective"))


@query(with_panel("SELECT CAST(EXTRACT(year FROM timestamp) AS INTEGER) AS year, ROUND(EXP(SUM(LN(1 + daily_return))) - 1, 6) AS total_return FROM port GROUP BY 1", "weekly10", _EVAL))
def h09_calendar_returns(spark, sf_dir):
    return _portfolio(spark, sf_dir).groupBy(F.year("timestamp").alias("year")).agg(F.round(F.exp(F.sum(F.log1p("daily_return"))) - 1, 6).alias("total_return"))


@query(
    """WITH x AS (SELECT l_suppkey AS variant_id, l_orderkey AS position, ROUND(SUM(l_extendedprice * (l_discount - 0.0456789)), 4) AS pnl FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY variant_id ORDER BY pnl DESC, position) AS k FROM x),
g AS (SELECT variant_id, COUNT(*) AS n, AVG(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, SUM(pnl) AS total, SUM(CASE WHEN k = 1 THEN pnl END) AS t1, SUM(CASE WHEN k <= 3 THEN pnl END) AS t3, SKEWNESS(pnl) AS skew FROM k GROUP BY 1)
SELECT variant_id, n, ROUND(win_rate, 6) AS win_rate, ROUND(total, 3) AS total, ROUND(t1 / NULLIF(total, 0), 6) AS top1_share, ROUND(t3 / NULLIF(total, 0), 6) AS top3_share, ROUND(total - t1, 3) AS without_best, ROUND(skew, 6) AS skew FROM g"""
)
def h13_position_diagnostics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    x = lines.groupBy(F.col("l_suppkey").alias("variant_id"), F.col("l_orderkey").alias("position")).agg(F.round(F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.0456789)), 4).alias("pnl"))
    out = tables.position_diagnostics(x)
    return out.select("variant_id", "n", *[F.round(c, 3 if c in ("total", "without_best") else 6).alias(c) for c in out.columns[2:]])


@query(
    """SELECT o_orderkey, 'C' || CAST(o_custkey % 10 AS VARCHAR) AS symbol FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 60 MINUTE AND o_custkey % 10 IN (SELECT DISTINCT s_suppkey % 4 FROM supplier)"""
)
def j08_stale_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("C"), (F.col("o_custkey") % 10).cast("string")).alias("symbol"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), F.col("o_orderdate").alias("submitted_at"))
    managed = table(spark, sf_dir, "supplier").select(F.concat(F.lit("C"), (F.col("s_suppkey") % 4).cast("string")).alias("symbol"))
    return tables.stale_orders(o, F.lit("1998-01-01 00:00:00").cast("timestamp"), 60, managed).select("o_orderkey", "symbol")


@query(
    f"""WITH {_ACC} SELECT account, ROUND(COALESCE(SUM(CASE WHEN symbol IN ('P1', 'P2', 'P3') THEN ABS(quantity * price) END), 0.0), 2) AS managed, ROUND(COALESCE(SUM(CASE WHEN symbol NOT IN ('P1', 'P2', 'P3') THEN ABS(quantity * price) END), 0.0), 2) AS unmanaged FROM pos JOIN px USING (symbol) GROUP BY account"""
)
def j09_managed_split(spark, sf_dir):
    pos, _, px, _ = _accounts(spark, sf_dir)
    managed = px.where("symbol in ('P1', 'P2', 'P3')")
    out = tables.managed_split(pos.join(px, "symbol"), managed)
    return out.withColumn("managed", F.round("managed", 2)).withColumn("unmanaged", F.round("unmanaged", 2))


@query(
    f"""WITH {_ACC}, r AS (SELECT account, symbol, COALESCE(target_weight, 0.0) AS tw, COALESCE(quantity, 0.0) * price / NULLIF(equity, 0) AS weight, COALESCE(quantity, 0.0) AS q FROM tg FULL JOIN pos USING (account, symbol) LEFT JOIN px USING (symbol) JOIN acc USING (account)),
s AS (SELECT *, CASE WHEN weight IS NULL THEN 'missing_price' WHEN tw = 0 AND q <> 0 THEN 'unexpected' WHEN ABS(weight - tw) > 0.02 THEN 'drift' ELSE 'ok' END AS status FROM r)
SELECT account, COUNT(*) AS names, ROUND(SUM(ABS(weight)), 6) AS gross, COUNT(CASE WHEN ABS(weight - tw) >= 0.05 THEN 1 END) AS out_of_band, COUNT(CASE WHEN status = 'ok' THEN 1 END) AS ok, COUNT(CASE WHEN status = 'drift' THEN 1 END) AS drift,
  COUNT(CASE WHEN status = 'unexpected' THEN 1 END) AS unexpected, COUNT(CASE WHEN status = 'missing_price' THEN 1 END) AS missing_price FROM s GROUP BY account"""
)
def j05_close_summary(spark, sf_dir):
    return _rounded(tables.close_summary(orders.reconcile(*_accounts(spark, sf_dir)), 0.05))


def _last_rebalance(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("account")).agg(F.max(F.to_date("o_orderdate")).alias("last_rebalance"))


@query(
    """WITH s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem WHERE l_shipdate >= DATE '1998-06-01'), l AS (SELECT c_custkey AS account, MAX(CAST(o_orderdate AS DATE)) AS last_rebalance FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT account, COUNT(session) AS sessions_since, MAX(last_rebalance) IS NULL OR COUNT(session) >= 120 AS due FROM l LEFT JOIN s ON session > last_rebalance GROUP BY account"""
)
def j06_rebalance_due(spark, sf_dir):
    sessions = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).where("session >= date'1998-06-01'").distinct()
    return tables.rebalance_due(sessions, _last_rebalance(spark, sf_dir), 120)


@query(
    """WITH s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem), l AS (SELECT c_custkey AS account, MAX(CAST(o_orderdate AS DATE)) AS last_rebalance FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT account, COUNT(session) AS sessions_since, MAX(last_rebalance) IS NULL OR COUNT(session) >= 120 AS due FROM l LEFT JOIN s ON session > last_rebalance GROUP BY account"""
)
def j06_rebalance_due_all_sessions(spark, sf_dir):
    """j06_rebalance_due over every session; the SQL given for that one counts those from 1998-06-01 on."""
    sessions = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session"))
    return tables.rebalance_due(sessions, _last_rebalance(spark, sf_dir), 120)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown:code_x,missing:lookback,forbidden:code_x,lookback' WHEN o_orderkey % 5 = 1 THEN 'version' WHEN o_orderkey % 5 = 2 THEN 'lookback,sign' ELSE '' END AS errors, o_orderkey % 5 > 2 AS ok FROM orders"""
)
def l01_check_bundles(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    body = F.concat(F.lit('{"candidate_id":"'), F.col("o_orderkey").cast("string"), F.lit('","expression":"close","schema_version":'), F.when(k == 1, "2").otherwise("1"), F.lit(',"expected_sign":'), F.when(k == 2, "3").otherwise("-1"))
    body = F.concat(body, F.when(k == 0, ',"code_x":1}').when(k == 2, ',"lookback":0}').otherwise(',"lookback":20}'))
    out = tables.check_bundles(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("json")))
    return out.select("o_orderkey", F.array_join("errors", ",").alias("errors"), "ok")
