"""Queries of guarded orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.functions.factors import rounded
from barlake.operators import order_plan

from .registry import query, table

_PLAN = """acc AS (SELECT c_custkey AS account, CASE WHEN c_custkey % 97 = 5 THEN 0.0 WHEN c_custkey % 29 = 4 THEN 1500.0 ELSE 20000 + c_acctbal END AS equity,
  (20000 + c_acctbal) * CASE WHEN c_custkey % 13 = 0 THEN 1.05 ELSE 0.99 END AS last_equity, 300.0 + 250.0 * (c_custkey % 7) AS cash, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE 900.0 END AS buying_power,
  c_custkey % 5 <> 0 AS shorting_enabled, c_custkey % 11 <> 0 AS allow_short, 500.0 * (c_custkey % 4) AS unmanaged_notional FROM customer),
px AS (SELECT 'P' || CAST(l_suppkey % 20 AS VARCHAR) AS symbol, ROUND(AVG(l_extendedprice / l_quantity) / 10, 2) AS price FROM lineitem WHERE l_suppkey % 20 <> 7 GROUP BY 1),
pos AS (SELECT account, symbol, SUM(q) AS quantity FROM (SELECT o_custkey AS account, 'P' || CAST(l_suppkey % 20 AS VARCHAR) AS symbol, l_quantity * CASE WHEN (o_custkey + l_suppkey % 20) % 4 = 0 THEN -1 ELSE 1 END AS q
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R') GROUP BY 1, 2),
tg AS (SELECT o_custkey AS account, 'P' || CAST(o_orderkey % 20 AS VARCHAR) AS symbol, MAX((o_orderkey * 7) % 11 - 3) * 0.0123456789 AS target_weight FROM orders GROUP BY 1, 2),
oo AS (SELECT DISTINCT o_custkey AS account, 'P' || CAST(o_orderkey % 20 AS VARCHAR) AS symbol FROM orders WHERE o_orderkey % 37 = 0),
names AS (SELECT 'P' || CAST(range AS VARCHAR) AS symbol, range % 3 <> 0 AS shortable, range % 4 <> 1 AS easy_to_borrow FROM range(20)),
lim AS (SELECT * FROM (VALUES ('P3', 0.02, NULL, NULL), ('P4', NULL, 400.0, NULL), ('P5', NULL, NULL, 0.01)) t(symbol, max_weight, max_notional, max_share))"""

_PLAN_SQL = f"""WITH RECURSIVE {_PLAN},
refused AS (SELECT DISTINCT account FROM tg JOIN acc USING (account) WHERE target_weight < 0 AND NOT allow_short),
w0 AS (SELECT account, symbol, equity, last_equity, unmanaged_notional, GREATEST(LEAST(CASE WHEN allow_short THEN target_weight ELSE GREATEST(target_weight, 0) END, COALESCE(max_weight, 0.05)), -COALESCE(max_weight, 0.05)) AS w
  FROM tg JOIN acc USING (account) LEFT JOIN lim USING (symbol)),
w1 AS (SELECT *, SUM(ABS(w)) OVER (PARTITION BY account) AS gross, GREATEST(LEAST(0.2 - CASE WHEN equity <> 0 THEN unmanaged_notional / equity END - 0.02, 0.2), 0) AS room FROM w0),
w2 AS (SELECT account, symbol, CASE WHEN last_equity > 0 AND equity / last_equity - 1 <= -0.03 THEN 0 WHEN gross > room AND gross > 0 THEN w * room / gross ELSE w END AS target_weight FROM w1),
a AS (SELECT account, symbol, COALESCE(target_weight, 0) AS weight, COALESCE(quantity, 0) AS q, acc.*, price, shortable, easy_to_borrow, max_notional, max_share, refused.account IS NOT NULL AS refused, oo.account IS NOT NULL AS waiting,
  last_equity > 0 AND equity / last_equity - 1 <= -0.03 AS lost FROM w2 FULL JOIN pos USING (account, symbol) JOIN acc USING (account) LEFT JOIN refused USING (account) LEFT JOIN px USING (symbol) LEFT JOIN names USING (symbol) LEFT JOIN lim USING (symbol)
  LEFT JOIN oo USING (account, symbol)),
b AS (SELECT *, CASE WHEN weight * equity / price < 0 THEN -FLOOR(-(weight * equity / price)) ELSE weight * equity / price END AS d0 FROM a),
c AS (SELECT *, COALESCE(q * d0 < 0, FALSE) AS turning, CASE WHEN q * d0 < 0 THEN 0 ELSE d0 END AS d1 FROM b),
d AS (SELECT *, COALESCE(d1 < LEAST(q, 0) AND NOT (shorting_enabled AND equity >= 2000 AND shortable AND easy_to_borrow), FALSE) AS gated FROM c),
e AS (SELECT *, CASE WHEN gated THEN q ELSE d1 END AS des FROM d),
f AS (SELECT *, des - q AS delta, ABS(des) < ABS(q) AND q * des >= 0 AS reducing, CASE WHEN des - q > 0 THEN 'buy' ELSE 'sell' END AS side, GREATEST(50.0, 0.002 * equity) AS minimum FROM e),
g AS (SELECT *, reducing AND ABS(des) < 1e-12 AS exits, price * (1 + CASE WHEN side = 'buy' THEN 1.0 ELSE -1.0 END * 5.0 / 10000) AS raw,
  CASE WHEN turning THEN 'flatten_before_reverse' WHEN lost THEN 'daily_loss_exit' WHEN q < 0 AND delta > 0 THEN 'cover_short' WHEN des < q AND des < 0 THEN 'open_short' WHEN q > 0 AND delta < 0 THEN 'close_long' ELSE 'open_long' END AS purpose FROM f),
h AS (SELECT *, CASE WHEN exits THEN NULL WHEN raw >= 1 THEN ROUND(raw, 2) ELSE ROUND(raw, 4) END AS limit_price FROM g),
i AS (SELECT *, COALESCE(limit_price, price) AS op, CASE WHEN COALESCE(max_share, 0.05) * equity < COALESCE(max_notional, 1500.0) THEN COALESCE(max_share, 0.05) * equity ELSE COALESCE(max_notional, 1500.0) END AS most, q < 0 OR des < 0 AS whole FROM h),
j AS (SELECT *, CASE WHEN whole THEN FLOOR(ABS(delta)) ELSE ABS(delta) END AS s0 FROM i),
k AS (SELECT *, CASE WHEN reducing THEN s0 ELSE LEAST(s0, most / op) END AS s1 FROM j),
l AS (SELECT *, CASE WHEN whole THEN FLOOR(s1) ELSE FLOOR(s1 * 1000000) / 1000000 END AS size FROM k),
m AS (SELECT *, CASE WHEN equity <= 0 THEN 'no_equity' WHEN refused THEN 'short_targets_refused' WHEN waiting THEN 'open_order' WHEN price IS NULL THEN 'no_price' WHEN gated THEN 'not_borrowable' WHEN ABS(delta) < 1e-12 THEN 'at_target'
  WHEN ABS(delta * price) < minimum AND NOT exits THEN 'below_minimum' WHEN size <= 0 THEN 'no_whole_share' END AS stopped FROM l),
n AS (SELECT *, GREATEST(CASE WHEN allow_short AND buying_power > 0 THEN buying_power ELSE cash END, 0) * 0.98 + SUM(CASE WHEN stopped IS NULL AND side = 'sell' AND purpose <> 'open_short' THEN size * op ELSE 0 END) OVER (PARTITION BY account) AS budget,
  purpose IN ('cover_short', 'daily_loss_exit', 'flatten_before_reverse') AS exempt FROM m),
bu AS (SELECT account, symbol, size, op, minimum, exempt, budget, ROW_NUMBER() OVER (PARTITION BY account ORDER BY symbol) AS k FROM n WHERE stopped IS NULL AND side = 'buy'),
fold AS (SELECT account, CAST(NULL AS VARCHAR) AS symbol, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS got, CAST(MIN(budget) AS DOUBLE) AS rest FROM bu GROUP BY account
  UNION ALL SELECT y.account, y.symbol, y.k, y.got, CASE WHEN y.exempt THEN GREATEST(y.rest - y.size * y.op, 0) ELSE y.rest - y.got * y.op END FROM (
    SELECT bu.*, fold.rest, CASE WHEN exempt THEN size WHEN LEAST(size * op, fold.rest) < minimum OR FLOOR(LEAST(size * op, fold.rest) / op * 1000000) <= 0 THEN 0 ELSE FLOOR(LEAST(size * op, fold.rest) / op * 1000000) / 1000000 END AS got
    FROM fold JOIN bu ON bu.account = fold.account AND bu.k = fold.k + 1) y),
o AS (SELECT n.*, CASE WHEN side = 'sell' THEN size ELSE got END AS qty, COALESCE(stopped, CASE WHEN side = 'buy' AND NOT exempt AND got <= 0 THEN 'no_budget' ELSE purpose END) AS reason FROM n LEFT JOIN fold ON fold.account = n.account AND fold.symbol = n.symbol)
SELECT account, symbol, stopped IS NULL AND reason <> 'no_budget' AS sent, reason, ROUND(weight, 6) AS target_weight, price AS reference_price, CASE WHEN sent THEN side END AS side, CASE WHEN sent THEN ROUND(qty, 4) END AS quantity,
  CASE WHEN sent THEN ROUND(qty * op, 2) END AS notional, CASE WHEN sent THEN limit_price END AS limit_price, CASE WHEN sent THEN 'plan-202407011530-momentum-' || symbol || '-' || LEFT(side, 1) END AS client_order_id FROM o"""


@query(_PLAN_SQL)
def j01_guarded_order_plan(spark, sf_dir):
    """All accounts planned under all safety rules; every reason for an order and for none occurs."""
    c, o, lines = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    key = F.col("c_custkey")
    accounts = c.select(
        key.alias("account"), F.lit("2024-07-01 15:30:00").cast("timestamp").alias("as_of"), F.when(key % 97 == 5, 0.0).when(key % 29 == 4, 1500.0).otherwise(20000 + F.col("c_acctbal")).alias("equity"),
        ((20000 + F.col("c_acctbal")) * F.when(key % 13 == 0, 1.05).otherwise(0.99)).alias("last_equity"), (300.0 + 250.0 * (key % 7)).alias("cash"), F.when(key % 3 == 0, 0.0).otherwise(900.0).alias("buying_power"),
        (key % 5 != 0).alias("shorting_enabled"), (key % 11 != 0).alias("allow_short"), (500.0 * (key % 4)).alias("unmanaged_notional"),
    )
    number = F.col("l_suppkey") % 20
    symbol = F.concat(F.lit("P"), number.cast("string")).alias("symbol")
    prices = lines.where(number != 7).groupBy(symbol).agg(rounded(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / 10, 2).alias("price"))
    held = o.join(lines.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"))
    signed = F.col("l_quantity") * F.when((F.col("o_custkey") + number) % 4 == 0, -1).otherwise(1)
    positions = held.groupBy(F.col("o_custkey").alias("account"), symbol).agg(F.sum(signed).alias("quantity"))
    own = [F.col("o_custkey").alias("account"), F.concat(F.lit("P"), (F.col("o_orderkey") % 20).cast("string")).alias("symbol")]
    targets = o.groupBy(*own).agg((F.max((F.col("o_orderkey") * 7) % 11 - 3) * 0.0123456789).alias("target_weight"))
    waiting = o.where("o_orderkey % 37 = 0").select(*own).distinct()
    names = spark.range(20).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("symbol"), (F.col("id") % 3 != 0).alias("shortable"), (F.col("id") % 4 != 1).alias("easy_to_borrow"))
    limits = spark.createDataFrame([("P3", 0.02, None, None), ("P4", None, 400.0, None), ("P5", None, None, 0.01)], "symbol string, max_weight double, max_notional double, max_share double")
    policy = order_plan.Policy("plan", "momentum", 0.05, 0.2, 0.03, 50.0, 0.002, 1500.0, 0.05, 0.02, 5.0, True, True)
    plan = order_plan.order_plan(targets, positions, prices, accounts, waiting, names, limits, policy)
    return plan.withColumns({"target_weight": rounded("target_weight", 6), "quantity": rounded("quantity", 4), "notional": rounded("notional", 2)})
