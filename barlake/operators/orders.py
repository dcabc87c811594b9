"""Orders, fills, positions and accounts, for many accounts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rebalance_orders(positions: DataFrame, targets: DataFrame, prices: DataFrame, accounts: DataFrame, min_notional: float = 10.0) -> DataFrame:
    """Orders that bring each account to its targets: sells first, then buys in symbol order while the budget lasts.

    accounts: (account, equity, buying_power); targets: (account, symbol, target_weight); positions: (account, symbol,
    quantity); prices: (symbol, price). Names without a price are skipped; changes under min_notional too, except full
    exits. The budget is buying power plus sells; a buy gets what earlier buys leave of it, and is dropped if that is
    under the minimum.
    """
    both = targets.join(positions, ["account", "symbol"], "full_outer").join(prices, "symbol").join(accounts, "account")
    target = F.coalesce("target_weight", F.lit(0.0)) * F.col("equity")
    rows = both.withColumn("change", target - F.coalesce("quantity", F.lit(0.0)) * F.col("price"))
    leaving = (F.coalesce("target_weight", F.lit(0.0)) == 0) & (F.coalesce("quantity", F.lit(0.0)) != 0)
    rows = rows.where((F.col("price") > 0) & (F.col("change") != 0) & ((F.abs("change") >= min_notional) | leaving))
    rows = rows.withColumn("side", F.when(F.col("change") > 0, "buy").otherwise("sell"))
    account = Window.partitionBy("account")
    budget = F.col("buying_power") + F.sum(F.when(F.col("side") == "sell", -F.col("change")).otherwise(0.0)).over(account)
    buys = F.when(F.col("side") == "buy", F.col("change")).otherwise(0.0)
    before = F.coalesce(F.sum(buys).over(account.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    room = F.greatest(budget - before, F.lit(0.0))
    notional = F.when(F.col("side") == "buy", F.least(F.col("change"), room)).otherwise(-F.col("change"))
    rows = rows.withColumn("notional", notional).where((F.col("side") == "sell") | (F.col("notional") >= min_notional))
    quantity = F.floor(F.col("notional") / F.col("price") * 1000000) / 1000000
    return rows.select("account", "symbol", "side", "notional", quantity.alias("quantity"), F.col("price").alias("reference_price"))


def implementation_shortfall(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """orders with fill rate and shortfall in bps (positive is a cost); an order without a fill is missed.

    fills: (client_order_id, filled_quantity, filled_average_price).
    """
    rows = orders.join(fills, "client_order_id", "left")
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    bps = sign * F.try_divide(F.col("filled_average_price") - F.col("reference_price"), F.col("reference_price")) * 10000
    rate = F.coalesce(F.try_divide("filled_quantity", "quantity"), F.lit(0.0))
    return rows.withColumn("fill_rate", rate).withColumn("missed", F.coalesce(F.col("filled_quantity"), F.lit(0.0)) <= 0).withColumn("shortfall_bps", F.when(~F.col("missed"), bps))


def latest_fills(fills: DataFrame, order: str = "seen_at") -> DataFrame:
    """One row for each client_order_id: the last report by order; of several, the one with most filled."""
    by = Window.partitionBy("client_order_id").orderBy(F.col(order).desc(), F.col("filled_quantity").desc())
    return fills.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def kill_switch(shortfalls: DataFrame, last: int = 20, limit_bps: float = 2.0, key: str = "account", order: str = "client_order_id") -> DataFrame:
    """For each account the mean shortfall of its last fills and whether that trips the switch; no fills, no trip."""
    filled = shortfalls.where("not missed").withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where(F.col("_k") <= last)
    means = filled.groupBy(key).agg(F.avg("shortfall_bps").alias("mean_bps"))
    return shortfalls.select(key).distinct().join(means, key, "left").withColumn("active", F.coalesce(F.col("mean_bps") > limit_bps, F.lit(False)))


def reconcile(positions: DataFrame, targets: DataFrame, prices: DataFrame, accounts: DataFrame, band: float = 0.02) -> DataFrame:
    """Actual against target weight of each name: drift and a status."""
    rows = targets.join(positions, ["account", "symbol"], "full_outer").join(prices, "symbol", "left").join(accounts, "account")
    want = F.coalesce("target_weight", F.lit(0.0))
    have = F.try_divide(F.coalesce("quantity", F.lit(0.0)) * F.col("price"), F.col("equity"))
    rows = rows.select("account", "symbol", want.alias("target_weight"), have.alias("weight"), (have - want).alias("drift"), F.col("quantity"))
    status = (
        F.when(F.col("weight").isNull(), "missing_price")
        .when((F.col("target_weight") == 0) & (F.coalesce("quantity", F.lit(0.0)) != 0), "unexpected")
        .when(F.abs("drift") > band, "drift")
        .otherwise("ok")
    )
    return rows.withColumn("status", status).drop("quantity")


def circuit_breaker(equity: DataFrame, key: str = "account", warn: float = -0.05, halt: float = -0.10, streak: int = 3, daily_limit: float | None = None) -> DataFrame:
    """The latest state of each account: drawdown, length of the trailing run of losses and a verdict.

    With a daily limit, a last return of as much below zero halts too.
    """
    w = Window.partitionBy(key).orderBy("timestamp")
    rows = equity.withColumn("seq", F.row_number().over(w)).withColumn("ret", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1)
    rows = rows.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)
    g = rows.groupBy(key).agg(
        F.max_by("drawdown", "timestamp").alias("drawdown"), F.max("seq").alias("_n"),
        F.coalesce(F.max(F.when(F.coalesce("ret", F.lit(0.0)) >= 0, F.col("seq"))), F.lit(0)).alias("_good"), F.max_by(F.coalesce("ret", F.lit(0.0)), "timestamp").alias("_today"),
    )
    lost = F.col("_today") <= -abs(daily_limit) if daily_limit is not None else F.lit(False)
    down = (F.col("_n") - F.col("_good")).cast("long")
    verdict = F.when((F.col("drawdown") <= halt) | lost, "halt").when((F.col("drawdown") <= warn) | (down >= streak), "warn").otherwise("ok")
    return g.select(key, "drawdown", down.alias("down_streak"), verdict.alias("verdict"))


def performance_ledger(snapshots: DataFrame, key: str = "account") -> DataFrame:
    """One row for each session, the latest snapshot winning, with daily and cumulative return."""
    by = Window.partitionBy(key, "session").orderBy(F.col("taken_at").desc())
    rows = snapshots.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")
    w = Window.partitionBy(key).orderBy("session")
    return rows.withColumn("daily_return", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1).withColumn("cumulative_return", F.try_divide(F.col("equity"), F.first("equity").over(w)) - 1)
