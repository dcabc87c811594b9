"""Rebalancing orders under safety rules: every name of every account gets an order, or the reason why none is sent.

The rules stand in a cascade; the first that a name meets decides. What a buy may spend depends on the buys before it,
so the buys of an account are folded in symbol order; all other rules are columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlake.functions.factors import rounded

#: Shares and cash below this are none.
TINY = 1e-12
#: An account needs this equity to sell short.
SHORT_EQUITY = 2000.0


@dataclass(frozen=True)
class Policy:
    """Limits of all accounts; limits of single names come with the plan's table of limits."""

    prefix: str = "plan"
    strategy: str = "strategy"
    max_position_weight: float = 0.1
    max_gross_exposure: float = 1.0
    max_daily_loss: float = 0.03
    min_trade_notional: float = 10.0
    min_trade_share: float = 0.0
    max_order_notional: float = 10000.0
    max_order_share: float | None = None
    cash_buffer: float = 0.0
    limit_offset_bps: float | None = None
    market_exits: bool = False
    require_easy_to_borrow: bool = True


def _first(*cases: tuple[Column, object]) -> Column:
    found = F
    for when, value in cases:
        found = found.when(when, value)
    return found


def _floor6(x: Column) -> Column:
    return F.floor(x * 1000000) / 1000000


def safe_targets(targets: DataFrame, accounts: DataFrame, limits: DataFrame, policy: Policy) -> DataFrame:
    """(account, symbol, target_weight): held to each name's limit, and all of an account scaled to its gross exposure.

    What the account holds outside the plan and the cash buffer count against the exposure; after a loss of the day at
    the limit all targets are zero. Without leave to sell short, weights below zero are zero.
    """
    rows = targets.join(accounts, "account").join(F.broadcast(limits), "symbol", "left")  # limits: a row for a name
    cap = F.coalesce("max_weight", F.lit(policy.max_position_weight))
    weight = F.when(F.col("allow_short"), F.col("target_weight")).otherwise(F.greatest("target_weight", F.lit(0.0)))
    rows = rows.withColumn("w", F.greatest(F.least(weight, cap), -cap))
    room = F.greatest(F.least(policy.max_gross_exposure - F.try_divide("unmanaged_notional", "equity") - policy.cash_buffer, F.lit(policy.max_gross_exposure)), F.lit(0.0))
    gross = F.sum(F.abs("w")).over(Window.partitionBy("account"))
    rows = rows.withColumn("gross", gross).withColumn("room", room)
    scaled = F.when((F.col("gross") > F.col("room")) & (F.col("gross") > 0), F.col("w") * F.col("room") / F.col("gross")).otherwise(F.col("w"))
    return rows.select("account", "symbol", F.when(daily_loss(policy), 0.0).otherwise(scaled).alias("target_weight"))


def daily_loss(policy: Policy) -> Column:
    return F.coalesce((F.col("last_equity") > 0) & (F.col("equity") / F.col("last_equity") - 1 <= -policy.max_daily_loss), F.lit(False))


def order_plan(targets: DataFrame, positions: DataFrame, prices: DataFrame, accounts: DataFrame, open_orders: DataFrame, availability: DataFrame, limits: DataFrame, policy: Policy) -> DataFrame:
    """One row for each name that an account holds or is to hold, with the order sent or the reason for none.

    accounts: (account, as_of, equity, last_equity, cash, buying_power, shorting_enabled, allow_short,
    unmanaged_notional); targets: (account, symbol, target_weight); positions: (account, symbol, quantity); prices:
    (symbol, price); open_orders: (account, symbol); availability: (symbol, shortable, easy_to_borrow); limits: (symbol,
    max_weight, max_notional, max_share), nulls where a name has none of its own.

    reason of an order: daily_loss_exit, flatten_before_reverse (a change of sign ends at zero first), cover_short,
    open_short, close_long or open_long. Reason of no order: no_equity, short_targets_refused (the account may not sell
    short, so nothing is planned for it), open_order, no_price, not_borrowable, at_target, below_minimum (full exits
    are sent however small), no_whole_share (shorts trade in whole shares) and no_budget. Limits on an order hold for
    those that add risk. Buys spend cash (buying power, where shorts are allowed) and what closing sales bring, in
    symbol order; those that cover, flatten or exit after a loss are sent in any case.
    """
    accounts = accounts.withColumn("allow_short", F.coalesce("allow_short", F.lit(False)))
    refused = targets.where("target_weight < 0").select("account").distinct().join(accounts.where("not allow_short"), "account", "left_semi").withColumn("refused", F.lit(True))
    safe = safe_targets(targets, accounts, limits, policy)
    rows = safe.join(positions, ["account", "symbol"], "full_outer").join(accounts, "account").join(refused, "account", "left")
    # prices, availability and limits have a row for a name
    rows = rows.join(prices, "symbol", "left").join(availability, "symbol", "left").join(limits, "symbol", "left")
    rows = rows.join(open_orders.select("account", "symbol").distinct().withColumn("waiting", F.lit(True)), ["account", "symbol"], "left")

    now, weight = F.coalesce("quantity", F.lit(0.0)), F.coalesce("target_weight", F.lit(0.0))
    wanted = F.try_divide(weight * F.col("equity"), F.col("price"))
    rows = rows.select("*", now.alias("now"), weight.alias("weight"), F.when(wanted < 0, -F.floor(F.abs(wanted))).otherwise(wanted).alias("wanted"), daily_loss(policy).alias("lost"))
    turning = F.coalesce(F.col("now") * F.col("wanted") < 0, F.lit(False))
    rows = rows.withColumn("turning", turning).withColumn("wanted", F.when(turning, 0.0).otherwise(F.col("wanted")))
    borrow = F.col("shorting_enabled") & (F.col("equity") >= SHORT_EQUITY) & F.col("shortable")
    borrow = borrow & F.col("easy_to_borrow") if policy.require_easy_to_borrow else borrow
    gated = (F.col("wanted") < F.least("now", F.lit(0.0))) & ~F.coalesce(borrow, F.lit(False))
    rows = rows.withColumn("gated", F.coalesce(gated, F.lit(False))).withColumn("wanted", F.when(F.col("gated"), F.col("now")).otherwise(F.col("wanted")))

    delta = F.col("wanted") - F.col("now")
    reducing = (F.abs("wanted") < F.abs("now")) & (F.col("now") * F.col("wanted") >= 0)
    exits = reducing & (F.abs("wanted") < TINY)
    minimum = F.greatest(F.lit(policy.min_trade_notional), policy.min_trade_share * F.col("equity"))
    rows = rows.withColumns({"delta": delta, "reducing": reducing, "exits": exits, "minimum": minimum, "side": F.when(delta > 0, "buy").otherwise("sell")})
    purpose = _first(
        (F.col("turning"), "flatten_before_reverse"), (F.col("lost"), "daily_loss_exit"), ((F.col("now") < 0) & (F.col("delta") > 0), "cover_short"),
        ((F.col("wanted") < F.col("now")) & (F.col("wanted") < 0), "open_short"), ((F.col("now") > 0) & (F.col("delta") < 0), "close_long"),
    ).otherwise("open_long")
    if policy.limit_offset_bps is None:
        limit_price = F.lit(None).cast("double")
    else:
        raw = F.col("price") * (1 + F.when(F.col("side") == "buy", 1.0).otherwise(-1.0) * policy.limit_offset_bps / 10000)
        limit_price = F.when(raw >= 1, rounded(raw, 2)).otherwise(rounded(raw, 4))
        limit_price = F.when(F.col("exits"), None).otherwise(limit_price) if policy.market_exits else limit_price
    rows = rows.withColumn("purpose", purpose).withColumn("limit_price", limit_price).withColumn("order_price", F.coalesce("limit_price", "price"))
    most = F.coalesce("max_notional", F.lit(policy.max_order_notional))
    share = F.coalesce("max_share", F.lit(policy.max_order_share).cast("double"))
    most = F.when(share.isNotNull(), F.least(most, share * F.col("equity"))).otherwise(most)
    whole = (F.col("now") < 0) | (F.col("wanted") < 0)
    size = F.when(whole, F.floor(F.abs("delta"))).otherwise(F.abs("delta"))
    size = F.when(F.col("reducing"), size).otherwise(F.least(size, most / F.col("order_price")))
    size = F.when(whole, F.floor(size).cast("double")).otherwise(_floor6(size))
    rows = rows.withColumn("size", size)
    stopped = _first(
        (~F.coalesce(F.col("equity") > 0, F.lit(False)), "no_equity"), (F.coalesce("refused", F.lit(False)), "short_targets_refused"), (F.coalesce("waiting", F.lit(False)), "open_order"),
        (~F.coalesce(F.col("price") > 0, F.lit(False)), "no_price"), (F.col("gated"), "not_borrowable"), (F.abs("delta") < TINY, "at_target"),
        ((F.abs(F.col("delta") * F.col("price")) < F.col("minimum")) & ~F.col("exits"), "below_minimum"), (F.col("size") <= 0, "no_whole_share"),
    )
    rows = rows.withColumn("stopped", stopped)
    return _spent(rows, policy)


def _spent(rows: DataFrame, policy: Policy) -> DataFrame:
    """Gives each account's buys what its budget holds, in symbol order."""
    account = Window.partitionBy("account")
    go = F.col("stopped").isNull()
    notional = F.col("size") * F.col("order_price")
    closing = F.sum(F.when(go & (F.col("side") == "sell") & (F.col("purpose") != "open_short"), notional).otherwise(0.0)).over(account)
    base = F.when(F.col("allow_short") & (F.col("buying_power") > 0), F.col("buying_power")).otherwise(F.col("cash"))
    budget = F.greatest(base, F.lit(0.0)) * (1 - policy.cash_buffer) + closing
    exempt = F.col("purpose").isin("cover_short", "daily_loss_exit", "flatten_before_reverse")
    kept = ["symbol", "stopped", "purpose", "side", "size", "price", "limit_price", "order_price", "weight", "minimum", "as_of"]
    name = F.struct(*kept, (go & (F.col("side") == "buy")).alias("buys"), exempt.alias("exempt"))
    each = rows.withColumn("budget", budget).groupBy("account").agg(F.first("budget").alias("budget"), F.array_sort(F.collect_list(name)).alias("names"))

    def take(state: Column, x: Column) -> Column:
        paid = F.least(x["size"] * x["order_price"], state["left"])
        part = _floor6(paid / x["order_price"])
        part = F.when((paid < x["minimum"]) | (part <= 0), 0.0).otherwise(part)
        size = F.when(~x["buys"] | x["exempt"], x["size"]).otherwise(part)
        left = F.when(~x["buys"], state["left"]).when(x["exempt"], F.greatest(state["left"] - x["size"] * x["order_price"], F.lit(0.0))).otherwise(state["left"] - part * x["order_price"])
        return F.struct(left.alias("left"), F.concat(state["sizes"], F.array(size)).alias("sizes"))

    start = F.struct(F.col("budget").alias("left"), F.array().cast("array<double>").alias("sizes"))
    each = each.withColumn("sizes", F.aggregate("names", start, take, lambda s: s["sizes"]))
    out = each.select("account", F.inline(F.arrays_zip("names", "sizes"))).select("account", "names.*", "sizes")
    reason = F.when(F.col("stopped").isNotNull(), F.col("stopped")).when(F.col("buys") & ~F.col("exempt") & (F.col("sizes") <= 0), "no_budget").otherwise(F.col("purpose"))
    sent = F.col("stopped").isNull() & (F.col("reason") != "no_budget")
    out = out.withColumn("reason", reason).withColumn("sent", sent)
    code = F.concat_ws("-", F.lit(policy.prefix[:8]), F.date_format("as_of", "yyyyMMddHHmm"), F.lit(policy.strategy[:8]), F.substring("symbol", 1, 8), F.substring("side", 1, 1))
    shown = {"side": F.col("side"), "quantity": F.col("sizes"), "notional": F.col("sizes") * F.col("order_price"), "limit_price": F.col("limit_price"), "client_order_id": F.substring(code, 1, 48)}
    return out.select("account", "symbol", "sent", "reason", F.col("weight").alias("target_weight"), F.col("price").alias("reference_price"), *[F.when(F.col("sent"), v).alias(k) for k, v in shown.items()])
