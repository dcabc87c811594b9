"""Next-open evaluation of weights and the metrics of return streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .weights import held


def holding_returns(panel: DataFrame) -> DataFrame:
    """What a weight decided at t earns: from the open of t+1 to the open of t+2."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    return panel.withColumn("forward", F.try_divide(F.lead("open", 2).over(w), F.lead("open", 1).over(w)) - 1)


def turnover_costs(weights: DataFrame, bps: float, overrides: dict[str, float] | None = None) -> DataFrame:
    """Traded weight and its cost, by symbol."""
    rate = F.lit(bps / 1e4)
    for s, b in (overrides or {}).items():
        rate = F.when(F.col("symbol") == s, F.lit(b / 1e4)).otherwise(rate)
    before = F.lag("weight", 1, 0.0).over(Window.partitionBy("symbol").orderBy("timestamp"))
    return weights.withColumn("traded", F.abs(F.col("weight") - before)).withColumn("cost", F.col("traded") * rate)


def portfolio_returns(panel: DataFrame, targets: DataFrame, every: int = 1, bps: float = 10.0) -> DataFrame:
    """(timestamp, daily_return, gross_exposure, turnover, cost) of weights kept constant between rebalances."""
    rows = turnover_costs(held(holding_returns(panel), targets, every), bps)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    return rows.groupBy("timestamp").agg(
        (total(F.col("weight") * F.col("forward")) - total("cost")).alias("daily_return"),
        total(F.abs("weight")).alias("gross_exposure"), total("traded").alias("turnover"), total("cost").alias("cost"),
    )


def equity_curve(returns: DataFrame, keys: tuple[str, ...] = (), initial: float = 1.0) -> DataFrame:
    """Equity after each return and its drawdown, for each stream of `keys`."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    out = returns.withColumn("equity", F.lit(initial) * F.exp(F.sum(F.log1p("daily_return")).over(w)))
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def rebalance_legs(panel: DataFrame, targets: DataFrame, every: int = 1) -> DataFrame:
    """A row for each change of weight, at the next open."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    rows = held(panel, targets, every).withColumn("price", F.lead("open").over(w)).withColumn("change", F.col("weight") - F.lag("weight", 1, 0.0).over(w))
    return rows.where("change <> 0").select("timestamp", "symbol", F.when(F.col("change") > 0, "buy").otherwise("sell").alias("side"), "change", "price")


def metrics(curve: DataFrame, keys: tuple[str, ...] = (), periods: int = 252) -> DataFrame:
    """One row for each stream of a curve (timestamp, daily_return, equity, drawdown, turnover[, benchmark_return]).

    Deviations are those of a population. Where a ratio has nothing below the line it is 0.
    """
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    r, root = F.col("daily_return"), F.sqrt(F.lit(float(periods)))
    aggs = [
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.max_by("equity", "timestamp").alias("final"),
        F.avg(r).alias("mean"), F.stddev_pop(r).alias("sd"), F.stddev_pop(F.least(r, F.lit(0.0))).alias("down"),
        F.min("drawdown").alias("max_drawdown"), F.sum("turnover").alias("turnover"),
    ]
    with_benchmark = "benchmark_return" in curve.columns
    if with_benchmark:
        b = F.col("benchmark_return")
        aggs += [F.covar_pop(r, b).alias("cov"), F.var_pop(F.when(r.isNotNull(), b)).alias("var"), F.avg(b).alias("mean_b")]
    g = curve.groupBy(*keys).agg(*aggs) if keys else curve.agg(*aggs)
    years = F.greatest(F.datediff("last", "first"), F.lit(1)) / 365.25
    cagr = F.pow(F.col("final"), 1 / years) - 1
    out = [
        *keys, F.col("n"), (F.col("final") - 1).alias("total_return"), cagr.alias("cagr"), zero(F.col("sd") * root).alias("volatility"),
        zero(F.try_divide(F.col("mean") * root, F.col("sd"))).alias("sharpe"), zero(F.try_divide(F.col("mean") * root, F.col("down"))).alias("sortino"),
        F.col("max_drawdown"), zero(F.try_divide(cagr, F.abs("max_drawdown"))).alias("calmar"), (F.col("turnover") / years).alias("annual_turnover"),
    ]
    if with_benchmark:
        beta = zero(F.try_divide(F.col("cov"), F.col("var")))
        out += [beta.alias("beta"), ((F.col("mean") - beta * F.col("mean_b")) * periods).alias("alpha")]
    return g.select(*out)


def split_dates(curve: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(timestamp, fold): the distinct timestamps cut at the running shares, each fold keeping at least one."""
    days = curve.select("timestamp").distinct()
    place = F.row_number().over(Window.orderBy("timestamp"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    at, fold = 0.0, F.lit(None).cast("string")
    cuts: list[tuple[str, Column]] = []
    for name, share in shares.items():
        at += share
        cuts.append((name, F.floor(n * at + 1e-9)))
    for name, cut in reversed(cuts):
        fold = F.when(F.col("_place") <= F.col("_" + name), F.lit(name)).otherwise(fold)
    marked = days.select("timestamp", place.alias("_place"), *[c.alias("_" + name) for name, c in cuts])
    return marked.select("timestamp", F.coalesce(fold, F.lit(cuts[-1][0])).alias("fold"))


def by_period(curve: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows of the curve under each named period (name, start, end) they fall in, both ends included."""
    return curve.join(F.broadcast(periods), F.col("timestamp").between(F.col("start"), F.col("end")))


def variant_returns(panel: DataFrame, targets: DataFrame, variants: DataFrame) -> DataFrame:
    """(variant_id, timestamp, daily_return, turnover) of every variant of how targets are held, all in one job.

    variants: (variant_id, every, bps, limit): rebalance every so many timestamps, at that cost, with the `limit` best names of
    each target date, equally weighted. panel has open; targets (timestamp, symbol, score), a row for each candidate.
    """
    days = panel.select("timestamp").distinct().withColumn("_place", F.row_number().over(Window.orderBy("timestamp")) - 1)
    rank = F.row_number().over(Window.partitionBy("timestamp").orderBy(F.col("score").desc(), "symbol"))
    ranked = targets.select("timestamp", "symbol", rank.alias("_rank")).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("timestamp")))
    rows = holding_returns(panel).select("timestamp", "symbol", "forward").join(days, "timestamp").join(ranked, ["timestamp", "symbol"], "left").crossJoin(F.broadcast(variants))
    weight = F.when(F.col("_rank") <= F.col("limit"), 1.0 / F.least("limit", "_n")).otherwise(0.0)
    w = Window.partitionBy("variant_id", "symbol").orderBy("timestamp")
    rows = rows.withColumn("_w", F.coalesce(F.last(F.when(F.col("_place") % F.col("every") == 0, weight), ignorenulls=True).over(w), F.lit(0.0)))
    rows = rows.withColumn("_t", F.abs(F.col("_w") - F.lag("_w", 1, 0.0).over(w)))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    return rows.groupBy("variant_id", "timestamp").agg((total(F.col("_w") * F.col("forward")) - total(F.col("_t") * F.col("bps") / 1e4)).alias("daily_return"), total("_t").alias("turnover"))


def compare_arms(strategy: DataFrame, panel: DataFrame, benchmark: str) -> DataFrame:
    """(arm, timestamp, daily_return, turnover): the strategy beside its benchmark and all names equally weighted.

    The arms are held from the first timestamp on and pay nothing; the equal weights are those of names with a return.
    """
    f = holding_returns(panel).select("timestamp", "symbol", "forward")
    zero = F.lit(0.0)
    equal = f.groupBy("timestamp").agg(F.coalesce(F.avg("forward"), zero).alias("daily_return"))
    market = f.groupBy("timestamp").agg(F.coalesce(F.max(F.when(F.col("symbol") == benchmark, F.col("forward"))), zero).alias("daily_return"))
    arm = lambda rows, name, turnover: rows.select(F.lit(name).alias("arm"), "timestamp", "daily_return", turnover.alias("turnover"))
    return arm(strategy, "strategy", F.col("turnover")).union(arm(equal, "equal_weight", zero)).union(arm(market, "benchmark", zero))


def whole_metrics(curve: DataFrame, legs: DataFrame, keys: tuple[str, ...] = ("variant_id",)) -> DataFrame:
    """`metrics` with benchmark_total_return, excess_return, orders (rows of legs) and fees (the curve's cost) for each stream."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    more = curve.groupBy(*keys).agg((F.exp(F.sum(F.log1p(zero(F.col("benchmark_return"))))) - 1).alias("benchmark_total_return"), zero(F.sum("cost")).alias("fees"))
    out = metrics(curve, keys).join(more, list(keys)).join(legs.groupBy(*keys).agg(F.count(F.lit(1)).alias("orders")), list(keys), "left")
    return out.withColumn("orders", F.coalesce("orders", F.lit(0).cast("long"))).withColumn("excess_return", F.col("total_return") - F.col("benchmark_total_return"))
