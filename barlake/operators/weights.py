"""Rankings, selections and target weights: rows (timestamp, symbol, target_weight, score).

Ties on a score are broken by symbol, always. Everything here depends on one cross-section only, except `held`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OUT = ("timestamp", "symbol", "target_weight", "score")


def _ranked(time: str, *order: Column):
    return F.row_number().over(Window.partitionBy(time).orderBy(*order))


def top_n(scores: DataFrame, n: int, gross: float = 1.0, eligible: Column | None = None) -> DataFrame:
    """Equal weights on the n best positive scores of each timestamp."""
    ok = F.col("score") > 0
    rows = scores.where(ok if eligible is None else ok & eligible)
    rows = rows.withColumn("_r", _ranked("timestamp", F.col("score").desc(), F.col("symbol"))).where(F.col("_r") <= n)
    return rows.withColumn("target_weight", gross / F.count(F.lit(1)).over(Window.partitionBy("timestamp"))).select(*OUT)


def quantile_weights(scores: DataFrame, quantiles: int, gross: float = 1.0, long_short: bool = False, cap: float | None = None) -> DataFrame:
    """Longs on the top 1/quantiles of each timestamp (one at least), shorts on the other end where asked for."""
    w = Window.partitionBy("timestamp")
    rows = scores.where(F.col("score").isNotNull()).withColumn("_k", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / quantiles)))
    rows = rows.withColumn("_hi", _ranked("timestamp", F.col("score").desc(), F.col("symbol"))).withColumn("_lo", _ranked("timestamp", F.col("score"), F.col("symbol")))
    long = F.col("_hi") <= F.col("_k")
    side = F.when(long, 1).when(F.lit(long_short) & (F.col("_lo") <= F.col("_k")), -1)
    rows = rows.withColumn("_side", side).where("_side is not null")
    n_side = F.count(F.lit(1)).over(Window.partitionBy("timestamp", "_side"))
    size = F.lit(gross / (2 if long_short else 1)) / n_side
    size = F.least(size, F.lit(cap)) if cap is not None else size
    return rows.withColumn("target_weight", size * F.col("_side")).select(*OUT)


def static_weights(bars: DataFrame, weights: dict[str, float] | None = None, gross: float = 1.0) -> DataFrame:
    """Equal or given weights, normalised to gross, at every timestamp of every symbol that has a bar."""
    rows = bars.select("timestamp", "symbol").distinct()
    if weights is None:
        count = bars.agg(F.count_distinct("symbol").alias("_n"))
        return rows.crossJoin(F.broadcast(count)).select("timestamp", "symbol", (gross / F.col("_n")).alias("target_weight"), F.lit(1.0).alias("score"))
    total = sum(weights.values())
    share = F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(gross * w / total))])
    return rows.where(F.col("symbol").isin(list(weights))).select("timestamp", "symbol", share[F.col("symbol")].alias("target_weight"), F.lit(1.0).alias("score"))


def membership_weights(bars: DataFrame, members: DataFrame, gross: float = 1.0) -> DataFrame:
    """Equal weights on the members of the moment; members: (symbol, start, end), end inclusive, null is open."""
    rows = in_membership(bars.select("timestamp", "symbol"), members)
    return rows.withColumn("target_weight", gross / F.count(F.lit(1)).over(Window.partitionBy("timestamp"))).withColumn("score", F.lit(1.0)).select(*OUT)


def in_membership(rows: DataFrame, members: DataFrame, time: str = "timestamp") -> DataFrame:
    """Rows whose symbol is a member at that time; overlapping periods count once."""
    m = members.select(F.col("symbol").alias("_s"), "start", "end")
    at = F.to_date(time)
    inside = (rows.symbol == F.col("_s")) & (at >= F.col("start")) & (F.col("end").isNull() | (at <= F.col("end")))
    return rows.join(m, inside, "left_semi")


def inverse_volatility(selected: DataFrame, sigma: str, gross: float = 1.0) -> DataFrame:
    rows = selected.where(F.col(sigma) > 0)
    return rows.withColumn("target_weight", F.try_divide(F.lit(gross) / F.col(sigma), F.sum(1 / F.col(sigma)).over(Window.partitionBy("timestamp"))))


def capped_inverse_volatility(selected: DataFrame, sigma: str, cap: float, gross: float = 1.0) -> DataFrame:
    """Inverse-volatility weights with no name above cap, what is cut going to the others pro rata.

    Sorted by 1/sigma, a name is pinned at the cap exactly while its share of what is left reaches it, so the pinned
    names are a prefix and no repetition is needed. If all are pinned, gross is cap times their number.
    """
    order = Window.partitionBy("timestamp").orderBy(F.col("_inv").desc(), "symbol")
    rows = selected.where(F.col(sigma) > 0).withColumn("_inv", 1 / F.col(sigma))
    rows = rows.withColumn("_k", F.row_number().over(order)).withColumn("_rest", F.sum("_inv").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_pin", (F.lit(gross) - cap * (F.col("_k") - 1)) * F.col("_inv") / F.col("_rest") >= cap)
    all_ = Window.partitionBy("timestamp")
    m, free = F.count_if("_pin").over(all_), F.sum(F.when(~F.col("_pin"), F.col("_inv"))).over(all_)
    weight = F.when(F.col("_pin"), F.lit(cap)).otherwise(F.try_divide((F.lit(gross) - cap * m) * F.col("_inv"), free))
    return rows.withColumn("target_weight", weight).drop("_inv", "_k", "_rest", "_pin")


def constrain(targets: DataFrame, cap: float, gross: float, long_only: bool = True, overrides: dict[str, float] | None = None) -> DataFrame:
    """Weights clipped to each symbol's cap, then scaled down to the gross limit of their timestamp."""
    limit = F.lit(float(cap))
    for s, c in (overrides or {}).items():
        limit = F.when(F.col("symbol") == s, F.lit(float(c))).otherwise(limit)
    clipped = F.least(F.greatest(F.col("target_weight"), F.lit(0.0) if long_only else -limit), limit)
    rows = targets.withColumn("target_weight", clipped)
    total = F.sum(F.abs("target_weight")).over(Window.partitionBy("timestamp"))
    return rows.withColumn("target_weight", F.col("target_weight") * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(float(gross)), total), F.lit(1.0))))


def disable(targets: DataFrame, disabled: DataFrame) -> DataFrame:
    """Weights of the listed symbols forced to 0."""
    off = disabled.select("symbol", F.lit(True).alias("_off")).distinct()
    joined = targets.join(off, "symbol", "left")
    return joined.withColumn("target_weight", F.when(F.col("_off"), 0.0).otherwise(F.col("target_weight"))).select(*targets.columns)


def latest_targets(targets: DataFrame) -> DataFrame:
    newest = targets.agg(F.max("timestamp").alias("timestamp"))
    return targets.join(F.broadcast(newest), "timestamp", "left_semi")


def last_prices(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max_by("close", "timestamp").alias("price"))


def rebalance_days(panel: DataFrame, every: int) -> DataFrame:
    """Timestamps whose place from the panel's start is a multiple of `every`.

    Only the distinct timestamps are numbered; they are few, as the calendar does not grow with the symbols.
    """
    days = panel.select("timestamp").distinct()
    return days.withColumn("place", F.row_number().over(Window.orderBy("timestamp")) - 1).where(F.col("place") % every == 0)


def held(panel: DataFrame, targets: DataFrame, every: int) -> DataFrame:
    """The weight in force at every cell: that of the last rebalance, 0 for symbols not in it."""
    due = rebalance_days(panel, every).select("timestamp", F.lit(True).alias("_due"))
    rows = panel.join(due, "timestamp", "left").join(targets.select("timestamp", "symbol", "target_weight"), ["timestamp", "symbol"], "left")
    set_ = F.when(F.col("_due"), F.coalesce("target_weight", F.lit(0.0)))
    w = Window.partitionBy("symbol").orderBy("timestamp")
    return rows.withColumn("weight", F.coalesce(F.last(set_, ignorenulls=True).over(w), F.lit(0.0))).drop("_due", "target_weight")
