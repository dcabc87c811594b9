"""A grid of strategy parameters from signal to ranked metrics, all variants in one job.

Variants share what they can: running sums of returns and their squares give the deviation over any window, signals are
made once for each pair of lookbacks, and only what a variant holds is expanded to its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluate import equity_curve, holding_returns, metrics

PARAMETERS = ("lookback", "volatility", "top_n", "every")


def momentum_signals(panel: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(timestamp, symbol, lookback, volatility, score) for each pair of windows, where the score is positive.

    The score is the return over lookback timestamps over the annual deviation (of a sample) of the returns of the last
    `volatility` ones, each of which must be there. panel: (timestamp, symbol, close), a row for each timestamp and symbol.
    """
    w = Window.partitionBy("symbol").orderBy("timestamp")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = panel.withColumn("_r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    zero = F.coalesce("_r", F.lit(0.0))
    rows = rows.withColumns({"_c": F.count("_r").over(sofar), "_s": F.sum(zero).over(sofar), "_q": F.sum(zero * zero).over(sofar)})
    windows = sorted({v for _, v in pairs})
    for v in windows:
        n, s, q = (F.col(c) - F.lag(c, v, 0).over(w) for c in ("_c", "_s", "_q"))
        variance = F.greatest((q - s * s / v) / (v - 1), F.lit(0.0))
        rows = rows.withColumn(f"_v{v}", F.when(n == v, F.sqrt(variance * 252)))
    for k in sorted({k for k, _ in pairs}):
        rows = rows.withColumn(f"_m{k}", F.try_divide(F.col("close"), F.lag("close", k).over(w)) - 1)
    each = [F.struct(F.lit(k).alias("lookback"), F.lit(v).alias("volatility"), F.try_divide(f"_m{k}", f"_v{v}").alias("score")) for k, v in pairs]
    return rows.select("timestamp", "symbol", F.inline(F.array(*each))).where("score > 0")


def sweep_returns(panel: DataFrame, variants: DataFrame, gross: float = 1.0, bps: float = 10.0) -> DataFrame:
    """(variant_id, timestamp, daily_return, turnover, orders) of every variant (variant_id, lookback, volatility, top_n, every).

    Every `every` timestamps the top_n best positive scores share the gross exposure, and are held till the next time.
    A weight set at t acts at the open of t + 1; what is traded costs bps. panel: as above with open; it is read several
    times. variants: a table as small as the user's lists.
    """
    grid = [tuple(r[c] for c in ("variant_id", *PARAMETERS)) for r in variants.collect()]
    days = panel.select("timestamp").distinct().withColumn("_k", F.row_number().over(Window.orderBy("timestamp")) - 1)  # a calendar table
    signals = momentum_signals(panel, sorted({g[1:3] for g in grid})).join(F.broadcast(days), "timestamp")
    due = F.lit(False)
    for e in sorted({g[4] for g in grid}):
        due = due | (F.col("_k") % e == 0)
    best = Window.partitionBy("timestamp", "lookback", "volatility").orderBy(F.round("score", 9).desc(), "symbol")
    ranked = signals.where(due).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= max(g[3] for g in grid))
    chosen = ranked.join(F.broadcast(variants), ["lookback", "volatility"]).where((F.col("_rank") <= F.col("top_n")) & (F.col("_k") % F.col("every") == 0))
    weight = gross / F.count(F.lit(1)).over(Window.partitionBy("variant_id", "_k"))
    chosen = chosen.select("variant_id", "symbol", "_k", "every", weight.alias("_w"))
    numbered = holding_returns(panel).select("timestamp", "symbol", "forward").join(F.broadcast(days), "timestamp")
    held = chosen.withColumn("_k", F.explode(F.sequence(F.col("_k"), F.col("_k") + F.col("every") - 1))).join(numbered, ["_k", "symbol"])
    earned = held.groupBy("variant_id", "_k").agg(F.sum(F.col("_w") * F.coalesce("forward", F.lit(0.0))).alias("_earned"))
    # what is set at one time and let go at the next cancels where a name stays
    ends = chosen.select("variant_id", "symbol", F.inline(F.array(F.struct(F.col("_k").alias("_k"), F.col("_w").alias("_d")), F.struct((F.col("_k") + F.col("every")).alias("_k"), (-F.col("_w")).alias("_d")))))
    moved = ends.groupBy("variant_id", "symbol", "_k").agg(F.sum("_d").alias("_d")).where("abs(_d) > 1e-12")
    traded = moved.groupBy("variant_id", "_k").agg(F.sum(F.abs("_d")).alias("turnover"), F.count(F.lit(1)).alias("orders"))
    all_ = days.crossJoin(F.broadcast(variants.select("variant_id"))).join(earned, ["variant_id", "_k"], "left").join(traded, ["variant_id", "_k"], "left").na.fill(0)
    return all_.select("variant_id", "timestamp", (F.col("_earned") - F.col("turnover") * bps / 1e4).alias("daily_return"), "turnover", "orders")


def sweep(panel: DataFrame, variants: DataFrame, train: float = 0.7, gross: float = 1.0, bps: float = 10.0) -> DataFrame:
    """variants with return, Sharpe and drawdown in train and test, robust_score, orders, annual_turnover and place.

    The first share of the timestamps is train, the rest test. robust_score is the lesser Sharpe; variants are placed by
    it, then by the Sharpe of test, then by number.
    """
    returns = sweep_returns(panel, variants, gross, bps)
    n = F.count(F.lit(1)).over(Window.partitionBy("variant_id"))
    at = F.row_number().over(Window.partitionBy("variant_id").orderBy("timestamp"))
    cut = F.least(F.greatest(F.floor(n * train + 1e-9), F.lit(1)), n - 1)
    rows = returns.withColumn("fold", F.when(at <= cut, "train").otherwise("test"))
    by_fold = metrics(equity_curve(rows, ("variant_id", "fold")), ("variant_id", "fold"))
    of = lambda f, c, name: F.max(F.when(F.col("fold") == f, F.col(c))).alias(f"{f}_{name}")
    shown = (("total_return", "return"), ("sharpe", "sharpe"), ("max_drawdown", "max_drawdown"))
    folds = by_fold.groupBy("variant_id").agg(*[of(f, c, name) for f in ("train", "test") for c, name in shown])
    whole = metrics(equity_curve(returns, ("variant_id",)), ("variant_id",)).select("variant_id", "annual_turnover")
    orders = returns.groupBy("variant_id").agg(F.sum("orders").alias("orders"))
    out = variants.join(folds, "variant_id").join(whole, "variant_id").join(orders, "variant_id").withColumn("robust_score", F.least("train_sharpe", "test_sharpe"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.round("robust_score", 9).desc(), F.round("test_sharpe", 9).desc(), "variant_id")))
