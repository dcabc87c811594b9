"""Signals, positions and screens of one index's intraday sleeve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intraday import clock, in_session, opening_efficiency, session_attributes, session_vwap

#: The features of a signal frame.
SIGNALS = ("open_trend", "recent", "vwap_trend", "gap", "prior_return")


def signal_frame(bars: DataFrame, recent: int = 2) -> DataFrame:
    """bars with clock, next_open and the features: open_trend, recent (over that many bars), vwap_trend, gap, prior_return."""
    rows = session_vwap(session_attributes(bars)).withColumn("clock", clock())
    rows = rows.withColumn("recent", F.try_divide(F.col("close"), F.lag("close", recent).over(in_session())) - 1)
    return rows.withColumn("open_trend", F.try_divide("close", "first_open") - 1).withColumn("vwap_trend", F.try_divide("close", "vwap") - 1)


def signed_size(score: Column, least_bps: float, long: float, short: float, weak: float = 0.0, full_bps: float | None = None) -> Column:
    """A weight of the score's sign: weak under least_bps, full from it on or, with full_bps, rising to full until there."""
    bps = F.abs(score) * 10000
    full = F.when(score > 0, long).otherwise(short)
    if full_bps is None:
        size = F.when(bps >= least_bps, full).otherwise(weak)
    else:
        ramp = F.least((bps - least_bps) / (full_bps - least_bps), F.lit(1.0))
        size = F.when(bps <= least_bps, F.lit(weak)).otherwise(weak + ramp * (full - weak))
    return F.signum(score) * size


def index_targets(bars: DataFrame, core: str, signals: tuple[int, ...], flat: int, size: dict, efficiency: float | None = None) -> DataFrame:
    """(timestamp, symbol, target_weight, score) of the core at every bar: sized at each signal clock by the return since
    the open, held until the next one, 0 where the path was choppy, before the first signal and from the flat clock on."""
    rows = opening_efficiency(bars.where(F.col("symbol") == core)).withColumn("clock", clock())
    score = F.round("opening_return", 9)
    weight = signed_size(score, **size)
    if efficiency is not None:
        weight = F.when(F.coalesce(F.col("efficiency") >= efficiency, F.lit(False)), weight).otherwise(0.0)
    at = F.when(F.col("clock").isin(*signals) & score.isNotNull(), weight)
    held = F.last(at, ignorenulls=True).over(in_session())
    return rows.select("timestamp", "symbol", F.when(F.col("clock") >= flat, 0.0).otherwise(F.coalesce(held, F.lit(0.0))).alias("target_weight"), F.col("opening_return").alias("score"))


def sleeve_returns(frame: DataFrame, variants: DataFrame, bps: float, long: float = 0.05, short: float = 0.05, weak: float = 0.0) -> DataFrame:
    """(variant_id, session, sleeve_return, side) of every variant, all in one job.

    variants: (variant_id, feature, signal, exit, direction, threshold_bps). The feature at the signal clock decides, the
    next open is the entry, the open after the exit clock the exit; both are slipped. A session without prices is flat.
    """
    names = [s for s in SIGNALS if s in frame.columns]
    long_form = frame.select("session", "clock", "next_open", F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in names]), F.array(*[F.col(s) for s in names]))).alias("feature", "score"))
    entry = long_form.withColumnRenamed("clock", "signal").withColumnRenamed("next_open", "_entry")
    out = frame.select("session", F.col("clock").alias("exit"), F.col("next_open").alias("_exit"))
    rows = entry.join(variants, ["feature", "signal"]).join(out, ["session", "exit"], "left")
    strong = F.abs("score") * 10000 >= F.col("threshold_bps")
    side = F.signum("score") * F.when(F.col("direction") == "reversal", -1.0).otherwise(1.0)
    valid = F.col("score").isNotNull() & (F.col("_entry") > 0) & (F.col("_exit") > 0) & (strong | F.lit(weak > 0))
    slip = bps / 1e4
    up = F.col("_exit") * (1 - slip) / (F.col("_entry") * (1 + slip)) - 1
    down = (F.col("_entry") * (1 - slip) - F.col("_exit") * (1 + slip)) / F.col("_entry")
    rows = rows.withColumn("side", F.when(F.coalesce(valid, F.lit(False)), side).otherwise(0.0))
    gain = F.when(F.col("side") > 0, F.when(strong, long).otherwise(weak) * up).when(F.col("side") < 0, F.when(strong, short).otherwise(weak) * down).otherwise(0.0)
    return rows.select("variant_id", "session", gain.alias("sleeve_return"), "side")


def period_summary(returns: DataFrame, periods: DataFrame, value: str = "sleeve_return", key: str = "variant_id", time: str = "session") -> DataFrame:
    """(key, period, n, total_return, sharpe, max_drawdown) of each stream in each named period (period, start, end)."""
    rows = returns.join(periods, F.col(time).between(F.col("start"), F.col("end")))
    w = Window.partitionBy(key, "period").orderBy(time)
    rows = rows.withColumn("_e", F.exp(F.sum(F.log1p(value)).over(w)))
    rows = rows.withColumn("_d", F.col("_e") / F.max("_e").over(w) - 1)
    sharpe = F.coalesce(F.try_divide(F.avg(value), F.stddev_pop(value)) * F.sqrt(F.lit(252.0)), F.lit(0.0))
    return rows.groupBy(key, "period").agg(F.count(F.lit(1)).alias("n"), (F.max_by("_e", time) - 1).alias("total_return"), sharpe.alias("sharpe"), F.min("_d").alias("max_drawdown"))


def screen(returns: DataFrame, periods: DataFrame, least_active: float = 0.8, key: str = "variant_id") -> DataFrame:
    """One row a variant: how often it is active, its summaries in train and validation, the selection score (the lesser
    Sharpe), whether it is eligible, and its place: eligible ones first, then by score, validation, train and id."""
    of = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    g = period_summary(returns, periods, key=key).groupBy(key).agg(*[of(p, c).alias(f"{p}_{c}") for p in ("train", "validation") for c in ("sharpe", "total_return")])
    rate = returns.groupBy(key).agg(F.avg((F.col("side") != 0).cast("double")).alias("active_rate"))
    out = g.join(rate, key).withColumn("selection_score", F.least("train_sharpe", "validation_sharpe"))
    ok = (F.col("active_rate") >= least_active) & (F.col("train_total_return") > 0) & (F.col("validation_total_return") > 0)
    out = out.withColumn("eligible", F.coalesce(ok, F.lit(False)))
    order = [F.col("eligible").desc(), *[F.round(c, 9).desc() for c in ("selection_score", "validation_sharpe", "train_sharpe")], F.col(key)]
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # one row a variant
