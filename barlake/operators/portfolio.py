"""Portfolios whose weights depend on pairs of names, on what is held, or on the benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlake.functions.factors import clip


def trailing_pairs(panel: DataFrame, names: DataFrame, value: str, window: int, min_obs: int) -> DataFrame:
    """(timestamp, a, b, n, cov, corr) of each pair a <= b of the names of a timestamp, over the `window` panel rows up to it.

    names: (timestamp, symbol), a pool chosen beforehand. Only rows where both have a value count; fewer than min_obs
    give no row; a correlation with a constant is null. A row of the panel is looked up once for each pool whose
    window it is in. The calendar (distinct timestamps) is numbered without a partition.
    """
    days = panel.select("timestamp").distinct().withColumn("_place", F.row_number().over(Window.orderBy("timestamp")))
    ends = names.select("timestamp").distinct().join(days, "timestamp")
    span = ends.withColumn("_place", F.explode(F.sequence(F.greatest(F.col("_place") - (window - 1), F.lit(1)), F.col("_place"))))
    span = span.join(days.select("_place", F.col("timestamp").alias("_t")), "_place").select("timestamp", "_t")
    values = panel.select(F.col("timestamp").alias("_t"), "symbol", F.col(value).alias("_v")).where("_v is not null")
    cells = names.select("timestamp", "symbol").distinct().join(span, "timestamp").join(values, ["_t", "symbol"])
    a = cells.select("timestamp", "_t", F.col("symbol").alias("a"), F.col("_v").alias("x"))
    b = cells.select("timestamp", "_t", F.col("symbol").alias("b"), F.col("_v").alias("y"))
    g = a.join(b, ["timestamp", "_t"]).where("a <= b").groupBy("timestamp", "a", "b")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.covar_samp("x", "y").alias("cov"), F.covar_pop("x", "y").alias("_c"), (F.stddev_pop("x") * F.stddev_pop("y")).alias("_s"))
    return out.where(F.col("n") >= min_obs).select("timestamp", "a", "b", "n", "cov", F.try_divide("_c", "_s").alias("corr"))


def decorrelated_selection(ranked: DataFrame, pairs: DataFrame, n: int, exit_rank: int, per_sector: int) -> DataFrame:
    """(variant_id, timestamp, symbol, place) of the names held after each rebalance.

    ranked: (variant_id, max_corr, timestamp, symbol, rank, sector, usable) on rebalance dates, the whole pool; pairs as of
    `trailing_pairs`. Incumbents up to exit_rank come first, in the order in which they were chosen, then the pool by rank. A
    name joins unless its sector is full or it correlates above the variant's max_corr with one that has joined; if names are still
    missing, the pool is walked again without the correlation test. Names that are not usable are not held on. Dates
    are folded in order within a variant; only pairs above the limit reach the fold.
    """
    import pandas as pd

    close = pairs.where("corr is not null and a < b").select("timestamp", "a", "b", "corr")
    both = close.select("timestamp", F.col("a").alias("symbol"), F.col("b").alias("other"), "corr").union(close.select("timestamp", "b", "a", "corr"))
    names = ranked.select("variant_id", "max_corr", "timestamp", "symbol")
    lists = names.join(both, ["timestamp", "symbol"]).where(F.col("corr") > F.col("max_corr")).groupBy("variant_id", "timestamp", "symbol").agg(F.collect_list("other").alias("rivals"))
    rows = ranked.join(lists, ["variant_id", "timestamp", "symbol"], "left")

    def fold(day_rows: pd.DataFrame) -> pd.DataFrame:
        held: list[str] = []
        out = []
        for when, day in day_rows.sort_values(["timestamp", "rank", "symbol"]).groupby("timestamp", sort=True):
            info = {r.symbol: r for r in day.itertuples()}
            pool = [s for s in held if s in info and info[s].rank <= exit_rank]
            pool += [s for s in day["symbol"] if s not in pool]
            chosen: list[str] = []
            used: dict[str, int] = {}

            def join(name: str, test: bool) -> None:
                sector, rivals = info[name].sector, info[name].rivals
                if len(chosen) < n and name not in chosen and used.get(sector, 0) < per_sector:
                    if not (test and rivals is not None and any(x in chosen for x in rivals)):
                        chosen.append(name)
                        used[sector] = used.get(sector, 0) + 1

            for name in pool:
                join(name, True)
            for name in day["symbol"]:
                join(name, False)
            held = [s for s in chosen if info[s].usable]
            out += [(day["variant_id"].iloc[0], when, s, k) for k, s in enumerate(held)]
        return pd.DataFrame(out, columns=["variant_id", "timestamp", "symbol", "place"])

    kinds = dict(ranked.dtypes)
    return rows.groupBy("variant_id").applyInPandas(fold, f"variant_id {kinds['variant_id']}, timestamp {kinds['timestamp']}, symbol string, place int")


def tilted_volatility(sigma: Column, score: Column, beta: Column, strength: float = 0.2, penalty: float = 0.5) -> Column:
    """The volatility that weights are the inverse of, less for a good score and more for a beta away from 1."""
    return sigma / F.exp(strength * clip(score, -3.0, 3.0) - penalty * F.abs(beta - 1))


def forecast_ceiling(weights: DataFrame, pairs: DataFrame, target: float, periods: float = 252.0) -> DataFrame:
    """weights (timestamp, symbol, target_weight) scaled down where their forecast volatility is above the target.

    pairs as of `trailing_pairs` (a = b included); a pair without covariance counts as 0. Adds `forecast_volatility`.
    """
    w = lambda x: weights.select("timestamp", F.col("symbol").alias(x), F.col("target_weight").alias(f"w_{x}"))
    joined = pairs.join(w("a"), ["timestamp", "a"]).join(w("b"), ["timestamp", "b"])
    part = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0) * F.col("w_a") * F.col("w_b") * F.col("cov") * periods
    risk = joined.groupBy("timestamp").agg(F.sqrt(F.greatest(F.sum(part), F.lit(0.0))).alias("forecast_volatility"))
    out = weights.join(risk, "timestamp", "left").withColumn("forecast_volatility", F.coalesce("forecast_volatility", F.lit(0.0)))
    scale = F.when(F.col("forecast_volatility") > target, target / F.col("forecast_volatility")).otherwise(1.0)
    return out.withColumn("target_weight", F.col("target_weight") * scale)


def core_and_sleeve(targets: DataFrame, core: str, core_weight: float, active_weight: float, band: float, every: int, volatility_target: float | None = None, lookback: int = 20, context: tuple[str, ...] = ()) -> DataFrame:
    """`sleeve` of the names but the core and the context, beside the core at its fixed weight and the context at none."""
    active = targets.where(~F.col("symbol").isin(core, *context))
    held = sleeve(active, active_weight, band, every, volatility_target, lookback)
    rest = targets.where(F.col("symbol").isin(core, *context)).select("variant_id", "timestamp", "symbol", F.when(F.col("symbol") == core, core_weight).otherwise(0.0).alias("target_weight"))
    return held.unionByName(rest)


def sleeve(targets: DataFrame, active_weight: float, band: float, every: int, volatility_target: float | None = None, lookback: int = 20) -> DataFrame:
    """(variant_id, timestamp, symbol, target_weight) of a sleeve that trades only outside of a band.

    targets: (variant_id, timestamp, symbol, target_weight, r), a row for each name at each timestamp. Every `every`
    timestamps a weight changes if it would by at least `band`; the whole is scaled down to active_weight, and to the
    volatility target by the sleeve's own last `lookback` returns. What is held depends on what was held, so timestamps
    are folded in order within a variant.
    """
    import numpy as np
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        want = rows.pivot(index="timestamp", columns="symbol", values="target_weight").sort_index().fillna(0.0)
        moves = rows.pivot(index="timestamp", columns="symbol", values="r").reindex_like(want).fillna(0.0).to_numpy()
        wanted, now = want.to_numpy(), np.zeros(want.shape[1])
        out, past = np.zeros(want.shape), []
        for k in range(len(want)):
            past = [*past, float(now @ moves[k])][-lookback:]
            if k % every == 0:
                new = np.where(np.abs(wanted[k] - now) < band, now, wanted[k])
                gross = new.sum()
                if gross > active_weight and gross > 0:
                    new = new * (active_weight / gross)
                sd = float(np.std(past)) * np.sqrt(252.0) if volatility_target is not None and len(past) >= lookback else 0.0
                if sd > 0:
                    new = new * min(1.0, volatility_target / sd)
                now = np.where(new > 1e-12, new, 0.0)
            out[k] = now
        held = pd.DataFrame(out, index=want.index, columns=want.columns).stack().rename("target_weight").reset_index()
        held.insert(0, "variant_id", rows["variant_id"].iloc[0])
        return held[["variant_id", "timestamp", "symbol", "target_weight"]]

    kinds = dict(targets.dtypes)
    return targets.groupBy("variant_id").applyInPandas(fold, f"variant_id {kinds['variant_id']}, timestamp {kinds['timestamp']}, symbol string, target_weight double")


def apply_overlay(targets: DataFrame, overlay: DataFrame, core: str) -> DataFrame:
    """targets times the multipliers (timestamp, core_multiplier, active_multiplier) of their timestamp."""
    scale = F.when(F.col("symbol") == core, F.col("core_multiplier")).otherwise(F.col("active_multiplier"))
    joined = targets.join(overlay, "timestamp", "left").withColumn("target_weight", F.col("target_weight") * F.coalesce(scale, F.lit(1.0)))
    return joined.select(*targets.columns)


def drift_returns(panel: DataFrame, targets: DataFrame, every: int, bps: float = 10.0) -> DataFrame:
    """(timestamp, daily_return, block) of portfolios whose shares, not weights, are kept between rebalances.

    Weights decided at a rebalance t are bought at the open of t+1. Within a block the value is cash plus each weight
    times the growth of its open since then, and blocks are chained; the return at t is that from the open of t+1 to the
    open of t+2, the cost of the change of weights is paid at its first open. The change is that against the weights of
    the block before as they were set.
    """
    from .weights import held

    w = Window.partitionBy("symbol").orderBy("timestamp")
    rows = held(panel, targets, every)
    days = panel.select("timestamp").distinct()
    days = days.withColumn("block", F.floor((F.row_number().over(Window.orderBy("timestamp")) - 1) / every).cast("int"))
    rows = rows.join(days, "timestamp").withColumn("_next", F.lead("open").over(w)).withColumn("_after", F.lead("open", 2).over(w))
    by = Window.partitionBy("symbol", "block").orderBy("timestamp")
    growth = F.coalesce(F.try_divide(F.col("_after"), F.first("_next").over(by)), F.last(F.try_divide(F.col("_next"), F.first("_next").over(by)), ignorenulls=True).over(by), F.lit(1.0))
    first = F.row_number().over(by) == 1
    change = F.when(first, F.abs(F.col("weight") - F.lag("weight", 1, 0.0).over(w))).otherwise(0.0)
    rows = rows.select("timestamp", "symbol", "block", "weight", growth.alias("_growth"), change.alias("_change"))
    day = rows.groupBy("timestamp", "block").agg((1 - F.sum("weight") + F.sum(F.col("weight") * F.col("_growth"))).alias("_value"), (F.sum("_change") * (bps / 1e4)).alias("_cost"))
    block = Window.partitionBy("block").orderBy("timestamp")
    before = F.lag("_value", 1, 1.0).over(block)
    return day.select("timestamp", (F.col("_value") / before - 1 - F.col("_cost")).alias("daily_return"), "block")


def session_flat_returns(bars: DataFrame, targets: DataFrame, bps: float = 2.0) -> DataFrame:
    """(session, timestamp, bar_return, gross_exposure, turnover) of intraday targets that end each session flat.

    bars: (symbol, session, timestamp, open, close); targets: (timestamp, symbol, target_weight). A weight decided at a
    bar is bought at the next open of its session and earns to the open after that; in the session's last bar it is
    sold at the close. What is decided at the last bar is not traded. Cost is paid on every change, the last sale too.
    """
    w = Window.partitionBy("symbol", "session").orderBy("timestamp")
    rows = bars.join(targets.select("timestamp", "symbol", "target_weight"), ["timestamp", "symbol"], "left")
    held = F.coalesce(F.lag(F.coalesce("target_weight", F.lit(0.0))).over(w), F.lit(0.0))
    last = F.lead("open").over(w).isNull()
    rows = rows.select("symbol", "session", "timestamp", held.alias("_w"), F.when(last, F.col("close")).otherwise(F.lead("open").over(w)).alias("_out"), "open", last.alias("_last"))
    change = F.abs(F.col("_w") - F.lag("_w", 1, 0.0).over(w)) + F.when(F.col("_last"), F.abs("_w")).otherwise(0.0)
    rows = rows.select("session", "timestamp", "_w", F.try_divide("_out", "open").alias("_g"), change.alias("_c"))
    earned = F.sum(F.col("_w") * (F.coalesce("_g", F.lit(1.0)) - 1))
    return rows.groupBy("session", "timestamp").agg((earned - F.sum("_c") * (bps / 1e4)).alias("bar_return"), F.sum(F.abs("_w")).alias("gross_exposure"), F.sum("_c").alias("turnover"))


def session_returns(bar_returns: DataFrame) -> DataFrame:
    """(session, daily_return, turnover): the bar returns of each session compounded."""
    return bar_returns.groupBy("session").agg((F.exp(F.sum(F.log1p("bar_return"))) - 1).alias("daily_return"), F.sum("turnover").alias("turnover"))
