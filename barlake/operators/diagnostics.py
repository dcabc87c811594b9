"""Diagnostics of positions and sessions, regimes of curves, and exits forced by missing prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluate import by_period, equity_curve, metrics


def _skew(x: str, n: Column) -> Column:
    """The adjusted skewness of a sample; null for fewer than three."""
    n = n.cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def leave_out(positions: DataFrame, capital: float, key: str = "variant_id") -> DataFrame:
    """(key, unit, name, pnl, share, return_without, place): each position, symbol and session of a variant, best first.

    unit says which; share is that of the variant's P&L, return_without the rest of it over the capital. positions:
    (key, position, symbol, session, pnl). All three come from one pass over the positions.
    """
    unit = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("string").alias("name")) for u in ("position", "symbol", "session")])).alias("u")
    g = positions.select(key, "pnl", unit).groupBy(key, "u.unit", "u.name").agg(F.sum("pnl").alias("pnl"))
    total = F.sum("pnl").over(Window.partitionBy(key, "unit"))
    place = F.row_number().over(Window.partitionBy(key, "unit").orderBy(F.round("pnl", 6).desc(), "name"))
    return g.select(key, "unit", "name", "pnl", F.try_divide(F.col("pnl"), total).alias("share"), ((total - F.col("pnl")) / capital).alias("return_without"), place.alias("place"))


def position_report(positions: DataFrame, sessions: DataFrame, capital: float, lags: tuple[int, ...] = (1, 2, 3), top: int = 3, key: str = "variant_id") -> DataFrame:
    """One row a variant: counts, win rate, shares of the best positions and symbols, the return without them, skews, activity, and correlations of sessions with earlier ones.

    positions: (key, position, symbol, session, pnl, gross_notional); sessions: (session), all that count, those without a
    position having a return of zero. Returns of sessions are P&L over the capital, of positions P&L over half of what
    was traded. Skews are adjusted; that of sessions is over those with a return. A correlation with no deviation is null.
    """
    units = leave_out(positions, capital, key)
    share = lambda u, k: F.sum(F.when((F.col("unit") == u) & (F.col("place") <= k), F.col("share")))
    gain = lambda u, k: F.sum(F.when((F.col("unit") == u) & (F.col("place") <= k), F.col("pnl")))
    all_ = F.sum(F.when(F.col("unit") == "symbol", F.col("pnl")))
    best = units.groupBy(key).agg(
        share("position", 1).alias("top_position_share"), share("position", top).alias("top_positions_share"), share("symbol", top).alias("top_symbols_share"),
        ((all_ - gain("position", top)) / capital).alias("return_without_positions"), ((all_ - gain("symbol", top)) / capital).alias("return_without_symbols"),
    )
    n = F.count(F.lit(1))
    own = positions.withColumn("_r", F.try_divide(F.col("pnl"), F.col("gross_notional") / 2)).groupBy(key).agg(
        n.alias("positions"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), _skew("_r", F.count("_r")).alias("position_skew"), (F.sum("pnl") / capital).alias("total_return")
    )
    pnl = positions.groupBy(key, "session").agg(F.sum("pnl").alias("pnl"))
    grid = positions.select(key).distinct().crossJoin(sessions.select("session").distinct())  # a calendar for each variant
    days = grid.join(pnl, [key, "session"], "left").select(key, "session", (F.coalesce("pnl", F.lit(0.0)) / capital).alias("_d"))
    w = Window.partitionBy(key).orderBy("session")
    days = days.select("*", *[F.lag("_d", k).over(w).alias(f"_l{k}") for k in lags]).withColumn("_a", F.when(F.abs("_d") > 1e-12, F.col("_d")))
    series = days.groupBy(key).agg(
        n.alias("sessions"), F.count("_a").alias("active_sessions"), F.avg(F.col("_a").isNotNull().cast("double")).alias("active_rate"), _skew("_a", F.count("_a")).alias("active_skew"),
        *[F.try_divide(F.covar_pop("_d", f"_l{k}"), F.stddev_pop(F.when(F.col(f"_l{k}").isNotNull(), F.col("_d"))) * F.stddev_pop(f"_l{k}")).alias(f"autocorrelation_{k}") for k in lags],
    )
    return own.join(best, key).join(series, key)


def regime_table(returns: DataFrame, regimes: DataFrame, keys: tuple[str, ...] = ("variant_id",)) -> DataFrame:
    """The metrics of each stream within each named range (name, start, end), equity starting anew; ranges may overlap."""
    rows = by_period(returns, regimes).withColumnRenamed("name", "regime")
    own = (*keys, "regime")
    return metrics(equity_curve(rows, own), own)


def walk_forward(returns: DataFrame, train_years: int = 3, drawdown: float = 0.25, turnover: float = 0.01, key: str = "variant_id") -> DataFrame:
    """(year, key, objective, train_sharpe, train_max_drawdown, test_return, test_sharpe, test_max_drawdown) of each year's choice.

    The choice has the best Sharpe - drawdown * |drawdown| - turnover * annual turnover over the years before. returns:
    (timestamp, key, daily_return, turnover). Years without train_years of history before them are left out.
    """
    rows = returns.withColumn("_y", F.year("timestamp"))
    first = Window.partitionBy()
    years = rows.select(F.col("_y").alias("year")).distinct().withColumn("_first", F.min("year").over(first)).where(F.col("year") - train_years >= F.col("_first")).drop("_first")  # a row a year
    years = years.withColumn("_y", F.explode(F.sequence(F.col("year") - train_years, F.col("year") - 1)))
    m = metrics(equity_curve(rows.join(years, "_y"), (key, "year")), (key, "year"))
    objective = F.col("sharpe") - drawdown * F.abs("max_drawdown") - turnover * F.col("annual_turnover")
    best = Window.partitionBy("year").orderBy(F.round("objective", 9).desc(), key)
    chosen = m.withColumn("objective", objective).withColumn("_k", F.row_number().over(best)).where("_k = 1")
    chosen = chosen.select("year", key, "objective", F.col("sharpe").alias("train_sharpe"), F.col("max_drawdown").alias("train_max_drawdown"))
    test = rows.withColumnRenamed("_y", "year").join(chosen.select("year", key), ["year", key])
    t = metrics(equity_curve(test, (key, "year")), (key, "year")).select(key, "year", F.col("total_return").alias("test_return"), F.col("sharpe").alias("test_sharpe"), F.col("max_drawdown").alias("test_max_drawdown"))
    return chosen.join(t, [key, "year"])


#: Fixed value: the reason of an exit that a missing price forces.
MISSING = "missing_price_forced_exit"


def forced_exits(panel: DataFrame, weights: DataFrame, sessions: int, haircut: float) -> DataFrame:
    """weights (timestamp, symbol, weight) with what missing prices force: side, exit_price, exit_return and exit_reason.

    A name held whose close has been missing for `sessions` rows of the panel (timestamp, symbol, close) leaves there, at
    its last close less the haircut when long, plus it when short; exit_return is what that costs the portfolio. From the
    exit until it has a close again its weight is 0. Other rows have nulls there.
    """
    w = Window.partitionBy("symbol").orderBy("timestamp")
    rows = panel.select("timestamp", "symbol", "close", F.row_number().over(w).alias("_n"))
    rows = rows.withColumn("_seen", F.max(F.when(F.col("close").isNotNull(), F.col("_n"))).over(w)).withColumn("_last", F.last("close", ignorenulls=True).over(w))
    rows = rows.withColumn("_gap", F.when(F.col("close").isNull(), F.col("_n") - F.col("_seen")))
    both = weights.join(rows.select("timestamp", "symbol", "_gap", "_last"), ["timestamp", "symbol"], "left")
    out = (F.col("_gap") == sessions) & (F.col("weight") != 0)
    short = F.col("weight") < 0
    gone = F.coalesce(F.col("_gap") >= sessions, F.lit(False))
    return both.select(
        "timestamp", "symbol", F.when(gone, 0.0).otherwise(F.col("weight")).alias("weight"), F.when(out, F.when(short, "buy").otherwise("sell")).alias("side"),
        F.when(out, F.col("_last") * F.when(short, 1 + haircut).otherwise(1 - haircut)).alias("exit_price"), F.when(out, -F.abs("weight") * haircut).alias("exit_return"), F.when(out, F.lit(MISSING)).alias("exit_reason"),
    )
