"""Features over a panel of (timestamp, symbol) rows with close, r (its return) and, where named, benchmark columns.

Each is a column with the usual windows as defaults; windows count rows of the panel and are null unless full.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import factors as X

YEAR = 252.0


def annual(sd: Column) -> Column:
    return sd * F.sqrt(F.lit(YEAR))


def annual_volatility(r: str = "r", n: int = 60) -> Column:
    return annual(X.ts_std(r, n))


def downside_volatility(r: str = "r", n: int = 60) -> Column:
    """Root of the mean squared loss, a gain counting as 0."""
    return annual(F.sqrt(X.ts_mean(F.pow(X.lesser(r, F.lit(0.0)), 2), n)))


def prior_volatility(r: str = "r", n: int = 20) -> Column:
    """Of the n returns before the current one, as a population."""
    return annual(X.ts_std_pop(X.ts_delay(r, 1), n))


def risk_adjusted_momentum(close: str = "close", r: str = "r", lookback: int = 126, volatility: int = 20) -> Column:
    return F.try_divide(X.ts_returns(close, lookback), annual_volatility(r, volatility))


def trend_strength(close: str = "close", r: str = "r", fast: int = 50, slow: int = 200, lookback: int = 126, volatility: int = 20) -> Column:
    """Score of a rising name; null unless the fast mean and the close are above the slow mean and momentum is positive."""
    up, down, move = X.ts_mean(close, fast), X.ts_mean(close, slow), X.ts_returns(close, lookback)
    score = F.try_divide(F.try_divide(up, down) - 1 + move, X.ts_std(r, volatility))
    return F.when((up > down) & (F.col(close) > down) & (move > 0), score)


def short_reversal(close: str = "close", r: str = "r", lookback: int = 5, slow: int = 100, volatility: int = 20) -> Column:
    """Score of a fall within a rising trend; null unless the return is negative and the close above its slow mean."""
    move = X.ts_returns(close, lookback)
    return F.when((move < 0) & (F.col(close) > X.ts_mean(close, slow)), -F.try_divide(move, X.ts_std(r, volatility)))


def skip_return(close: str = "close", lookback: int = 252, skip: int = 21) -> Column:
    return F.try_divide(X.ts_delay(close, skip), X.ts_delay(close, lookback)) - 1


def skip_momentum(close: str = "close", r: str = "r", lookback: int = 252, skip: int = 21, fast: int = 50, slow: int = 200, volatility: int = 60) -> Column:
    """Momentum without the last `skip` rows over volatility; null unless positive, above the slow mean, fast above slow."""
    move, up, down = skip_return(close, lookback, skip), X.ts_mean(close, fast), X.ts_mean(close, slow)
    return F.when((move > 0) & (F.col(close) > down) & (up > down), F.try_divide(move, X.ts_std(r, volatility)))


def scaled_trend(close: str = "close", r: str = "r", slow: int = 200, volatility: int = 60) -> Column:
    return F.try_divide(F.try_divide(F.col(close), X.ts_mean(close, slow)) - 1, annual_volatility(r, volatility))


def residual_return(r: str, factors: Iterable[str], n: int = 126) -> Column:
    """r less the part that each factor column explains by its own rolling beta; the betas are those of r itself."""
    out = F.col(r)
    for f in factors:
        out = out - X.ts_beta(r, f, n) * F.col(f)
    return out


def log_residual(residual: str) -> Column:
    return F.when(F.col(residual).isNotNull(), F.log1p(F.greatest(F.col(residual), F.lit(-0.999999))))


def residual_momentum(logs: str, lookback: int = 252, skip: int = 21) -> Column:
    """Sum of a column of log residual returns over the rows from `lookback` to `skip` ago."""
    w = X.series().rowsBetween(1 - lookback, -skip)
    return F.when(F.count(logs).over(w) == lookback - skip, F.sum(logs).over(w))


def composite(panel: DataFrame, parts: dict[str, float], name: str, p: float = 0.05, fill: bool = False) -> DataFrame:
    """panel with `name`: the weighted sum of the parts' winsorised z-scores; a null part makes it null, or 0 with fill.

    All parts are clipped in one select and scaled in the next, so the whole costs one shuffle by timestamp.
    """
    clipped = panel.select("*", *[X.cs_winsor(c, p).alias(f"_w_{c}") for c in parts])
    total = sum((F.lit(float(w)) * X.cs_zscore(f"_w_{c}") for c, w in parts.items()), F.lit(0.0))
    out = clipped.withColumn(name, F.coalesce(total, F.lit(0.0)) if fill else total)
    return out.drop(*[f"_w_{c}" for c in parts])


#: Parts of the composite scores and their weights or signs.
PRICE_PARTS = {"residual_long": 0.50, "residual_medium": 0.25, "trend": 0.15, "downside": -0.10}
QUALITY_PARTS = {"gross_profitability": 0.2, "cash_profitability": 0.2, "accruals": -0.2, "leverage": -0.2, "share_growth": -0.2}
EARNINGS_PARTS = {"revenue_growth": 0.5, "earnings_growth": 0.5}


def fundamental_scores(panel: DataFrame, fill: bool = True) -> DataFrame:
    """panel with quality_score and earnings_score: means of signed z-scores, growth clipped to +-5.

    A score with a null part is 0, or without fill null, as it must be where scores are shown or ranked and not summed.
    """
    clipped = panel.withColumns({c: X.clip(c, -5.0, 5.0) for c in EARNINGS_PARTS})
    return composite(composite(clipped, QUALITY_PARTS, "quality_score", fill=fill), EARNINGS_PARTS, "earnings_score", fill=fill)


def eligible(member: Column, momentum: str, close: str, fast: str, slow: str, volatility: str, score: str, benchmark: str, most: float = 0.60) -> Column:
    """Members other than the benchmark that rise, are above their means and not too volatile, and have a score."""
    ok = member & (F.col("symbol") != benchmark) & (F.col(momentum) > 0) & (F.col(close) > F.col(slow)) & (F.col(fast) > F.col(slow))
    return F.coalesce(ok & (F.col(volatility) <= most) & F.col(score).isNotNull(), F.lit(False))


def regime_exposure(up: Column, breadth: Column, threshold: float = 0.5, both: float = 1.0, one: float = 0.75, none: float = 0.25) -> Column:
    """Gross exposure by whether the benchmark is above its mean and whether enough names are."""
    n = F.coalesce(up, F.lit(False)).cast("int") + F.coalesce(breadth >= threshold, F.lit(False)).cast("int")
    return F.when(n == 2, both).when(n == 1, one).otherwise(none)


def exposure_overlay(benchmark: DataFrame, close: str = "close", trend: int = 200, volatility: int = 20, target: float = 0.15, least: float = 0.5, bear_core: float = 0.5, bear_active: float = 0.5) -> DataFrame:
    """(timestamp, core_multiplier, active_multiplier) of a benchmark's rows (timestamp, symbol, close).

    The core is scaled to a target volatility within [least, 1], 1 before there is one; below its mean core and active
    part shrink further. Where there is no mean yet the trend counts as up.
    """
    rows = benchmark.select("timestamp", "symbol", F.col(close).alias("_c"), X.ts_returns(close, 1).alias("_r"))
    sd = annual(X.ts_std_pop("_r", volatility))
    scale = F.coalesce(F.least(F.greatest(F.try_divide(F.lit(target), sd), F.lit(least)), F.lit(1.0)), F.lit(1.0))
    rows = rows.select("timestamp", F.when(sd > 0, scale).otherwise(1.0).alias("_scale"), F.coalesce(F.col("_c") >= X.ts_mean("_c", trend), F.lit(True)).alias("_up"))
    return rows.select("timestamp", (F.col("_scale") * F.when(F.col("_up"), 1.0).otherwise(bear_core)).alias("core_multiplier"), F.when(F.col("_up"), 1.0).otherwise(bear_active).alias("active_multiplier"))
