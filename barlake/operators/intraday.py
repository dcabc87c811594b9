"""Operators on intraday bars (symbol, session, timestamp = bar end, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlake.sources.bars import MARKET_ZONE


def in_session() -> Window:
    return Window.partitionBy("symbol", "session").orderBy("timestamp")


def clock(zone: str = MARKET_ZONE, time: str = "timestamp") -> Column:
    """Local minutes since midnight of a bar's end."""
    local = F.from_utc_timestamp(time, zone)
    return F.hour(local) * 60 + F.minute(local)


def session_attributes(bars: DataFrame) -> DataFrame:
    """First open of the session, close and return of the one before, gap, and the next open within the session."""
    w = in_session()
    day = bars.groupBy("symbol", "session").agg(F.min_by("open", "timestamp").alias("first_open"), F.max_by("close", "timestamp").alias("session_close"))
    by_day = Window.partitionBy("symbol").orderBy("session")
    day = day.withColumn("prior_close", F.lag("session_close").over(by_day)).withColumn("prior_return", F.try_divide("prior_close", F.lag("session_close", 2).over(by_day)) - 1)
    day = day.withColumn("gap", F.try_divide("first_open", "prior_close") - 1).drop("session_close")
    return bars.withColumn("next_open", F.lead("open").over(w)).join(day, ["symbol", "session"])


def session_vwap(bars: DataFrame) -> DataFrame:
    w = in_session()
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.withColumn("vwap", F.try_divide(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)))


def horizon_return(bars: DataFrame, k: int) -> DataFrame:
    """Return over k bars of the session."""
    return bars.withColumn("horizon", F.try_divide(F.col("close"), F.lag("close", k).over(in_session())) - 1)


def opening_efficiency(bars: DataFrame) -> DataFrame:
    """Return since the session's first open, and the net move over the sum of the moves from bar to bar."""
    w = in_session()
    first = F.first("open").over(w)
    step = F.abs(F.col("close") - F.coalesce(F.lag("close").over(w), F.col("open")))
    out = bars.withColumn("opening_return", F.try_divide(F.col("close"), first) - 1).withColumn("_step", step)
    return out.withColumn("efficiency", F.try_divide(F.abs(F.col("close") - first), F.sum("_step").over(w))).drop("_step")


def session_rollup(curve: DataFrame) -> DataFrame:
    """(session, equity, daily_return): the last equity of each session and its return on the one before."""
    day = curve.groupBy("session").agg(F.max_by("equity", "timestamp").alias("equity"))
    return day.withColumn("daily_return", F.try_divide(F.col("equity"), F.lag("equity").over(Window.orderBy("session"))) - 1)


def session_rollup_with_benchmark(curve: DataFrame) -> DataFrame:
    """(session, equity, daily_return, benchmark_return): as session_rollup, the first return being 0.

    curve: (session, timestamp, equity, benchmark_return); the benchmark's returns of a session's bars are compounded, a
    missing one counting as none.
    """
    grown = F.exp(F.sum(F.log1p(F.coalesce("benchmark_return", F.lit(0.0))))) - 1
    day = curve.groupBy("session").agg(F.max_by("equity", "timestamp").alias("equity"), grown.alias("benchmark_return"))
    before = F.lag("equity").over(Window.orderBy("session"))  # a row a session
    return day.select("session", "equity", F.coalesce(F.try_divide(F.col("equity"), before) - 1, F.lit(0.0)).alias("daily_return"), "benchmark_return")


def once_daily_reversal(bars: DataFrame, signal: int, flat: int, drop: float, n: int, cap: float, gross: float = 1.0, continuation: bool = False) -> DataFrame:
    """Longs, from the signal bar to the flat bar, on names that fell most by the signal, at or under their VWAP.

    With continuation, on those that rose most, at or over it. Minutes are local. A weight of 0 closes at `flat`.
    """
    rows = opening_efficiency(session_vwap(bars)).withColumn("clock", clock())
    at = rows.where(F.col("clock") == signal)
    if continuation:
        at = at.where((F.col("opening_return") >= drop) & (F.col("close") >= F.col("vwap"))).withColumn("score", F.col("opening_return"))
    else:
        at = at.where((F.col("opening_return") <= -drop) & (F.col("close") <= F.col("vwap"))).withColumn("score", -F.col("opening_return"))
    k = F.row_number().over(Window.partitionBy("session").orderBy(F.round("score", 9).desc(), "symbol"))
    chosen = at.withColumn("_k", k).where(F.col("_k") <= n)
    chosen = chosen.withColumn("weight", F.least(F.lit(cap), gross / F.count(F.lit(1)).over(Window.partitionBy("session")))).select("symbol", "session", "weight", "score")
    later = rows.where(F.col("clock").between(signal, flat)).join(chosen, ["symbol", "session"])
    return later.select("timestamp", "symbol", F.when(F.col("clock") < flat, F.col("weight")).otherwise(0.0).alias("target_weight"), "score")


def neutral_book(bars: DataFrame, signal: int, n: int, cap: float, gross: float = 1.0) -> DataFrame:
    """Equal longs on the names strongest since the open and shorts on the weakest, min(n, half of them) a side."""
    at = opening_efficiency(bars).withColumn("clock", clock()).where(F.col("clock") == signal)
    w = Window.partitionBy("session")
    score = F.round("opening_return", 9)
    at = at.withColumn("_side", F.least(F.lit(n), F.floor(F.count(F.lit(1)).over(w) / 2)))
    at = at.withColumn("_hi", F.row_number().over(w.orderBy(score.desc(), "symbol"))).withColumn("_lo", F.row_number().over(w.orderBy(score, F.col("symbol").desc())))
    sign = F.when(F.col("_hi") <= F.col("_side"), 1.0).when(F.col("_lo") <= F.col("_side"), -1.0)
    at = at.withColumn("_sign", sign).where("_sign is not null")
    return at.select("timestamp", "session", "symbol", (F.col("_sign") * F.least(F.lit(cap), gross / F.count(F.lit(1)).over(w))).alias("target_weight"), F.col("opening_return").alias("score"))


def leg_returns(bars: DataFrame, signals: DataFrame, flat: int, bps: float) -> DataFrame:
    """Return of each signal from the open after it to the open after `flat` (or that bar's close), both sides slipped."""
    w = in_session()
    rows = bars.withColumn("next_open", F.lead("open").over(w)).withColumn("clock", clock())
    entry = rows.select("timestamp", "symbol", "session", F.col("next_open").alias("entry"))
    exit_ = rows.where(F.col("clock") == flat).select("symbol", "session", F.coalesce("next_open", "close").alias("exit"))
    s = F.signum("target_weight")
    slip = F.lit(bps / 1e4)
    net = s * (F.col("exit") * (1 - s * slip) / (F.col("entry") * (1 + s * slip)) - 1)
    joined = signals.drop("session").join(entry, ["timestamp", "symbol"]).join(exit_, ["symbol", "session"])
    return joined.where("entry is not null").withColumn("leg_return", net)


def buffered_selection(ranked: DataFrame, n: int, exit_rank: int, per_sector: int | None = None) -> DataFrame:
    """(timestamp, symbol, target_weight) with incumbents kept while their rank is at most exit_rank.

    ranked: (variant_id, timestamp, symbol, rank, sector) on rebalance dates, ranks up to exit_rank at least. What is
    chosen depends on what is held, so dates are folded in order within a variant; variants run side by side.
    """
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held: list[str] = []
        out = []
        for when, day in rows.sort_values(["timestamp", "rank", "symbol"]).groupby("timestamp", sort=True):
            rank = dict(zip(day["symbol"], day["rank"], strict=True))
            sector = dict(zip(day["symbol"], day["sector"], strict=True))
            used: dict[str, int] = {}
            chosen: list[str] = []
            for name in [x for x in held if rank.get(x, exit_rank + 1) <= exit_rank] + list(day["symbol"]):
                if len(chosen) < n and name not in chosen and (per_sector is None or used.get(sector[name], 0) < per_sector):
                    chosen.append(name)
                    used[sector[name]] = used.get(sector[name], 0) + 1
            held = chosen
            out += [(rows["variant_id"].iloc[0], when, name, 1 / len(chosen)) for name in chosen]
        return pd.DataFrame(out, columns=["variant_id", "timestamp", "symbol", "target_weight"])

    kinds = dict(ranked.dtypes)
    return ranked.where(F.col("rank") <= exit_rank).groupBy("variant_id").applyInPandas(fold, f"variant_id {kinds['variant_id']}, timestamp {kinds['timestamp']}, symbol string, target_weight double")
