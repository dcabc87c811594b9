"""Intraday signals that a later bar confirms, with the features they are judged by.

Bars are (symbol, session, timestamp = bar end, open, high, low, close, volume); clocks are local minutes of a bar's end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlake.functions.factors import ts_mean, ts_median, ts_std_pop

from .intraday import clock, in_session, session_vwap
from .portfolio import trailing_pairs


def _by_session() -> Window:
    return Window.partitionBy("symbol").orderBy("session")


def session_closes(bars: DataFrame, trend: int = 0, volatility: int = 0) -> DataFrame:
    """(symbol, session, prior_close, prior_return[, trend_average][, daily_volatility]) from the sessions before.

    Averages and deviations (annual, of a population) are those of the prior closes and their returns and need full windows.
    """
    w = _by_session()
    day = bars.groupBy("symbol", "session").agg(F.max_by("close", "timestamp").alias("_c"))
    day = day.withColumn("prior_close", F.lag("_c").over(w)).withColumn("prior_return", F.try_divide(F.lag("_c").over(w), F.lag("_c", 2).over(w)) - 1).drop("_c")
    if trend:
        day = day.withColumn("trend_average", ts_mean("prior_close", trend, w))
    if volatility:
        day = day.withColumn("daily_volatility", ts_std_pop("prior_return", volatility, w) * F.sqrt(F.lit(252.0)))
    return day


def relative_return(bars: DataFrame, k: int, benchmark: str) -> DataFrame:
    """bars with `horizon`, the return over k bars of the session, and `relative`, that less the benchmark's."""
    rows = bars.withColumn("horizon", F.try_divide(F.col("close"), F.lag("close", k).over(in_session())) - 1)
    market = rows.where(F.col("symbol") == benchmark).select("timestamp", F.col("horizon").alias("_b"))
    return rows.join(market, "timestamp", "left").withColumn("relative", F.col("horizon") - F.col("_b")).drop("_b")


def same_clock(signals: DataFrame, volume: int = 0, sigma: int = 0) -> DataFrame:
    """One row a session and symbol, with relative_volume and dislocation_sigma against the sessions before at this clock.

    relative_volume is over the median of the prior `volume` ones, dislocation_sigma is -relative over the population
    deviation of the prior `sigma` ones; both need full windows.
    """
    w = _by_session()
    out = signals
    if volume:
        out = out.withColumn("_v", F.lag("volume").over(w)).withColumn("relative_volume", F.try_divide("volume", ts_median("_v", volume, w))).drop("_v")
    if sigma:
        out = out.withColumn("_d", F.lag(-F.col("relative")).over(w)).withColumn("dislocation_sigma", F.try_divide(-F.col("relative"), ts_std_pop("_d", sigma, w))).drop("_d")
    return out


def market_breadth(bars: DataFrame, at: int, benchmark: str) -> DataFrame:
    """(session, breadth, market_up) at a clock: the share of names at or above their VWAP, and whether the benchmark is."""
    rows = bars.where(F.col("clock") == at)
    above = (F.col("close") >= F.col("vwap")).cast("double")
    name = F.col("symbol") != benchmark
    return rows.groupBy("session").agg(F.avg(F.when(name, F.coalesce(above, F.lit(0.0)))).alias("breadth"), F.coalesce(F.max(F.when(~name, above)) > 0, F.lit(False)).alias("market_up"))


@dataclass(frozen=True)
class Confirmed:
    """What a confirmed signal must meet. A window or limit of 0 is not tested."""

    signal: int = 630
    confirmation_bars: int = 1
    entry_delay_bars: int = 0
    flat: int = 945
    bar_minutes: int = 15
    lookback: int = 4
    dislocation: float = 0.006
    dollar_volume: float = 0.0
    top_n: int = 3
    cap: float = 0.10
    gross: float = 0.30
    short: bool = True
    market_up: bool = False
    confirm_above_vwap: bool = False
    confirm_break: float = 0.0
    below_prior_close: bool = False
    trend_sessions: int = 0
    volume_sessions: int = 0
    volume_least: float = 0.0
    volume_most: float = 0.0
    sigma_sessions: int = 0
    sigma_least: float = 0.0
    volatility_sessions: int = 0
    volatility_most: float = 0.0
    breadth: float = 0.0
    correlation_sessions: int = 0
    correlation_most: float = 1.0


#: A fall that goes on: short after a break of the signal bar's low, with the usual further filters.
PRESETS = {
    "reversal": Confirmed(short=False),
    "continuation": Confirmed(),
    "trend": Confirmed(trend_sessions=20, below_prior_close=True),
    "volume_surge": Confirmed(volume_sessions=20, volume_least=1.5),
    "sigma": Confirmed(sigma_sessions=20, sigma_least=1.5),
    "quiet_break": Confirmed(volume_sessions=20, volume_most=1.5, confirm_break=0.001),
    "stable_breadth": Confirmed(volatility_sessions=20, volatility_most=0.8, breadth=0.4, correlation_sessions=60, correlation_most=0.7),
}


def confirmed_candidates(bars: DataFrame, rule: Confirmed, benchmark: str) -> DataFrame:
    """(session, symbol, score) of the names that fell by the signal bar and were confirmed by a later one.

    A fall is measured against the benchmark over `lookback` bars. It is confirmed for a short if the later close is
    under the signal bar's low less the break, otherwise (a reversal) if it is over the signal bar's high.
    """
    rows = session_vwap(relative_return(bars, rule.lookback, benchmark)).withColumn("clock", clock())
    at = rows.where((F.col("clock") == rule.signal) & (F.col("symbol") != benchmark))
    at = same_clock(at, rule.volume_sessions, rule.sigma_sessions)
    if rule.trend_sessions or rule.volatility_sessions or rule.below_prior_close:
        at = at.join(session_closes(bars, rule.trend_sessions, rule.volatility_sessions), ["symbol", "session"])
    tests: list[Column] = [F.round(-F.col("relative"), 9) >= rule.dislocation, F.col("close") * F.col("volume") >= rule.dollar_volume, F.col("close") <= F.col("vwap")]
    if rule.trend_sessions:
        tests.append(F.col("prior_close") < F.col("trend_average"))
    if rule.below_prior_close:
        tests.append(F.col("close") < F.col("prior_close"))
    if rule.volume_sessions:
        tests.append(F.col("relative_volume") >= rule.volume_least)
        if rule.volume_most:
            tests.append(F.col("relative_volume") <= rule.volume_most)
    if rule.sigma_sessions:
        tests.append(F.col("dislocation_sigma") >= rule.sigma_least)
    if rule.volatility_sessions and rule.volatility_most:
        tests.append(F.col("daily_volatility") <= rule.volatility_most)
    for t in tests:
        at = at.where(t)
    score = F.col("dislocation_sigma") if rule.sigma_sessions else -F.col("relative")
    at = at.select("session", "symbol", F.round(score, 9).alias("score"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    when = rule.signal + rule.confirmation_bars * rule.bar_minutes
    later = rows.where(F.col("clock") == when).select("session", "symbol", "close", "vwap")
    ok = F.col("close") < F.col("_low") * (1 - rule.confirm_break) if rule.short else F.col("close") > F.col("_high")
    if rule.confirm_above_vwap:
        ok = ok & (F.col("close") >= F.col("vwap"))
    found = at.join(later, ["session", "symbol"]).where(ok)
    if rule.market_up or rule.breadth:
        market = market_breadth(rows, when, benchmark)
        market = market.where("market_up") if rule.market_up else market
        market = market.where(F.col("breadth") >= rule.breadth) if rule.breadth else market
        found = found.join(market.select("session"), "session", "left_semi")
    return found.select("session", "symbol", "score")


def diversified_pick(candidates: DataFrame, bars: DataFrame, n: int, sessions: int, most: float) -> DataFrame:
    """Of each session's candidates (session, symbol, score), walked by score, the first n that do not correlate above
    `most` with one picked before; by the returns of the `sessions` sessions up to the prior one, a missing correlation passes.

    Sessions are independent of each other, and only pairs above the limit reach the function that walks one.
    """
    import pandas as pd

    history = session_closes(bars).select(F.col("session").alias("timestamp"), "symbol", "prior_return")
    pairs = trailing_pairs(history, candidates.select(F.col("session").alias("timestamp"), "symbol"), "prior_return", sessions, 2)
    close = pairs.where((F.col("corr") > most) & (F.col("a") < F.col("b"))).select("timestamp", "a", "b")
    both = close.select(F.col("timestamp").alias("session"), F.col("a").alias("symbol"), F.col("b").alias("other")).union(close.select("timestamp", "b", "a"))
    rows = candidates.join(both.groupBy("session", "symbol").agg(F.collect_list("other").alias("rivals")), ["session", "symbol"], "left")

    def walk(day: pd.DataFrame) -> pd.DataFrame:
        picked: list[str] = []
        for r in day.sort_values(["score", "symbol"], ascending=[False, True]).itertuples():
            if len(picked) < n and not (r.rivals is not None and any(x in picked for x in r.rivals)):
                picked.append(r.symbol)
        return day[day["symbol"].isin(picked)][["session", "symbol", "score"]]

    kinds = dict(candidates.dtypes)
    return rows.groupBy("session").applyInPandas(walk, f"session {kinds['session']}, symbol string, score double")


def confirmed_targets(bars: DataFrame, rule: Confirmed, benchmark: str) -> DataFrame:
    """(timestamp, symbol, target_weight, score) from the entry bar on, 0 from the flat bar on; shorts are negative."""
    found = confirmed_candidates(bars, rule, benchmark)
    if rule.correlation_sessions:
        chosen = diversified_pick(found, bars, rule.top_n, rule.correlation_sessions, rule.correlation_most)
    else:
        k = F.row_number().over(Window.partitionBy("session").orderBy(F.col("score").desc(), "symbol"))
        chosen = found.withColumn("_k", k).where(F.col("_k") <= rule.top_n).drop("_k")
    size = F.least(F.lit(rule.cap), rule.gross / F.count(F.lit(1)).over(Window.partitionBy("session")))
    chosen = chosen.withColumn("_w", size * (-1.0 if rule.short else 1.0))
    entry = rule.signal + (rule.confirmation_bars + rule.entry_delay_bars) * rule.bar_minutes
    rows = bars.select("timestamp", "symbol", "session", clock().alias("_clock")).where(F.col("_clock") >= entry)
    return rows.join(chosen, ["session", "symbol"]).select("timestamp", "symbol", F.when(F.col("_clock") < rule.flat, F.col("_w")).otherwise(0.0).alias("target_weight"), "score")


def rotating_selection(ranked: DataFrame, n: int, exit_rank: int, every: int, first: int, last: int, flat: int, cap: float, gross: float = 1.0) -> DataFrame:
    """(variant_id, session, timestamp, symbol, target_weight) of an intraday selection that rotates within the session.

    ranked: (variant_id, session, timestamp, clock, symbol, rank, market_up), rank null where a name may not be
    entered. From `first` to `last`, and only if the market is up where nothing is held, names are chosen anew
    every `every` bars: those held that rank within exit_rank, then the best. What is chosen stays until `flat`. Each
    session is a group of its own.
    """
    import pandas as pd

    def fold(day: pd.DataFrame) -> pd.DataFrame:
        held: list[str] = []
        since, out = every, []
        for when, bar in day.sort_values(["timestamp", "rank", "symbol"]).groupby("timestamp", sort=True):
            at = bar["clock"].iloc[0]
            if at >= flat or at < first:
                held, since = [], every
            elif at <= last and (held or bar["market_up"].iloc[0]):
                since += 1 if held else 0
                if not held or since >= every:
                    order = list(bar[bar["rank"].notna()].sort_values(["rank", "symbol"])["symbol"])
                    kept = [s for s in held if s in order[:exit_rank]]
                    held, since = (kept + [s for s in order if s not in kept])[:n], 0
            out += [(day["variant_id"].iloc[0], day["session"].iloc[0], when, s, min(cap, gross / len(held))) for s in held]
        return pd.DataFrame(out, columns=["variant_id", "session", "timestamp", "symbol", "target_weight"])

    kinds = dict(ranked.dtypes)
    schema = f"variant_id {kinds['variant_id']}, session {kinds['session']}, timestamp {kinds['timestamp']}, symbol string, target_weight double"
    return ranked.groupBy("variant_id", "session").applyInPandas(fold, schema)
