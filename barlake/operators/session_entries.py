"""Once-daily entries and books of a session, judged by returns relative to the benchmark.

Bars are (symbol, session, timestamp = bar end, open, high, low, close, volume); clocks are local minutes of a bar's end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .confirmed import relative_return
from .intraday import clock, in_session, session_vwap


@dataclass(frozen=True)
class Entry:
    """When and on what a session's entries are made."""

    signal: int = 630
    flat: int = 945
    lookback: int = 2
    threshold: float = 0.006
    top_n: int = 8
    cap: float = 0.1
    gross: float = 0.8
    min_dollars: float = 1_000_000.0
    recovery: bool = False
    market: bool = True
    continuation: bool = False


def daily_entries(bars: DataFrame, rule: Entry, benchmark: str) -> DataFrame:
    """(timestamp, symbol, target_weight, score) of the names entered at the signal bar, from it to the flat bar, which has 0.

    For reversal a name must have fallen, relative to the benchmark over lookback bars of the session, by the threshold and
    be at or under its VWAP, for continuation risen and be at or over it; its bar must have traded min_dollars. With
    recovery its last bar must have risen; with market the benchmark must be at or over its own VWAP, else the session has
    no entries. The top_n strongest share the gross exposure, each up to cap. Scores are those of each bar.
    """
    w = in_session()
    sign = 1.0 if rule.continuation else -1.0
    rows = session_vwap(relative_return(bars, rule.lookback, benchmark)).withColumn("clock", clock()).withColumn("score", sign * F.col("relative"))
    rows = rows.withColumn("_step", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    at = rows.where(F.col("clock") == rule.signal)
    side = F.col("close") >= F.col("vwap") if rule.continuation else F.col("close") <= F.col("vwap")
    ok = (F.col("symbol") != benchmark) & (F.col("score") >= rule.threshold) & side & (F.col("close") * F.col("volume") >= rule.min_dollars)
    chosen = at.where(ok & (F.col("_step") > 0) if rule.recovery else ok)
    if rule.market:
        chosen = chosen.join(at.where((F.col("symbol") == benchmark) & (F.col("close") >= F.col("vwap"))).select("session"), "session", "left_semi")
    k = F.row_number().over(Window.partitionBy("session").orderBy(F.round("score", 9).desc(), "symbol"))
    chosen = chosen.withColumn("_k", k).where(F.col("_k") <= rule.top_n)
    weight = F.least(F.lit(rule.cap), rule.gross / F.count(F.lit(1)).over(Window.partitionBy("session")))
    later = rows.where(F.col("clock").between(rule.signal, rule.flat)).join(chosen.select("symbol", "session", weight.alias("_w")), ["symbol", "session"])
    return later.select("timestamp", "symbol", F.when(F.col("clock") < rule.flat, F.col("_w")).otherwise(0.0).alias("target_weight"), "score")


@dataclass(frozen=True)
class Book:
    signal: int = 630
    flat: int = 945
    lookback: int = 2
    per_side: int = 4
    cap: float = 0.1
    gross: float = 0.8
    min_dollars: float = 1_000_000.0
    min_score: float = 0.0
    momentum: bool = True


def ranked_book(bars: DataFrame, rule: Book, benchmark: str, members: DataFrame | None = None) -> DataFrame:
    """(timestamp, symbol, target_weight, score): the strongest against the weakest names of the signal bar, min(per_side, half).

    Names count that are members (session, symbol) where given, have traded min_dollars in the session so far and have a
    relative return of min_score at least, either way; two are needed. Momentum holds the strongest long and the weakest
    short, reversal the other way round. Weights last from the signal bar to the flat one, which has a row of 0.
    """
    rows = relative_return(bars, rule.lookback, benchmark).withColumn("clock", clock()).withColumnRenamed("relative", "score")
    rows = rows.withColumn("_dollars", F.sum(F.col("close") * F.col("volume")).over(in_session()))
    at = rows.where((F.col("clock") == rule.signal) & (F.col("symbol") != benchmark) & F.col("score").isNotNull() & (F.col("_dollars") >= rule.min_dollars) & (F.abs("score") >= rule.min_score))
    if members is not None:
        at = at.join(members.select("session", "symbol"), ["session", "symbol"], "left_semi")
    w = Window.partitionBy("session")
    score = F.round("score", 9)
    at = at.withColumn("_side", F.least(F.lit(rule.per_side), F.floor(F.count(F.lit(1)).over(w) / 2)))
    at = at.withColumn("_hi", F.row_number().over(w.orderBy(score.desc(), "symbol"))).withColumn("_lo", F.row_number().over(w.orderBy(score, F.col("symbol").desc())))
    long = 1.0 if rule.momentum else -1.0
    sign = F.when(F.col("_hi") <= F.col("_side"), long).when(F.col("_lo") <= F.col("_side"), -long)
    chosen = at.withColumn("_sign", sign).where("_sign is not null")
    weight = F.col("_sign") * F.least(F.lit(rule.cap), rule.gross / F.count(F.lit(1)).over(w))
    later = rows.where(F.col("clock").between(rule.signal, rule.flat)).join(chosen.select("symbol", "session", weight.alias("_w")), ["symbol", "session"])
    return later.select("timestamp", "symbol", F.when(F.col("clock") < rule.flat, F.col("_w")).otherwise(0.0).alias("target_weight"), "score")
