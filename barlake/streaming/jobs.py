"""Structured Streaming jobs: bars from ticks and a ledger of quote fills."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(ticks: DataFrame, minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of (timestamp, symbol, price, volume), labelled by their end.

    A bar leaves when the watermark has passed its end, so unfinished buckets are withheld; repeated ticks within the
    watermark count once. 60-minute bars start at half past, like the market.
    """
    start = "30 minutes" if minutes == 60 else "0 minutes"
    once = ticks.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["timestamp", "symbol"])
    bucket = F.window("timestamp", f"{minutes} minutes", f"{minutes} minutes", start)
    return once.groupBy(bucket.alias("w"), "symbol").agg(
        F.min_by("price", "timestamp").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "timestamp").alias("close"), F.sum("volume").alias("volume")
    ).select(F.col("w.end").alias("timestamp"), "symbol", "open", "high", "low", "close", "volume")


FILLS = "symbol string, timestamp timestamp, event string, price double, pnl double"


def track_fills(quotes: DataFrame) -> DataFrame:
    """Events of pending short targets meeting the next quote: entry, exit, blocked_entry.

    quotes: (symbol, timestamp, bid, ask, target, shortable). A target set with one quote acts on the next one of its
    symbol: below zero it sells at the bid (or is blocked where shares cannot be borrowed), back at zero it buys at
    the ask. The state is position, entry price and pending target; a timestamp seen before does nothing.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, entry, pending, last = state.get if state.exists else (0.0, 0.0, 0.0, 0)
        rows = pd.concat(list(parts)).sort_values("timestamp")
        out = []
        for q in rows.itertuples():
            at = q.timestamp.value
            if at <= last:
                continue
            if pending < 0 and held == 0:
                if q.shortable:
                    held, entry = pending, q.bid
                    out.append((key[0], q.timestamp, "entry", q.bid, 0.0))
                else:
                    out.append((key[0], q.timestamp, "blocked_entry", q.bid, 0.0))
            elif pending == 0 and held < 0:
                out.append((key[0], q.timestamp, "exit", q.ask, held * (q.ask - entry)))
                held, entry = 0.0, 0.0
            pending, last = float(q.target), at
        state.update((held, entry, pending, last))
        yield pd.DataFrame(out, columns=["symbol", "timestamp", "event", "price", "pnl"])

    return quotes.groupBy("symbol").applyInPandasWithState(update, FILLS, "held double, entry double, pending double, last long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str) -> None:
    """Run a stream over what its source holds now, into Parquet files under path; a second run adds only what is new."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
