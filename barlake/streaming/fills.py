"""What the targets of one bar would have filled at the quotes of the next, as a stream of events.

State is kept by symbol: the position, its entry price, the pending target, the time of the last quote and when the next
one is due. A symbol that waits to leave its position and gets no quote in time has missed its exit; an event-time timer
says so where no later quote comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = {
    "symbol": "string", "observed_at": "long", "signal_timestamp": "long", "action": "string", "reason": "string", "target_weight": "double", "reference_price": "double", "bid": "double",
    "ask": "double", "spread_bps": "double", "limit_price": "double", "fill_price": "double", "quantity": "double", "notional": "double", "shortable": "boolean", "easy_to_borrow": "boolean",
    "borrow_status": "string", "pnl": "double", "return": "double",
}
_STATE = "quantity double, entry double, pending double, last long, due long"
_QUOTE = ["symbol", "at", "bid", "ask", "reference_price", "target_weight", "shortable", "easy_to_borrow", "borrow_status"]


def fill_events(quotes: DataFrame, capital: float = 100_000.0, offset_bps: float = 2.0, wait_minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """Events of short targets that meet the next quote of their symbol: entry, blocked_entry, exit, missed_exit.

    quotes: a stream of (symbol, timestamp, bid, ask, reference_price, target_weight, shortable, easy_to_borrow,
    borrow_status), a row for each symbol and bar; times count to the millisecond, and a time not after the last one of
    its symbol does nothing. A target acts on the next quote. Below zero and without a position it is an entry at the
    bid, for that share of the capital, if the symbol is easy to borrow and the limit, the reference price less the
    offset, is not above the bid; else a blocked_entry, for not_easy_to_borrow or limit_not_marketable. At or above
    zero, a position leaves at the ask if the limit, the reference price plus the offset, reaches it; else the exit is
    missed for limit_not_marketable. If no quote comes within wait_minutes it is missed for no_quote, and again after
    each further wait until one comes. spread_bps is null unless the ask is above a positive bid.
    """
    wait, offset = wait_minutes * 60_000, offset_bps / 10_000

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        quantity, entry, pending, last, due = state.get if state.exists else (0.0, 0.0, 0.0, -1, -1)
        out = []

        def unmet(before: int) -> None:
            nonlocal due
            while 0 <= due < before:
                out.append((key[0], due, last, "missed_exit", "no_quote", pending, 0.0, 0.0, 0.0, None, 0.0, 0.0, quantity, 0.0, False, False, "unknown", 0.0, 0.0))
                due += wait

        for q in () if state.hasTimedOut else pd.concat(list(parts)).sort_values("at").itertuples(index=False):
            if q.at <= last:
                continue
            unmet(q.at)
            spread = (q.ask - q.bid) / ((q.ask + q.bid) / 2) * 10_000 if q.bid > 0 and q.ask > q.bid else None
            easy = bool(q.shortable) and bool(q.easy_to_borrow)
            done = None  # action, reason, limit, fill, quantity, pnl, return
            if quantity > 0 and pending >= 0:
                limit = q.reference_price * (1 + offset)
                if q.ask > 0 and limit >= q.ask:
                    done = ("exit", "marketable", limit, q.ask, quantity, (entry - q.ask) * quantity, entry / q.ask - 1)
                    quantity = entry = 0.0
                else:
                    done = ("missed_exit", "limit_not_marketable", limit, 0.0, quantity, 0.0, 0.0)
            elif quantity == 0 and pending < 0:
                limit = q.reference_price * (1 - offset)
                if easy and q.bid > 0 and limit <= q.bid:
                    quantity, entry = -pending * capital / q.bid, q.bid
                    done = ("entry", "marketable_etb", limit, q.bid, quantity, 0.0, 0.0)
                else:
                    done = ("blocked_entry", "limit_not_marketable" if easy else "not_easy_to_borrow", limit, 0.0, 0.0, 0.0, 0.0)
            if done:
                action, reason, limit, fill, n, pnl, gain = done
                out.append((key[0], q.at, last, action, reason, pending, q.reference_price, q.bid, q.ask, spread, limit, fill, n, fill * n, q.shortable, q.easy_to_borrow, q.borrow_status, pnl, gain))
            pending, last = min(float(q.target_weight), 0.0), int(q.at)
            due = last + wait if quantity > 0 and pending >= 0 else -1
        unmet(state.getCurrentWatermarkMs())
        state.update((quantity, entry, pending, last, due))
        if due >= 0:
            state.setTimeoutTimestamp(due)
        if out:
            yield pd.DataFrame(out, columns=list(_OUT)).astype({"spread_bps": "float64"})

    rows = quotes.withWatermark("timestamp", late).withColumn("at", F.unix_millis("timestamp"))
    shape = ", ".join(f"`{k}` {v}" for k, v in _OUT.items())
    events = rows.select(*_QUOTE, "timestamp").groupBy("symbol").applyInPandasWithState(update, shape, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return events.withColumns({c: F.timestamp_millis(c) for c in ("observed_at", "signal_timestamp")})
