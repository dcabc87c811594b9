"""Selections in which what is held comes first, for many variants of their limits at once.

What is chosen on a date depends on what is held, so dates are folded in order; but where a variant had nothing to hold
on the rebalance date before, or nothing that could be kept, the fold starts anew. Such dates cut a variant into runs, which are
folded side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_runs(ranked: DataFrame, dates: DataFrame) -> DataFrame:
    """ranked with `run`: a number that changes at each date on which the variant cannot keep anything.

    That is so if the rebalance date before has no names of the variant, or if none of them is within exit_rank now.
    dates: (timestamp) of all rebalances, a calendar; those on which a variant has no names are in it, too.
    """
    days = dates.select("timestamp").distinct().withColumn("_at", F.row_number().over(Window.orderBy("timestamp")))
    rows = ranked.join(F.broadcast(days), "timestamp")
    before = rows.select("variant_id", "symbol", (F.col("_at") + 1).alias("_at"), F.lit(True).alias("_was"))
    kept = F.coalesce(F.max(F.when(F.col("rank") <= F.col("exit_rank"), F.col("_was"))), F.lit(False))
    starts = rows.join(before, ["variant_id", "symbol", "_at"], "left").groupBy("variant_id", "_at").agg(kept.alias("_kept"))
    run = F.sum(F.when(F.col("_kept"), 0).otherwise(1)).over(Window.partitionBy("variant_id").orderBy("_at"))
    return rows.join(starts.select("variant_id", "_at", run.alias("run")), ["variant_id", "_at"]).drop("_at")


def candidates(ranked: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows of ranked that `select_held` can choose under any of the limits, with `walked`: whether a first walk can reach them.

    ranked: (timestamp, symbol, rank, sector, ...), whole pools; limits: (n, exit_rank, per_sector, ...) of all variants, a
    table as small as the user's list. A first walk goes through incumbents up to exit_rank and the best max(3 * exit_rank,
    5 * n) names; pairs matter to it alone. The second takes names by rank while their sector has room: after the best
    per_sector names of a sector all others find it full. So what is left out is never chosen, whatever the size of the pool.
    """
    most, last, room = limits.agg(F.max(F.greatest(3 * F.col("exit_rank"), 5 * F.col("n"))), F.max("exit_rank"), F.max("per_sector")).first()  # one row
    place, nth = (F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "symbol")) for keys in (["timestamp"], ["timestamp", "sector"]))
    rows = ranked.withColumn("walked", (place <= most) | (F.col("rank") <= last)).withColumn("_nth", nth)
    return rows.where((F.col("_nth") <= room) | F.col("walked")).drop("_nth")


def select_held(ranked: DataFrame, dates: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(variant_id, timestamp, symbol, place) of the names held after each rebalance.

    ranked: (variant_id, timestamp, symbol, rank, sector, usable, n, exit_rank, per_sector[, max_corr]), the names of a date
    by rank, with the variant's limits on every row; dates as of `with_runs`. The first walk goes through the incumbents
    up to exit_rank, in the order in which they were chosen, and the best max(3 * exit_rank, 5 * n) names. A name joins
    unless its sector is full or, with pairs (as of `portfolio.trailing_pairs`), it correlates above max_corr with one
    that has joined. If names are missing, all are walked by rank without the correlation test. Names that are not
    usable are chosen but not held. Only pairs above the limit reach the fold. Of large pools the `candidates` are enough, and
    pairs of those that are walked.
    """
    import pandas as pd

    rows = with_runs(ranked, dates)
    if pairs is None:
        rows = rows.withColumn("rivals", F.lit(None).cast("array<string>"))
    else:
        close = pairs.where("corr is not null and a < b").select("timestamp", "a", "b", "corr")
        both = close.select("timestamp", F.col("a").alias("symbol"), F.col("b").alias("other"), "corr").union(close.select("timestamp", "b", "a", "corr"))
        names = ranked.select("variant_id", "timestamp", "symbol", "max_corr")
        lists = names.join(both, ["timestamp", "symbol"]).where(F.col("corr") > F.col("max_corr")).groupBy("variant_id", "timestamp", "symbol").agg(F.collect_list("other").alias("rivals"))
        rows = rows.join(lists, ["variant_id", "timestamp", "symbol"], "left")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        held: list[str] = []
        out = []
        n, exit_rank, per_sector, variant = part[["n", "exit_rank", "per_sector", "variant_id"]].iloc[0]
        for when, day in part.sort_values(["timestamp", "rank", "symbol"]).groupby("timestamp", sort=True):
            info = {r.symbol: r for r in day.itertuples()}
            chosen: list[str] = []
            used: dict[str, int] = {}

            def walk(names: list[str], test: bool) -> None:
                for name in names:
                    own = info[name]
                    free = len(chosen) < n and name not in chosen and used.get(own.sector, 0) < per_sector
                    if free and not (test and own.rivals is not None and any(x in chosen for x in own.rivals)):
                        chosen.append(name)
                        used[own.sector] = used.get(own.sector, 0) + 1

            ranked_names = list(day["symbol"])
            kept = [s for s in held if s in info and info[s].rank <= exit_rank]
            walk(kept + [s for s in ranked_names[: max(3 * exit_rank, 5 * n)] if s not in kept], True)
            walk(ranked_names, False)
            held = [s for s in chosen if info[s].usable]
            out += [(variant, when, s, k) for k, s in enumerate(held)]
        return pd.DataFrame(out, columns=["variant_id", "timestamp", "symbol", "place"])

    kinds = dict(ranked.dtypes)
    return rows.groupBy("variant_id", "run").applyInPandas(fold, f"variant_id {kinds['variant_id']}, timestamp {kinds['timestamp']}, symbol string, place int")
