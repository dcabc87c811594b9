"""Point-in-time universes and joins in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def month_ends(bars: DataFrame) -> DataFrame:
    """The last session of each month."""
    return bars.groupBy(F.trunc("timestamp", "MM").alias("month")).agg(F.max("timestamp").alias("timestamp"))


def monthly_candidates(bars: DataFrame, window: int = 60, min_history: int = 60, min_price: float = 0.0, min_dollar: float = 0.0) -> DataFrame:
    """Symbols at month ends that have the history, price and liquidity; counted in the symbol's own rows."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    frame = w.rowsBetween(1 - window, 0)
    rows = bars.withColumn("dollar", F.col("close") * F.col("volume")).withColumn("history", F.row_number().over(w))
    median = F.when(F.count("dollar").over(frame) == window, F.percentile("dollar", F.lit(0.5)).over(frame))
    rows = rows.withColumn("median_dollar", median).join(month_ends(bars).select("timestamp"), "timestamp", "left_semi")
    ok = (F.col("history") >= min_history) & (F.col("close") >= min_price) & (F.col("median_dollar") >= min_dollar)
    return rows.where(ok).select("timestamp", "symbol", "close", "history", "median_dollar")


def top_liquid(candidates: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("timestamp").orderBy(F.col("median_dollar").desc(), "symbol")
    return candidates.withColumn("liquidity_rank", F.row_number().over(order)).where(F.col("liquidity_rank") <= n)


def membership_periods(selections: DataFrame, sessions: DataFrame, causal: bool = True) -> DataFrame:
    """(symbol, start, end) of runs of consecutive month-end selections.

    causal: from the session after the first selection to the month end that drops the symbol. Otherwise from the
    month end itself to the last session before that. A run up to the newest month end is open (end is null).
    Months and sessions are calendar tables; only they are numbered without a partition.
    """
    months = selections.select("timestamp").distinct()
    by_time = Window.orderBy("timestamp")
    months = months.withColumn("pos", F.row_number().over(by_time)).withColumn("next_month", F.lead("timestamp").over(by_time))
    days = sessions.select("timestamp").distinct().withColumn("after", F.lead("timestamp").over(by_time)).withColumn("before", F.lag("timestamp").over(by_time))
    rows = selections.select("symbol", "timestamp").distinct().join(months, "timestamp")
    rows = rows.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("symbol").orderBy("pos")))
    runs = rows.groupBy("symbol", "run").agg(F.min("timestamp").alias("first"), F.max_by("next_month", "pos").alias("dropped"))
    edge = lambda on, column, name: days.select(F.col("timestamp").alias(on), F.col(column).alias(name))
    if causal:
        out = runs.join(edge("first", "after", "start"), "first", "left")
        return out.select("symbol", "start", F.col("dropped").alias("end"))
    out = runs.join(edge("dropped", "before", "end"), "dropped", "left")
    return out.select("symbol", F.col("first").alias("start"), "end")


def merge_adjacent(periods: DataFrame, gap_days: int = 4) -> DataFrame:
    """Periods of a symbol that overlap or lie within gap_days become one; an open end stays open, one not begun is left out."""
    far = F.lit("9999-12-31").cast("date")
    rows = periods.where("start is not null").withColumn("_end", F.coalesce("end", far))
    w = Window.partitionBy("symbol").orderBy("start", "_end")
    reach = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.datediff("start", reach) > gap_days), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    out = rows.groupBy("symbol", "_island").agg(F.min("start").alias("start"), F.max("_end").alias("_e"))
    return out.select("symbol", "start", F.nullif("_e", far).alias("end"))


def fetch_windows(periods: DataFrame, before: int = 90, after: int = 2, first=None, last=None) -> DataFrame:
    """The dates to load for each symbol: its membership with a margin, clamped."""
    out = periods.groupBy("symbol").agg(F.date_sub(F.min("start"), before).alias("start"), F.date_add(F.max(F.coalesce("end", F.lit(last).cast("date"))), after).alias("end"))
    return out.select("symbol", F.greatest("start", F.lit(first).cast("date")).alias("start"), F.least("end", F.lit(last).cast("date")).alias("end"))


def coverage(bars: DataFrame) -> DataFrame:
    """First and last bar, count and share of all sessions for each symbol."""
    sessions = bars.agg(F.count_distinct("timestamp").alias("sessions"))
    g = bars.groupBy("symbol").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(sessions)).select("symbol", "first", "last", "n", (F.col("n") / F.col("sessions")).alias("share"))


def continuous_start(bars: DataFrame, max_gap_days: int = 10) -> DataFrame:
    """The first session after a symbol's last gap of more than max_gap_days, else its first."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    late = F.datediff("timestamp", F.lag("timestamp").over(w)) > max_gap_days
    rows = bars.select("symbol", "timestamp", late.alias("late"))
    return rows.groupBy("symbol").agg(F.coalesce(F.max(F.when(F.col("late"), F.col("timestamp"))), F.min("timestamp")).alias("start"))


def as_of(rows: DataFrame, facts: DataFrame, values: list[str], time: str = "timestamp", available: str = "available_at", lag_days: int = 1) -> DataFrame:
    """rows with the values last known at their time: each value carried forward from facts of the symbol.

    Both sides go through one shuffle on symbol and one sort; a fact is seen lag_days after it became available.
    """
    kind = dict(rows.dtypes)[time]
    left = rows.withColumn("_t", F.col(time)).withColumn("_side", F.lit(1))
    right = facts.select("symbol", F.date_add(F.to_date(available), lag_days).cast(kind).alias("_t"), *values).withColumn("_side", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("_t", "_side")
    out = both.select("*", *[F.last(v, ignorenulls=True).over(w).alias("_" + v) for v in values]).where("_side = 1")
    return out.select(*rows.columns, *[F.col("_" + v).alias(v) for v in values])


def feed_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: bars in both feeds and in one only, quantiles of the close difference in bps of the mid, volume ratio."""
    a = left.select("timestamp", "symbol", F.col("close").alias("ca"), F.col("volume").alias("va"))
    b = right.select("timestamp", "symbol", F.col("close").alias("cb"), F.col("volume").alias("vb"))
    both = a.join(b, ["timestamp", "symbol"], "full_outer").withColumn("bps", F.abs(F.col("ca") - F.col("cb")) / ((F.col("ca") + F.col("cb")) / 2) * 10000)
    q = lambda x, p: F.percentile(x, F.lit(p))
    return both.agg(
        F.count("bps").alias("common"), F.sum(F.col("cb").isNull().cast("long")).alias("left_only"),
        F.sum(F.col("ca").isNull().cast("long")).alias("right_only"), q("bps", 0.5).alias("median_bps"), q("bps", 0.95).alias("p95_bps"), q("bps", 0.99).alias("p99_bps"),
        q(F.try_divide("vb", "va"), 0.5).alias("volume_ratio"),
    )


def pair_statistics(returns: DataFrame, value: str, min_obs: int) -> DataFrame:
    """Correlation and covariance of each pair of symbols over common timestamps; for a pool chosen beforehand."""
    a = returns.select("timestamp", F.col("symbol").alias("a"), F.col(value).alias("x"))
    b = returns.select("timestamp", F.col("symbol").alias("b"), F.col(value).alias("y"))
    g = a.join(b, "timestamp").where("a < b and x is not null and y is not null").groupBy("a", "b")
    out = g.agg(F.count(F.lit(1)).alias("n"), F.covar_samp("x", "y").alias("cov"), F.covar_pop("x", "y").alias("cp"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return out.where(F.col("n") >= min_obs).select("a", "b", "n", "cov", F.try_divide("cp", F.col("sx") * F.col("sy")).alias("corr"))


def overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of two signal sets, of what they share and of their union, and the Jaccard share, null if both are empty."""
    a, b = left.select(*keys).distinct().withColumn("_a", F.lit(1)), right.select(*keys).distinct().withColumn("_b", F.lit(1))
    g = a.join(b, keys, "full_outer").agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), F.count(F.col("_a") + F.col("_b")).alias("n_both"), F.count(F.lit(1)).alias("n_union"))
    return g.withColumn("jaccard", F.try_divide("n_both", "n_union"))


def panel_universe(bars: DataFrame, n: int, window: int = 63, min_price: float = 5.0, min_dollar: float = 2e7, benchmark: str = "SPY", causal: bool = True) -> DataFrame:
    """(symbol, start, end) of the n most liquid names of each month, by the trailing median dollar volume of the panel.

    A median needs window // 2 values of the last `window` timestamps. The rank is taken at a month's last session and holds
    for the next month, or with causal=False for that month itself. Adjacent months are merged; the benchmark is none.
    """
    from barlake.sources.bars import densify

    w = Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(1 - window, 0)
    dollar = F.col("close") * F.coalesce("volume", F.lit(0.0))
    rows = densify(bars).withColumn("_d", dollar)
    rows = rows.withColumn("liquidity", F.when(F.count("_d").over(w) >= window // 2, F.percentile("_d", F.lit(0.5)).over(w)))
    rows = rows.join(month_ends(bars), "timestamp").where((F.col("close") >= min_price) & (F.col("liquidity") >= min_dollar) & (F.col("symbol") != benchmark))
    order = Window.partitionBy("month").orderBy(F.col("liquidity").desc(), "symbol")
    chosen = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n)
    start = F.add_months("month", 1) if causal else F.col("month")
    return merge_adjacent(chosen.select("symbol", start.cast("date").alias("start"), F.last_day(start).alias("end")))


def seasoned(bars: DataFrame, cutoff, selections: DataFrame | None = None, parity: int | None = None) -> DataFrame:
    """Symbols whose first bar is at the cutoff or before; with parity, those of even (0) or odd (1) best liquidity rank."""
    out = bars.groupBy("symbol").agg(F.min("timestamp").alias("first")).where(F.col("first") <= F.lit(cutoff))
    if parity is None:
        return out
    rank = selections.groupBy("symbol").agg(F.min("liquidity_rank").alias("best_rank"))
    return out.join(rank, "symbol").where(F.col("best_rank") % 2 == parity)


def snapshot(selections: DataFrame) -> DataFrame:
    """The newest selection, by liquidity rank."""
    newest = selections.agg(F.max("timestamp").alias("timestamp"))
    return selections.join(newest, "timestamp", "left_semi").select("timestamp", "symbol", "liquidity_rank")


def staleness(snapshots: DataFrame, as_of: Column, limit_days: int, key: str = "universe") -> DataFrame:
    """Age in days of each universe's newest snapshot, and whether that is over the limit."""
    g = snapshots.groupBy(key).agg(F.max("timestamp").alias("newest")).withColumn("age_days", F.datediff(as_of, "newest"))
    return g.withColumn("stale", F.col("age_days") > limit_days)


def union_bars(first: DataFrame, second: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Both bar sets; of the second only names that are not excluded."""
    kept = second if excluded is None else second.join(excluded.select("symbol").distinct(), "symbol", "left_anti")
    return first.unionByName(kept.select(*first.columns))


def match_actions(exits: DataFrame, actions: DataFrame, symbol_columns: list[str], days: int) -> DataFrame:
    """exits (symbol, exit_date) with the corporate action nearest before or at their date, within `days` days, under any
    of the actions' symbol columns; exits without one are kept with nulls."""
    long_form = actions.select("action_id", "action_type", "action_date", F.explode(F.array_distinct(F.array(*symbol_columns))).alias("symbol")).where("symbol is not null")
    near = exits.join(long_form, "symbol").where(F.datediff("exit_date", "action_date").between(0, days))
    best = near.groupBy("symbol", "exit_date").agg(F.max_by(F.struct("action_id", "action_type", "action_date"), F.struct("action_date", "action_id")).alias("_a"))
    return exits.join(best, ["symbol", "exit_date"], "left").select(*exits.columns, "_a.action_id", "_a.action_type", "_a.action_date")
