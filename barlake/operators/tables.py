"""Small table operators around the main ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bar_interval(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """The usual gap of each symbol's bars in minutes, of gaps from 1 to 60; the smallest of equally usual ones."""
    w = Window.partitionBy(key).orderBy("timestamp")
    gap = ((F.unix_timestamp("timestamp") - F.unix_timestamp(F.lag("timestamp").over(w))) / 60).cast("long")
    counts = bars.select(key, gap.alias("minutes")).where(F.col("minutes").between(1, 60)).groupBy(key, "minutes").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by("minutes", F.struct(-F.col("n"), F.col("minutes"))).alias("minutes"))


def common_window(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """The latest of the keys' first times and the earliest of their last ones."""
    g = bars.groupBy(key).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return g.agg(F.max("a").alias("start"), F.min("b").alias("end"))


def priority_universe(bars: DataFrame, preferred: DataFrame, cap: int, synthetic: str = "^SYM[0-9]+$") -> DataFrame:
    """Symbols of bars that are preferred and not synthetic, those with most bars first, cap of them."""
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).join(preferred.select("symbol").distinct(), "symbol", "left_semi").where(~F.col("symbol").rlike(synthetic))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "symbol"))).where(F.col("place") <= cap)


#: Beginnings of made-up tickers, which a number follows.
SYNTHETIC = ("SYM",)


def bind_universes(requests: DataFrame, bars: DataFrame, benchmark: str, cap: int | None = None, key: str = "candidate_id") -> DataFrame:
    """(key, source, ok, reason, symbols): what each request may trade, names with most bars first, cap of them.

    requests: (key, configured, wanted), both arrays of symbols or null. A configured list comes first, and fails if none
    of it is in the bars; then the wanted list, less made-up tickers; if none of that is in the bars, all names are. The
    benchmark is never among them. Letter case does not count; of equally many bars the lesser symbol comes first.
    """
    names = bars.where(F.upper("symbol") != benchmark.upper()).groupBy(F.upper("symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    made_up = "^(" + "|".join(SYNTHETIC) + ")[0-9]+$"
    lists = requests.select(key, F.size(F.coalesce("configured", F.array().cast("array<string>"))).alias("_c"), F.explode_outer(F.array_union(
        F.coalesce(F.transform("configured", lambda s: F.struct(F.lit("config").alias("source"), F.upper(s).alias("symbol"))), F.array().cast("array<struct<source: string, symbol: string>>")),
        F.coalesce(F.transform(F.filter("wanted", lambda s: ~F.upper(s).rlike(made_up)), lambda s: F.struct(F.lit("bundle_symbol_list").alias("source"), F.upper(s).alias("symbol"))), F.array().cast("array<struct<source: string, symbol: string>>")),
    )).alias("e")).select(key, "_c", "e.*")
    found = lists.join(names, "symbol").groupBy(key, "source").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "symbol"))).alias("l"))
    wide = requests.select(key, (F.size(F.coalesce("configured", F.array().cast("array<string>"))) > 0).alias("_own"))
    for source in ("config", "bundle_symbol_list"):
        wide = wide.join(found.where(F.col("source") == source).select(key, F.col("l").alias(source)), key, "left")
    every = names.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "symbol"))).alias("_all"))  # one row, the names of the bars
    wide = wide.crossJoin(F.broadcast(every))
    source = F.when(F.col("_own"), "config").when(F.col("bundle_symbol_list").isNotNull(), "bundle_symbol_list").when(F.size("_all") > 0, "research_broad_pit").otherwise("none")
    picked = F.when(F.col("_own"), F.col("config")).otherwise(F.coalesce("bundle_symbol_list", "_all"))
    symbols = F.transform(F.coalesce(picked, F.array().cast("array<struct<n: bigint, symbol: string>>")), lambda x: x["symbol"])
    out = wide.select(key, source.alias("source"), (symbols if cap is None else F.slice(symbols, 1, cap)).alias("symbols"))
    reason = F.when(F.size("symbols") > 0, F.concat(F.lit("bound "), F.size("symbols").cast("string"), F.lit(" symbols"))).when(F.col("source") == "config", "config symbols not present in bars").otherwise("no bars available to bind a universe")
    return out.select(key, "source", (F.size("symbols") > 0).alias("ok"), reason.alias("reason"), "symbols")


def missing_price_exits(panel: DataFrame, sessions: int, haircut: float) -> DataFrame:
    """(timestamp, symbol, exit_price): a name whose close has been missing for `sessions` rows leaves at its last one."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    rows = panel.withColumn("_seq", F.row_number().over(w)).withColumn("_seen", F.max(F.when(F.col("close").isNotNull(), F.col("_seq"))).over(Window.partitionBy("symbol").orderBy("_seq")))
    rows = rows.withColumn("_last", F.last("close", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("_seq")))
    return rows.where(F.col("close").isNull() & (F.col("_seq") - F.col("_seen") == sessions)).select("timestamp", "symbol", (F.col("_last") * (1 - haircut)).alias("exit_price"))


def position_pnl(trades: DataFrame) -> DataFrame:
    """P&L, count and gross of each (session, symbol): sells less buys less fees."""
    signed = F.when(F.col("side") == "sell", F.col("notional")).otherwise(-F.col("notional")) - F.col("fees")
    return trades.groupBy("session", "symbol").agg(F.sum(signed).alias("pnl"), F.count(F.lit(1)).alias("n"), F.sum("notional").alias("gross"))


def combine_streams(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row over the common timestamps of two return streams: their sum, and how often each is active."""
    both = left.select("timestamp", F.col("daily_return").alias("x")).join(right.select("timestamp", F.col("daily_return").alias("y")), "timestamp")
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    x, y = F.col("x"), F.col("y")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(x + y).alias("total"), rate(x != 0).alias("left_active"), rate(y != 0).alias("right_active"), rate((x != 0) & (y != 0)).alias("both_active"))


def declared_objective(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("objective", F.col("sharpe") + F.col("cagr") + 0.5 * F.col("max_drawdown") - 0.01 * F.col("annual_turnover"))


def position_diagnostics(positions: DataFrame, key: str = "variant_id") -> DataFrame:
    """Win rate, share of the gains in the best one and the best three, the total without the best one, and skewness."""
    by = Window.partitionBy(key).orderBy(F.col("pnl").desc(), "position")
    rows = positions.withColumn("_k", F.row_number().over(by))
    g = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.sum("pnl").alias("total"),
        F.sum(F.when(F.col("_k") == 1, F.col("pnl"))).alias("_top1"), F.sum(F.when(F.col("_k") <= 3, F.col("pnl"))).alias("_top3"), F.skewness("pnl").alias("_skew"),
    )
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("_skew") * F.sqrt(n * (n - 1)) / (n - 2))
    return g.select(key, "n", "win_rate", "total", F.try_divide("_top1", "total").alias("top1_share"), F.try_divide("_top3", "total").alias("top3_share"), (F.col("total") - F.col("_top1")).alias("without_best"), skew.alias("skew"))


def stale_orders(orders: DataFrame, now: Column, limit_minutes: int, managed: DataFrame) -> DataFrame:
    """Open orders of managed symbols that are at least limit_minutes old."""
    old = F.unix_timestamp(now) - F.unix_timestamp("submitted_at") >= 60 * limit_minutes
    return orders.where((F.col("status") == "open") & old).join(managed.select("symbol").distinct(), "symbol", "left_semi")


def managed_split(positions: DataFrame, universe: DataFrame) -> DataFrame:
    """For each account the market value inside and outside of the managed universe."""
    inside = universe.select("symbol", F.lit(True).alias("_in")).distinct()
    value = F.abs(F.col("quantity") * F.col("price"))
    rows = positions.join(inside, "symbol", "left")
    zero = lambda c: F.coalesce(F.sum(F.when(c, value)), F.lit(0.0))
    return rows.groupBy("account").agg(zero(F.col("_in").isNotNull()).alias("managed"), zero(F.col("_in").isNull()).alias("unmanaged"))


def close_summary(reconciled: DataFrame, band: float) -> DataFrame:
    """Counts by status, gross exposure and names out of the band for each account."""
    return reconciled.groupBy("account").agg(
        F.count(F.lit(1)).alias("names"), F.sum(F.abs("weight")).alias("gross"), F.count_if(F.abs("drift") >= band).alias("out_of_band"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "drift", "unexpected", "missing_price")],
    )


def strategy_rebalance_due(sessions: DataFrame, last: DataFrame, strategies: DataFrame, every: int) -> DataFrame:
    """rebalance_due for what each account runs now: an account is due at once if it was last rebalanced by another strategy.

    last: (account, last_rebalance, strategy); strategies: (account, strategy), the accounts that count. The newest
    rebalance is the one that counts; of several on one day, that of the greatest name. With another strategy, or none
    before, sessions_since is `every`.
    """
    newest = last.groupBy("account").agg(F.max_by("strategy", F.struct("last_rebalance", "strategy")).alias("_was"), F.max("last_rebalance").alias("last_rebalance"))
    counted = rebalance_due(sessions, newest.select("account", "last_rebalance"), every)
    both = strategies.join(newest.select("account", "_was"), "account", "left").join(counted, "account", "left")
    same = F.coalesce(F.col("_was") == F.col("strategy"), F.lit(False))
    return both.select("account", "strategy", F.when(same, F.col("sessions_since")).otherwise(every).cast("long").alias("sessions_since"), (~same | F.coalesce("due", F.lit(True))).alias("due"))


def rebalance_due(sessions: DataFrame, last: DataFrame, every: int) -> DataFrame:
    """For each account whether at least `every` distinct sessions came after its last rebalance; never rebalanced is due.

    Only days are put in order: the sessions and the accounts' last days, each once; an account takes the place of its day.
    """
    accounts = last.groupBy("account").agg(F.max("last_rebalance").alias("_last"))
    days = sessions.select(F.col("session").alias("_day"), F.lit(1).alias("_n")).where("_day is not null").distinct()
    days = days.unionByName(accounts.select(F.col("_last").alias("_day"), F.lit(0).alias("_n")).where("_day is not null").distinct())
    places = days.groupBy("_day").agg(F.max("_n").alias("_n"))
    after = Window.orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    places = places.select(F.col("_day").alias("_last"), F.coalesce(F.sum("_n").over(after), F.lit(0)).cast("long").alias("_since"))
    counts = accounts.join(places, "_last", "left").withColumn("sessions_since", F.coalesce("_since", F.lit(0).cast("long")))
    return counts.select("account", "sessions_since", (F.col("_last").isNull() | (F.col("sessions_since") >= every)).alias("due"))


#: Keys of a candidate bundle and the tokens that no key may hold.
BUNDLE_KEYS = ("schema_version", "candidate_id", "expression", "lookback", "expected_sign")
FORBIDDEN = ("code", "exec", "script", "password")


def check_bundles(bundles: DataFrame, json: str = "json") -> DataFrame:
    """bundles with `errors` and `ok`: unknown, missing and forbidden keys, version, types and limits of flat JSON objects.

    Keys of executable content are found at any depth. `bundles.validate_bundles` has the rules of whole bundles.
    """
    m = F.from_json(json, "map<string,string>")
    keys = F.map_keys(m)
    known = F.array(*[F.lit(k) for k in BUNDLE_KEYS])
    name = lambda prefix, found: F.transform(F.array_sort(found), lambda k: F.concat(F.lit(prefix), k))
    forbidden = F.filter(keys, lambda k: k.rlike("|".join(FORBIDDEN)))
    rule = lambda bad, text: F.when(bad, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    sign, lookback = F.expr("try_cast(x['expected_sign'] as int)"), F.expr("try_cast(x['lookback'] as int)")
    out = bundles.withColumn("x", m)
    errors = F.concat(
        name("unknown:", F.array_except(keys, known)), name("missing:", F.array_except(known, keys)), name("forbidden:", forbidden), name("executable:", executable_keys(F.col(json))),
        rule(F.coalesce(F.col("x")["schema_version"] != "1", F.lit(False)), "version"),
        rule(F.coalesce(lookback, F.lit(0)) < 1, "lookback"), rule(~F.coalesce(sign.isin(-1, 1), F.lit(False)), "sign"),
    )
    return out.withColumn("errors", F.when(m.isNull(), F.array(F.lit("json"))).otherwise(errors)).drop("x").withColumn("ok", F.size("errors") == 0)


#: Tokens of a key, at any depth of a bundle, that imply executable content.
EXECUTABLE = ("python", "pickle", "lambda", "exec", "eval", "callable", "entrypoint", "shell", "script", "command", "reduce")


def executable_keys(json: Column) -> Column:
    """The keys of a JSON text, at any depth, that hold such a token; tokens are split at what is no letter or digit."""
    keys = F.regexp_extract_all(json, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))
    bad = F.array(*[F.lit(t) for t in EXECUTABLE])
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: F.arrays_overlap(F.split(F.lower(k), "[^a-z0-9]+"), bad))))
