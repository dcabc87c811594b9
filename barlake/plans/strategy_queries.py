"""Queries of derived features, selections, evaluation and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.functions import factors as X
from barlake.operators import evaluate as V
from barlake.operators import weights as W

from .registry import bars, panel_of, query, register, stored, with_bars, with_panel

_S = "PARTITION BY symbol ORDER BY timestamp"
_T = "PARTITION BY timestamp"


def _w(n: int) -> str:
    return f"OVER ({_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN COUNT({x}) {_w(n)} = {n} THEN {agg} {_w(n)} END"


_VOL = _full("STDDEV_SAMP(r)", "r", 20)
#: Features of weekly bars: name: (column, SQL). Windows are counted in rows of the panel.
FEATURES = {
    "d01_risk_adjusted_momentum": (lambda: F.try_divide(X.ts_returns("close", 26), X.ts_std("r", 20) * F.sqrt(F.lit(252.0))), f"(close / LAG(close, 26) OVER ({_S}) - 1) / NULLIF(({_VOL}) * SQRT(252.0), 0)"),
    "d02_trend_strength": (
        lambda: F.try_divide(F.try_divide(X.ts_mean("close", 10), X.ts_mean("close", 40)) - 1 + X.ts_returns("close", 20), X.ts_std("r", 20)),
        f"(({_full('AVG(close)', 'close', 10)}) / ({_full('AVG(close)', 'close', 40)}) - 1 + close / LAG(close, 20) OVER ({_S}) - 1) / NULLIF({_VOL}, 0)",
    ),
    "d03_short_reversal": (lambda: -F.try_divide(X.ts_returns("close", 5), X.ts_std("r", 20)), f"-((close / LAG(close, 5) OVER ({_S}) - 1) / NULLIF({_VOL}, 0))"),
    "d04_skip_momentum": (
        lambda: F.try_divide(F.try_divide(X.ts_delay("close", 4), X.ts_delay("close", 52)) - 1, X.ts_std("r", 20)),
        f"(LAG(close, 4) OVER ({_S}) / LAG(close, 52) OVER ({_S}) - 1) / NULLIF({_VOL}, 0)",
    ),
    "d08_annual_volatility": (lambda: X.ts_std("r", 20) * F.sqrt(F.lit(252.0)), f"({_VOL}) * SQRT(252.0)"),
    "d08_downside_volatility": (
        lambda: F.sqrt(X.ts_mean(F.pow(X.lesser("r", F.lit(0.0)), 2), 20)) * F.sqrt(F.lit(252.0)),
        f"SQRT({_full('AVG(POW(CASE WHEN r IS NOT NULL THEN LEAST(r, 0.0) END, 2))', 'r', 20)}) * SQRT(252.0)",
    ),
    "d09_scaled_trend": (lambda: F.try_divide(F.try_divide(F.col("close"), X.ts_mean("close", 40)) - 1, X.ts_std("r", 20)), f"(close / ({_full('AVG(close)', 'close', 40)}) - 1) / NULLIF({_VOL}, 0)"),
    "d18_dollar_volume": (lambda: F.col("close") * F.col("volume"), "close * volume"),
    "d20_prior_volatility": (lambda: X.ts_std_pop("r", 20) * F.sqrt(F.lit(252.0)), f"({_full('STDDEV_POP(r)', 'r', 20)}) * SQRT(252.0)"),
}
for _name, (_column, _sql) in FEATURES.items():
    register(
        _name,
        lambda spark, sf_dir, column=_column: panel_of(spark, sf_dir, "weekly10").select("timestamp", "symbol", F.round(column(), 6).alias("value")),
        with_panel(f"SELECT timestamp, symbol, ROUND({_sql}, 6) AS value FROM p", "weekly10"),
    )


@query(
    with_panel(
        f"SELECT timestamp, symbol, volume / NULLIF(LAG(m) OVER ({_S}), 0) AS value FROM m",
        "weekly10",
        f"m AS (SELECT timestamp, symbol, volume, {_full('MEDIAN(volume)', 'volume', 10)} AS m FROM p)",
    ).replace("volume / NULLIF(LAG(m)", "ROUND(volume / NULLIF(LAG(m)").replace(", 0) AS value FROM m", ", 0), 6) AS value FROM m")
)
def d21_relative_volume(spark, sf_dir):
    p = panel_of(spark, sf_dir, "weekly10").withColumn("m", X.ts_median("volume", 10))
    return p.select("timestamp", "symbol", F.round(F.try_divide(F.col("volume"), F.lag("m").over(X.series())), 6).alias("value"))


_BETA = (
    "b AS (SELECT timestamp, r AS rb FROM p WHERE symbol = 'S0'),\n"
    "j AS (SELECT p.timestamp, p.symbol, p.close, p.r, b.rb FROM p JOIN b ON p.timestamp = b.timestamp),\n"
    f"k AS (SELECT *, ({_full('COVAR_SAMP(r, rb)', 'r + rb', 26)}) / NULLIF({_full('VAR_SAMP(rb)', 'rb', 26)}, 0) AS beta FROM j)"
)


def _with_benchmark(panel):
    return panel.join(panel.where("symbol = 'S0'").select("timestamp", F.col("r").alias("rb"), F.col("close").alias("cb")), "timestamp")


@query(with_panel("SELECT timestamp, symbol, ROUND(beta, 6) AS beta FROM k", "weekly10", _BETA))
def d05_rolling_beta(spark, sf_dir):
    return _with_benchmark(panel_of(spark, sf_dir, "weekly10")).select("timestamp", "symbol", F.round(X.ts_beta("r", "rb", 26), 6).alias("beta"))


@query(
    with_panel(
        f"SELECT k.timestamp, k.symbol, ROUND(k.close / LAG(k.close, 26) OVER (PARTITION BY k.symbol ORDER BY k.timestamp) - 1 - k.beta * (c.close / c.c26 - 1), 6) AS value FROM k JOIN c ON k.timestamp = c.timestamp",
        "weekly10",
        _BETA + f",\nc AS (SELECT timestamp, close, LAG(close, 26) OVER ({_S}) AS c26 FROM p WHERE symbol = 'S0')",
    )
)
def d06_residual_momentum(spark, sf_dir):
    p = _with_benchmark(panel_of(spark, sf_dir, "weekly10"))
    value = X.ts_returns("close", 26) - X.ts_beta("r", "rb", 26) * X.ts_returns("cb", 26)
    return p.select("timestamp", "symbol", F.round(value, 6).alias("value"))


@query(
    with_panel(
        "SELECT timestamp, ROUND(SUM(CASE WHEN close > m THEN 1.0 ELSE 0.0 END) / NULLIF(COUNT(m), 0), 6) AS breadth FROM a GROUP BY timestamp",
        "weekly10",
        f"a AS (SELECT timestamp, symbol, close, {_full('AVG(close)', 'close', 20)} AS m FROM p)",
    )
)
def d14_market_breadth(spark, sf_dir):
    p = panel_of(spark, sf_dir, "weekly10").withColumn("m", X.ts_mean("close", 20))
    share = F.try_divide(F.sum(F.when(F.col("close") > F.col("m"), 1.0).otherwise(0.0)), F.count("m"))
    return p.groupBy("timestamp").agg(F.round(share, 6).alias("breadth"))


@query(
    with_panel(
        "SELECT timestamp, CASE WHEN up + wide = 2 THEN 1.0 WHEN up + wide = 1 THEN 0.75 ELSE 0.25 END AS exposure FROM g",
        "weekly10",
        f"""a AS (SELECT timestamp, symbol, close, {_full("AVG(close)", "close", 20)} AS m FROM p),
g AS (SELECT timestamp, MAX(CASE WHEN symbol = 'S0' AND close > m THEN 1 ELSE 0 END) AS up,
  CASE WHEN SUM(CASE WHEN close > m THEN 1.0 ELSE 0.0 END) / NULLIF(COUNT(m), 0) >= 0.5 THEN 1 ELSE 0 END AS wide FROM a GROUP BY timestamp)""",
    )
)
def d15_regime_exposure(spark, sf_dir):
    p = panel_of(spark, sf_dir, "weekly10").withColumn("m", X.ts_mean("close", 20))
    above = F.col("close") > F.col("m")
    wide = F.try_divide(F.sum(F.when(above, 1.0).otherwise(0.0)), F.count("m")) >= 0.5
    g = p.groupBy("timestamp").agg(F.max(F.when((F.col("symbol") == "S0") & above, 1).otherwise(0)).alias("up"), F.when(wide, 1).otherwise(0).alias("wide"))
    n = F.col("up") + F.col("wide")
    return g.select("timestamp", F.when(n == 2, 1.0).when(n == 1, 0.75).otherwise(0.25).alias("exposure"))


# selections: scores are rounded first, so that both engines rank the same numbers
_SCORE = f"scores AS (SELECT timestamp, symbol, ROUND(close / LAG(close, 8) OVER ({_S}) - 1, 6) AS score, ROUND({_full('STDDEV_SAMP(r)', 'r', 12)}, 6) AS sigma FROM p)"


def _scores(spark, sf_dir, panel="weekly10"):
    p = panel_of(spark, sf_dir, panel)
    return p.withColumn("score", F.round(X.ts_returns("close", 8), 6)).withColumn("sigma", F.round(X.ts_std("r", 12), 6))


def _stored_scores(spark, sf_dir, panel="weekly10"):
    """The scores written once, for queries that read them several times."""
    return stored(_scores(spark, sf_dir, panel))


def _shown(targets):
    return targets.select("timestamp", "symbol", F.round("target_weight", 6).alias("target_weight"), "score")


_TOP = f"t AS (SELECT timestamp, symbol, score, sigma, ROW_NUMBER() OVER ({_T} ORDER BY score DESC, symbol) AS k FROM scores WHERE score > 0), top AS (SELECT * FROM t WHERE k <= 3)"


@query(with_panel(f"SELECT timestamp, symbol, ROUND(1.0 / COUNT(*) OVER ({_T}), 6) AS target_weight, score FROM top", "weekly10", _SCORE + "," + _TOP))
def e01_top_n(spark, sf_dir):
    return _shown(W.top_n(_scores(spark, sf_dir), 3))


@query(
    with_panel(
        f"""SELECT timestamp, symbol, ROUND(LEAST(0.5 / COUNT(*) OVER (PARTITION BY timestamp, side), 0.2) * side, 6) AS target_weight, score
FROM (SELECT *, CASE WHEN hi <= k THEN 1 WHEN lo <= k THEN -1 END AS side FROM q) WHERE side IS NOT NULL""",
        "weekly10",
        _SCORE + f""",q AS (SELECT timestamp, symbol, score, GREATEST(1, COUNT(*) OVER ({_T}) // 3) AS k,
  ROW_NUMBER() OVER ({_T} ORDER BY score DESC, symbol) AS hi, ROW_NUMBER() OVER ({_T} ORDER BY score, symbol) AS lo FROM scores WHERE score IS NOT NULL)""",
    )
)
def e02_quantile_long_short(spark, sf_dir):
    return _shown(W.quantile_weights(_scores(spark, sf_dir), 3, long_short=True, cap=0.2))


@query(with_bars("SELECT timestamp, symbol, ROUND(1.0 / (SELECT COUNT(DISTINCT symbol) FROM bars), 6) AS target_weight, 1.0 AS score FROM bars", "weekly10"))
def e03_static_allocation(spark, sf_dir):
    return _shown(W.static_weights(bars(spark, sf_dir, "weekly10")))


@query(
    with_panel(
        f"SELECT timestamp, symbol, ROUND((1 / sigma) / SUM(1 / sigma) OVER ({_T}), 6) AS target_weight, score FROM top WHERE sigma > 0",
        "weekly10",
        _SCORE + "," + _TOP,
    )
)
def e07_inverse_volatility(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return _shown(W.inverse_volatility(W.top_n(s, 3).join(s.select("timestamp", "symbol", "sigma"), ["timestamp", "symbol"]), "sigma"))


@query(
    with_panel(
        f"""SELECT timestamp, symbol, ROUND(CASE WHEN pin THEN 0.25 ELSE (1.0 - 0.25 * COUNT(CASE WHEN pin THEN 1 END) OVER ({_T})) * inv / NULLIF(SUM(CASE WHEN NOT pin THEN inv END) OVER ({_T}), 0) END, 6) AS target_weight, score FROM y""",
        "weekly10",
        _SCORE + f""",v AS (SELECT timestamp, symbol, score, 1 / sigma AS inv, ROW_NUMBER() OVER ({_T} ORDER BY 1 / sigma DESC, symbol) AS k FROM scores WHERE sigma > 0),
y AS (SELECT *, (1.0 - 0.25 * (k - 1)) * inv / SUM(inv) OVER ({_T} ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= 0.25 AS pin FROM v)""",
    )
)
def e08_capped_inverse_volatility(spark, sf_dir):
    return _shown(W.capped_inverse_volatility(_scores(spark, sf_dir), "sigma", 0.25))


_RAW = f"raw AS (SELECT timestamp, symbol, score, 5 * score AS w FROM scores WHERE score IS NOT NULL), cut AS (SELECT timestamp, symbol, score, LEAST(GREATEST(w, -0.15), 0.15) AS w FROM raw)"


@query(with_panel(f"SELECT timestamp, symbol, ROUND(w * LEAST(1.0, COALESCE(0.8 / NULLIF(SUM(ABS(w)) OVER ({_T}), 0), 1.0)), 6) AS target_weight, score FROM cut", "weekly10", _SCORE + "," + _RAW))
def e22_constrain(spark, sf_dir):
    raw = _scores(spark, sf_dir).where("score is not null").withColumn("target_weight", 5 * F.col("score"))
    return _shown(W.constrain(raw, 0.15, 0.8, long_only=False))


@query(with_panel("SELECT symbol, ARG_MAX(close, timestamp) AS price FROM bars GROUP BY symbol", "weekly10"))
def e24_last_prices(spark, sf_dir):
    return W.last_prices(bars(spark, sf_dir, "weekly10"))


# evaluation: top 3 by momentum, rebalanced every 4 weeks, 10 bps
_EVAL = (
    _SCORE + "," + _TOP + f""",
tw AS (SELECT timestamp, symbol, 1.0 / COUNT(*) OVER ({_T}) AS w FROM top),
due AS (SELECT timestamp, (ROW_NUMBER() OVER (ORDER BY timestamp) - 1) % 4 = 0 AS due FROM (SELECT DISTINCT timestamp FROM p)),
cells AS (SELECT p.timestamp, p.symbol, p.open, p.r, CASE WHEN due.due THEN COALESCE(tw.w, 0.0) END AS w,
  SUM(CASE WHEN due.due THEN 1 ELSE 0 END) OVER (PARTITION BY p.symbol ORDER BY p.timestamp) AS block,
  LEAD(p.open, 2) OVER (PARTITION BY p.symbol ORDER BY p.timestamp) / LEAD(p.open, 1) OVER (PARTITION BY p.symbol ORDER BY p.timestamp) - 1 AS fwd,
  LEAD(p.open, 1) OVER (PARTITION BY p.symbol ORDER BY p.timestamp) AS price
  FROM p JOIN due ON p.timestamp = due.timestamp LEFT JOIN tw ON tw.timestamp = p.timestamp AND tw.symbol = p.symbol),
hold AS (SELECT *, COALESCE(MAX(w) OVER (PARTITION BY symbol, block), 0.0) AS weight FROM cells),
tr AS (SELECT *, weight - LAG(weight, 1, 0.0) OVER ({_S}) AS change FROM hold),
port AS (SELECT timestamp, COALESCE(SUM(weight * fwd), 0.0) - SUM(ABS(change)) * 0.001 AS daily_return, SUM(ABS(weight)) AS gross_exposure,
  SUM(ABS(change)) AS turnover, SUM(ABS(change)) * 0.001 AS cost FROM tr GROUP BY timestamp),
curve AS (SELECT port.*, EXP(SUM(LN(1 + daily_return)) OVER (ORDER BY timestamp)) AS equity FROM port),
dd AS (SELECT *, equity / MAX(equity) OVER (ORDER BY timestamp) - 1 AS drawdown FROM curve)"""
)


def _portfolio(spark, sf_dir, bps=10.0, panel="weekly10"):
    s = _stored_scores(spark, sf_dir, panel)
    return V.portfolio_returns(s, W.top_n(s, 3), 4, bps)


@query(with_panel(f"SELECT timestamp, symbol, ROUND(LEAD(open, 2) OVER ({_S}) / LEAD(open, 1) OVER ({_S}) - 1, 6) AS forward FROM p"))
def g01_next_open_returns(spark, sf_dir):
    return V.holding_returns(panel_of(spark, sf_dir)).select("timestamp", "symbol", F.round("forward", 6).alias("forward"))


@query(with_panel("SELECT timestamp, symbol, ROUND(ABS(change), 6) AS traded, ROUND(ABS(change) * CASE WHEN symbol = 'S3' THEN 0.0025 ELSE 0.001 END, 8) AS cost FROM tr", "weekly10", _EVAL))
def g02_turnover_costs(spark, sf_dir):
    s = _scores(spark, sf_dir)
    out = V.turnover_costs(W.held(s, W.top_n(s, 3), 4), 10.0, {"S3": 25.0})
    return out.select("timestamp", "symbol", F.round("traded", 6).alias("traded"), F.round("cost", 8).alias("cost"))


_ROUND5 = "timestamp, ROUND(daily_return, 6) AS daily_return, ROUND(gross_exposure, 6) AS gross_exposure, ROUND(turnover, 6) AS turnover, ROUND(cost, 8) AS cost"


@query(with_panel(f"SELECT {_ROUND5} FROM port", "weekly10", _EVAL))
def g03_portfolio_returns(spark, sf_dir):
    out = _portfolio(spark, sf_dir)
    return out.select("timestamp", *[F.round(c, 6).alias(c) for c in ("daily_return", "gross_exposure", "turnover")], F.round("cost", 8).alias("cost"))


@query(with_panel("SELECT timestamp, symbol, CASE WHEN change > 0 THEN 'buy' ELSE 'sell' END AS side, ROUND(change, 6) AS change, price FROM tr WHERE change <> 0", "weekly10", _EVAL))
def g08_rebalance_legs(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return V.rebalance_legs(s, W.top_n(s, 3), 4).withColumn("change", F.round("change", 6))


@query(with_panel("SELECT timestamp, ROUND(equity, 6) AS equity, ROUND(drawdown, 6) AS drawdown FROM dd", "weekly10", _EVAL))
def h01_drawdown(spark, sf_dir):
    out = V.equity_curve(_portfolio(spark, sf_dir))
    return out.select("timestamp", F.round("equity", 6).alias("equity"), F.round("drawdown", 6).alias("drawdown"))


_METRICS = """COUNT(*) AS n, ROUND(ARG_MAX(equity, timestamp) - 1, 6) AS total_return,
  ROUND(POW(ARG_MAX(equity, timestamp), 365.25 / GREATEST(DATE_DIFF('day', MIN(timestamp), MAX(timestamp)), 1)) - 1, 6) AS cagr,
  ROUND(STDDEV_POP(daily_return) * SQRT(252.0), 6) AS volatility, ROUND(COALESCE(AVG(daily_return) * SQRT(252.0) / NULLIF(STDDEV_POP(daily_return), 0), 0), 6) AS sharpe,
  ROUND(COALESCE(AVG(daily_return) * SQRT(252.0) / NULLIF(STDDEV_POP(LEAST(daily_return, 0.0)), 0), 0), 6) AS sortino, ROUND(MIN(drawdown), 6) AS max_drawdown,
  ROUND(COALESCE((POW(ARG_MAX(equity, timestamp), 365.25 / GREATEST(DATE_DIFF('day', MIN(timestamp), MAX(timestamp)), 1)) - 1) / NULLIF(ABS(MIN(drawdown)), 0), 0), 6) AS calmar,
  ROUND(SUM(turnover) * 365.25 / GREATEST(DATE_DIFF('day', MIN(timestamp), MAX(timestamp)), 1), 6) AS annual_turnover"""
_MARKET = "mk AS (SELECT dd.*, b.r AS benchmark_return FROM dd JOIN (SELECT timestamp, r FROM p WHERE symbol = 'S0') b ON b.timestamp = dd.timestamp)"


def _rounded(df, keep=()):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    with_panel(
        f"""SELECT {_METRICS}, ROUND(COALESCE(COVAR_POP(daily_return, benchmark_return) / NULLIF(VAR_POP(benchmark_return), 0), 0), 6) AS beta,
  ROUND((AVG(daily_return) - COALESCE(COVAR_POP(daily_return, benchmark_return) / NULLIF(VAR_POP(benchmark_return), 0), 0) * AVG(benchmark_return)) * 252, 6) AS alpha FROM mk""",
        "weekly10",
        _EVAL + "," + _MARKET,
    )
)
def h02_metrics(spark, sf_dir):
    b = panel_of(spark, sf_dir, "weekly10").where("symbol = 'S0'").select("timestamp", F.col("r").alias("benchmark_return"))
    return _rounded(V.metrics(V.equity_curve(_portfolio(spark, sf_dir)).join(b, "timestamp")))


@query(with_panel(f"SELECT CAST(EXTRACT(year FROM timestamp) AS INTEGER) AS year, {_METRICS} FROM dd GROUP BY 1", "weekly10", _EVAL))
def h03_period_metrics(spark, sf_dir):
    return _rounded(V.metrics(V.equity_curve(_portfolio(spark, sf_dir)).withColumn("year", F.year("timestamp")), ("year",)))


@query(
    with_panel(
        f"SELECT fold, {_METRICS} FROM s GROUP BY fold",
        "weekly10",
        _EVAL + """,c AS (SELECT timestamp, ROW_NUMBER() OVER (ORDER BY timestamp) AS k, COUNT(*) OVER () AS n FROM port),
s AS (SELECT dd.*, CASE WHEN k <= FLOOR(n * 0.6 + 1e-9) THEN 'train' WHEN k <= FLOOR(n * 0.8 + 1e-9) THEN 'validation' ELSE 'test' END AS fold FROM dd JOIN c ON c.timestamp = dd.timestamp)""",
    )
)
def h04_fold_metrics(spark, sf_dir):
    curve = V.equity_curve(_portfolio(spark, sf_dir))
    folds = V.split_dates(curve, {"train": 0.6, "validation": 0.2, "test": 0.2})
    return _rounded(V.metrics(curve.join(folds, "timestamp"), ("fold",)))


@query(
    with_panel(
        "SELECT bps, ROUND(EXP(SUM(LN(1 + g.daily_return + g.cost - g.turnover * bps / 10000.0))) - 1, 6) AS total_return FROM port g CROSS JOIN (VALUES (0.0), (5.0), (10.0), (25.0), (50.0)) v(bps) GROUP BY bps",
        "weekly10",
        _EVAL,
    ).replace("SELECT bps,", "SELECT CAST(bps AS DOUBLE) AS bps,")
)
def h10_cost_stress(spark, sf_dir):
    base = _portfolio(spark, sf_dir, 0.0)
    grid = spark.createDataFrame([(x,) for x in (0.0, 5.0, 10.0, 25.0, 50.0)], "bps double")
    net = F.col("daily_return") - F.col("turnover") * F.col("bps") / 10000
    return base.crossJoin(F.broadcast(grid)).groupBy("bps").agg(F.round(F.exp(F.sum(F.log1p(net))) - 1, 6).alias("total_return"))


def flagship(spark, sf_dir):
    """Weekly momentum of five names: top 2, next open, 10 bps, one row of metrics."""
    s = _stored_scores(spark, sf_dir, "weekly5")
    targets = W.constrain(W.top_n(s, 2), 0.6, 1.0)
    return _rounded(V.metrics(V.equity_curve(V.portfolio_returns(s, targets, 4, 10.0))))


_FLAGSHIP = _EVAL.replace("k <= 3", "k <= 2").replace("SELECT timestamp, symbol, 1.0 / COUNT(*) OVER", "SELECT timestamp, symbol, LEAST(0.6, 1.0 / COUNT(*) OVER").replace(f"({_T}) AS w FROM top", f"({_T})) AS w FROM top")
register("momentum_topn_metrics", flagship, with_panel(f"SELECT {_METRICS} FROM dd", "weekly5", _FLAGSHIP))
