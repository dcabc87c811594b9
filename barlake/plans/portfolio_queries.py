"""Queries of whole features, pair-aware portfolios, overlays and evaluation with drifting weights."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlake.functions import factors as X
from barlake.functions import features as Y
from barlake.operators import evaluate as V
from barlake.operators import portfolio as P
from barlake.operators import universe
from barlake.operators import weights as W
from barlake.sources import ingest

from .intraday_queries import _work_dir
from .registry import panel_of, query, register, stored, table, with_bars, with_panel
from .strategy_queries import _EVAL, _S, _SCORE, _T, _TOP, _full, _scores

_X = f"OVER ({_T})"


def six(x):
    """Six digits, without a negative zero."""
    return F.round(x, 6) + 0.0


def _r6(x: str) -> str:
    return f"ROUND({x}, 6) + 0.0"


def _weekly(spark, sf_dir):
    return panel_of(spark, sf_dir, "weekly10")


# ---- features with their conditions

_F10, _F40 = _full("AVG(close)", "close", 10), _full("AVG(close)", "close", 40)
_WHOLE = {
    "d02_trend_strength_eligible": (
        lambda: Y.trend_strength("close", "r", 10, 40, 20, 20),
        f"CASE WHEN ({_F10}) > ({_F40}) AND close > ({_F40}) AND close / LAG(close, 20) OVER ({_S}) - 1 > 0 THEN (({_F10}) / ({_F40}) - 1 + close / LAG(close, 20) OVER ({_S}) - 1) / NULLIF({_full('STDDEV_SAMP(r)', 'r', 20)}, 0) END",
    ),
    "d03_short_reversal_eligible": (
        lambda: Y.short_reversal("close", "r", 5, 40, 20),
        f"CASE WHEN close / LAG(close, 5) OVER ({_S}) - 1 < 0 AND close > ({_F40}) THEN -((close / LAG(close, 5) OVER ({_S}) - 1) / NULLIF({_full('STDDEV_SAMP(r)', 'r', 20)}, 0)) END",
    ),
    "d04_skip_momentum_filtered": (
        lambda: Y.skip_momentum("close", "r", 52, 4, 10, 40, 20),
        f"CASE WHEN LAG(close, 4) OVER ({_S}) / LAG(close, 52) OVER ({_S}) - 1 > 0 AND close > ({_F40}) AND ({_F10}) > ({_F40}) THEN (LAG(close, 4) OVER ({_S}) / LAG(close, 52) OVER ({_S}) - 1) / NULLIF({_full('STDDEV_SAMP(r)', 'r', 20)}, 0) END",
    ),
}
for _name, (_column, _sql) in _WHOLE.items():
    register(
        _name,
        lambda spark, sf_dir, column=_column: _weekly(spark, sf_dir).select("timestamp", "symbol", six(column()).alias("value")),
        with_panel(f"SELECT timestamp, symbol, {_r6(_sql)} AS value FROM p", "weekly10"),
    )


@query(with_panel(f"SELECT timestamp, symbol, {_r6(f'({_full("STDDEV_POP(x)", "x", 20)}) * SQRT(252.0)')} AS value FROM q", "weekly10", f"q AS (SELECT timestamp, symbol, LAG(r) OVER ({_S}) AS x FROM p)"))
def d20_volatility_of_prior_returns(spark, sf_dir):
    """The volatility before a bar: the bar's own return is not in it."""
    p = _weekly(spark, sf_dir).withColumn("x", X.ts_delay("r", 1))
    return p.select("timestamp", "symbol", six(Y.annual(X.ts_std_pop("x", 20))).alias("value"))


def _market(panel, **columns):
    """panel with columns of one symbol each, (symbol, value) by name; one aggregate over the panel, a row a timestamp."""
    side = panel.groupBy("timestamp").agg(*[F.max(F.when(F.col("symbol") == s, F.col(v))).alias(k) for k, (s, v) in columns.items()])
    return panel.join(side, "timestamp")


def _beta_sql(f: str, n: int) -> str:
    return f"({_full(f'COVAR_SAMP(r, {f})', f'r + {f}', n)}) / NULLIF({_full(f'VAR_SAMP({f})', f, n)}, 0)"


@query(
    with_panel(
        f"SELECT timestamp, symbol, {_r6(f'CASE WHEN COUNT(lr) OVER ({_S} ROWS BETWEEN 25 PRECEDING AND 4 PRECEDING) = 22 THEN SUM(lr) OVER ({_S} ROWS BETWEEN 25 PRECEDING AND 4 PRECEDING) END')} AS value FROM l WHERE symbol <> 'S0'",
        "weekly10",
        f"""b AS (SELECT timestamp, MAX(CASE WHEN symbol = 'S0' THEN r END) AS f0, MAX(CASE WHEN symbol = 'S1' THEN r END) - MAX(CASE WHEN symbol = 'S0' THEN r END) AS f1 FROM p GROUP BY timestamp),
j AS (SELECT p.timestamp, p.symbol, p.r, f0, f1 FROM p JOIN b ON p.timestamp = b.timestamp),
k AS (SELECT *, r - {_beta_sql("f0", 26)} * f0 - {_beta_sql("f1", 26)} * f1 AS res FROM j),
l AS (SELECT timestamp, symbol, CASE WHEN res IS NOT NULL THEN LN(1 + GREATEST(res, -0.999999)) END AS lr FROM k)""",
    )
)
def d07_multifactor_residual(spark, sf_dir):
    p = _market(_weekly(spark, sf_dir), f0=("S0", "r"), s1=("S1", "r")).withColumn("f1", F.col("s1") - F.col("f0"))
    p = p.select("timestamp", "symbol", Y.residual_return("r", ("f0", "f1"), 26).alias("residual"))
    p = p.withColumn("logs", Y.log_residual("residual")).select("timestamp", "symbol", six(Y.residual_momentum("logs", 26, 4)).alias("value"))
    return p.where("symbol <> 'S0'")


_PARTS = ("residual_long", "residual_medium", "trend", "downside")


def _win(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN LEAST(GREATEST({c}, QUANTILE_CONT({c}, 0.05) {_X}), QUANTILE_CONT({c}, 0.95) {_X}) END AS {c}"


def _z(c: str) -> str:
    return f"(({c} - AVG({c}) {_X}) / NULLIF(STDDEV_SAMP({c}) {_X}, 0))"


_M3 = f"""bm AS (SELECT timestamp, r AS rb, LAG(close, 4) OVER (ORDER BY timestamp) / LAG(close, 26) OVER (ORDER BY timestamp) - 1 AS bl,
  LAG(close, 4) OVER (ORDER BY timestamp) / LAG(close, 13) OVER (ORDER BY timestamp) - 1 AS bd FROM p WHERE symbol = 'S0'),
mj AS (SELECT p.timestamp, p.symbol, p.close, p.r, rb, bl, bd FROM p JOIN bm ON p.timestamp = bm.timestamp),
mk AS (SELECT *, {_beta_sql("rb", 26)} AS beta, LAG(close, 4) OVER ({_S}) / LAG(close, 26) OVER ({_S}) - 1 AS ml, LAG(close, 4) OVER ({_S}) / LAG(close, 13) OVER ({_S}) - 1 AS md,
  ({_full("STDDEV_SAMP(r)", "r", 12)}) * SQRT(252.0) AS vol, SQRT({_full("AVG(POW(CASE WHEN r IS NOT NULL THEN LEAST(r, 0.0) END, 2))", "r", 12)}) * SQRT(252.0) AS downside,
  {_full("AVG(close)", "close", 5)} AS fast, {_full("AVG(close)", "close", 20)} AS slow FROM mj),
mq AS (SELECT *, ml - beta * bl AS residual_long, md - beta * bd AS residual_medium, (close / slow - 1) / NULLIF(vol, 0) AS trend FROM mk WHERE symbol <> 'S0'),
mw AS (SELECT timestamp, symbol, close, beta, ml, vol, downside AS sigma, fast, slow, {", ".join(map(_win, _PARTS))} FROM mq),
mz AS (SELECT *, ROUND(0.5 * {_z("residual_long")} + 0.25 * {_z("residual_medium")} + 0.15 * {_z("trend")} - 0.1 * {_z("downside")}, 6) + 0.0 AS score FROM mw)"""


def _momentum(spark, sf_dir):
    """The weekly panel without the benchmark S0, with everything that the momentum portfolio reads."""
    p = _market(_weekly(spark, sf_dir), rb=("S0", "r"), cb=("S0", "close"))
    p = p.select(
        "timestamp", "symbol", "close", "r", X.ts_beta("r", "rb", 26).alias("beta"), Y.skip_return("close", 26, 4).alias("ml"), Y.skip_return("close", 13, 4).alias("md"),
        Y.skip_return("cb", 26, 4).alias("bl"), Y.skip_return("cb", 13, 4).alias("bd"), Y.annual_volatility("r", 12).alias("vol"), Y.downside_volatility("r", 12).alias("sigma"),
        X.ts_mean("close", 5).alias("fast"), X.ts_mean("close", 20).alias("slow"), Y.scaled_trend("close", "r", 20, 12).alias("trend"),
    ).where("symbol <> 'S0'")
    p = p.withColumns({"residual_long": F.col("ml") - F.col("beta") * F.col("bl"), "residual_medium": F.col("md") - F.col("beta") * F.col("bd"), "downside": F.col("sigma")})
    return Y.composite(p, Y.PRICE_PARTS, "score").withColumn("score", six(F.col("score")))


@query(with_panel("SELECT timestamp, symbol, score FROM mz", "weekly10", _M3))
def d10_composite_score(spark, sf_dir):
    return _momentum(spark, sf_dir).select("timestamp", "symbol", "score")


_ELIGIBLE = "COALESCE(ml > 0 AND close > slow AND fast > slow AND vol <= 0.1 AND score IS NOT NULL, FALSE)"


def _eligible():
    return Y.eligible(F.col("close").isNotNull(), "ml", "close", "fast", "slow", "vol", "score", "S0", 0.1)


@query(with_panel(f"SELECT timestamp, symbol, {_ELIGIBLE} AS eligible FROM mz", "weekly10", _M3))
def d13_eligibility(spark, sf_dir):
    return _momentum(spark, sf_dir).select("timestamp", "symbol", _eligible().alias("eligible"))


# ---- fundamentals, by their filing dates

_CONCEPTS = ("revenue", "cost_of_revenue", "gross_profit", "net_income", "assets", "liabilities", "operating_cash_flow", "shares", "eps")
_FILED = f"""pt AS (SELECT 'S' || CAST(o_custkey % 10 AS VARCHAR) AS symbol, CAST(EXTRACT(year FROM o_orderdate) AS INTEGER) AS fy, CAST(EXTRACT(quarter FROM o_orderdate) AS INTEGER) AS fp,
  o_orderkey % 9 AS c, ROUND(SUM(o_totalprice), 2) AS val FROM orders GROUP BY 1, 2, 3, 4),
pw AS (SELECT symbol, fy, fp, {", ".join(f"MAX(CASE WHEN c = {i} THEN val END) AS {c}" for i, c in enumerate(_CONCEPTS))} FROM pt GROUP BY 1, 2, 3),
pa AS (SELECT *, CAST(MAKE_DATE(fy, 3 * fp - 2, 1) + INTERVAL 3 MONTH AS DATE) + 39 AS available_at, COALESCE(gross_profit, revenue - cost_of_revenue) AS gp, NULLIF(ABS(assets), 0) AS a FROM pw),
ff AS (SELECT c.symbol, c.fy, c.fp, c.available_at, c.gp / c.a AS gross_profitability, c.operating_cash_flow / c.a AS cash_profitability, (c.net_income - c.operating_cash_flow) / c.a AS accruals,
  c.liabilities / c.a AS leverage, (c.shares - p.shares) / GREATEST(ABS(p.shares), 1e-9) AS share_growth, (c.revenue - p.revenue) / GREATEST(ABS(p.revenue), 1e-9) AS revenue_growth,
  COALESCE((c.eps - p.eps) / GREATEST(ABS(p.eps), 1e-9), (c.net_income - p.net_income) / GREATEST(ABS(p.net_income), 1e-9)) AS earnings_growth
  FROM pa c LEFT JOIN pa p ON p.symbol = c.symbol AND p.fy = c.fy - 1 AND p.fp = c.fp)"""
_RATIOS = ("gross_profitability", "cash_profitability", "accruals", "leverage", "share_growth", "revenue_growth", "earnings_growth")


def _points(spark, sf_dir):
    """Filed facts made of the orders: a concept for each remainder of the key, with other forms and durations that do not count."""
    o = table(spark, sf_dir, "orders")
    name = F.element_at(F.array(*[F.lit(c) for c in _CONCEPTS]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    start = F.trunc("o_orderdate", "quarter")
    g = o.groupBy(F.concat(F.lit("S"), (F.col("o_custkey") % 10).cast("string")).alias("symbol"), F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("fp"), start.alias("start"), name.alias("concept"))
    facts = g.agg(F.round(F.sum("o_totalprice"), 2).alias("val")).withColumn("end", F.date_sub(F.add_months("start", 3), 1))
    facts = facts.withColumn("filed", F.date_add("end", 40)).withColumn("accn", F.concat_ws("-", "symbol", "fy", "fp")).withColumn("form", F.lit("10-Q"))
    other = facts.withColumn("val", F.col("val") * 2).withColumn("form", F.lit("8-K"))
    longer = facts.withColumn("val", F.col("val") * 3).withColumn("start", F.add_months("start", -6))
    return facts.unionByName(other).unionByName(longer)


def _filings(spark, sf_dir):
    return ingest.filing_features(_points(spark, sf_dir), {c: [c] for c in _CONCEPTS})


@query(f"WITH {_FILED} SELECT symbol, fy, fp, available_at, {', '.join(f'{_r6(c)} AS {c}' for c in _RATIOS)} FROM ff")
def a11_filing_features(spark, sf_dir):
    return _filings(spark, sf_dir).select("symbol", "fy", "fp", "available_at", *[six(F.col(c)).alias(c) for c in _RATIOS])


def _scanned(spark, sf_dir):
    """The filed facts written as JSON files of companies and scanned."""
    path = f"{_work_dir(spark)}/facts"
    points = _points(spark, sf_dir).withColumn("fp", F.concat(F.lit("Q"), F.col("fp").cast("string")))
    ingest.write_company_facts(points.withColumn("unit", F.when(F.col("concept") == "shares", "shares").otherwise("USD")), path)
    return ingest.scan_company_facts(spark, path)


_POINTS = f"""{_FILED}, pn AS (SELECT symbol, ([{', '.join(f"'{c}'" for c in _CONCEPTS)}])[c + 1] AS concept, CASE WHEN c = 7 THEN 'shares' ELSE 'USD' END AS unit, val, fy, 'Q' || CAST(fp AS VARCHAR) AS fp, MAKE_DATE(fy, 3 * fp - 2, 1) AS s, CAST(MAKE_DATE(fy, 3 * fp - 2, 1) + INTERVAL 3 MONTH AS DATE) - 1 AS "end", symbol || '-' || CAST(fy AS VARCHAR) || '-' || CAST(fp AS VARCHAR) AS accn FROM pt),
po AS (SELECT *, '10-Q' AS form, s AS "start", val AS v FROM pn UNION ALL SELECT *, '8-K', s, val * 2 FROM pn UNION ALL SELECT *, '10-Q', CAST(s - INTERVAL 6 MONTH AS DATE), val * 3 FROM pn)"""


@query(f'WITH {_POINTS} SELECT symbol, concept, unit, ROUND(v, 2) AS val, fy, fp, form, "start", "end", "end" + 40 AS filed, accn FROM po')
def a10_company_facts(spark, sf_dir):
    """Every point of companies' facts, with the form, dates and number of its filing, scanned from JSON files."""
    return _scanned(spark, sf_dir).withColumn("val", F.round("val", 2))


@query(f"WITH {_FILED} SELECT symbol, 'Q' || CAST(fp AS VARCHAR) AS fp, fy, available_at, {', '.join(f'{_r6(c)} AS {c}' for c in _RATIOS)} FROM ff")
def a11_scanned_features(spark, sf_dir):
    """The features of filings that a scan of JSON files yields."""
    found = ingest.filing_features(_scanned(spark, sf_dir), {c: [f"{c}Restated", c] for c in _CONCEPTS})
    return found.select("symbol", "fy", "fp", "available_at", *[six(F.col(c)).alias(c) for c in _RATIOS])


def _known_sql(c: str) -> str:
    return f"(SELECT ARG_MAX({c}, ff.available_at) FROM ff WHERE ff.symbol = p.symbol AND ff.available_at + 1 <= p.timestamp AND {c} IS NOT NULL)"


@query(with_panel(f"SELECT timestamp, symbol, {_r6(_known_sql('leverage'))} AS leverage, {_r6(_known_sql('revenue_growth'))} AS revenue_growth FROM p", "weekly10", _FILED))
def d11_as_of_feature(spark, sf_dir):
    known = universe.as_of(_weekly(spark, sf_dir).select("timestamp", "symbol"), _filings(spark, sf_dir), ["leverage", "revenue_growth"])
    return known.select("timestamp", "symbol", six(F.col("leverage")).alias("leverage"), six(F.col("revenue_growth")).alias("revenue_growth"))


@query(
    with_panel(
        f"""SELECT timestamp, symbol, {_r6(f'COALESCE(0.2 * {_z("gross_profitability")} + 0.2 * {_z("cash_profitability")} - 0.2 * {_z("accruals")} - 0.2 * {_z("leverage")} - 0.2 * {_z("share_growth")}, 0)')} AS quality_score,
  {_r6(f'COALESCE(0.5 * {_z("revenue_growth")} + 0.5 * {_z("earnings_growth")}, 0)')} AS earnings_score FROM kw""",
        "weekly10",
        _FILED + f""", kn AS (SELECT timestamp, symbol, {", ".join(f"{_known_sql(c)} AS {c}" for c in _RATIOS)} FROM p),
kc AS (SELECT * REPLACE (CASE WHEN revenue_growth IS NOT NULL THEN LEAST(GREATEST(revenue_growth, -5), 5) END AS revenue_growth, CASE WHEN earnings_growth IS NOT NULL THEN LEAST(GREATEST(earnings_growth, -5), 5) END AS earnings_growth) FROM kn),
kw AS (SELECT timestamp, symbol, {", ".join(map(_win, _RATIOS))} FROM kc)""",
    )
)
def d12_fundamental_scores(spark, sf_dir):
    known = universe.as_of(_weekly(spark, sf_dir).select("timestamp", "symbol"), _filings(spark, sf_dir), list(_RATIOS))
    return Y.fundamental_scores(known).select("timestamp", "symbol", six(F.col("quality_score")).alias("quality_score"), six(F.col("earnings_score")).alias("earnings_score"))


# ---- selection and weights

@query()
def e06_decorrelated_selection(spark, sf_dir):
    """Two variants of the limit on correlations, each a fold of its own; the pairs are made once."""
    p = _momentum(spark, sf_dir).where("score is not null")
    due = W.rebalance_days(_weekly(spark, sf_dir), 4).select("timestamp")
    rank = F.row_number().over(Window.partitionBy("timestamp").orderBy(F.col("score").desc(), "symbol"))
    sector = F.concat(F.lit("G"), (F.substring("symbol", 2, 2).cast("int") % 3).cast("string"))
    ranked = p.join(due, "timestamp", "left_semi").select("timestamp", "symbol", rank.alias("rank"), sector.alias("sector"), (F.col("sigma") > 0).alias("usable"))
    path = f"{_work_dir(spark)}/ranked"  # read three times below, so it is made once
    ranked.write.parquet(path)
    ranked = spark.read.schema(ranked.schema).parquet(path)
    pairs = P.trailing_pairs(_weekly(spark, sf_dir).select("timestamp", "symbol", "r"), ranked, "r", 26, 20)
    grid = spark.createDataFrame([(0, 0.05), (1, 0.5)], "variant_id int, max_corr double")
    return P.decorrelated_selection(ranked.crossJoin(F.broadcast(grid)), pairs, 3, 5, 2)  # two rows


@query(with_panel("SELECT timestamp, symbol, ROUND(sigma / EXP(0.2 * LEAST(GREATEST(score, -3.0), 3.0) - 0.5 * ABS(beta - 1)), 6) AS sigma FROM mz WHERE score IS NOT NULL", "weekly10", _M3))
def e10_tilted_volatility(spark, sf_dir):
    p = _momentum(spark, sf_dir).where("score is not null")
    return p.select("timestamp", "symbol", F.round(P.tilted_volatility(F.col("sigma"), F.col("score"), F.col("beta")), 6).alias("sigma"))


@query(
    with_panel(
        "SELECT iw.timestamp, iw.symbol, ROUND(w * CASE WHEN fv > 0.02 THEN 0.02 / fv ELSE 1.0 END, 6) AS target_weight, ROUND(COALESCE(fv, 0.0), 6) AS forecast_volatility FROM iw LEFT JOIN fo ON fo.timestamp = iw.timestamp",
        "weekly10",
        _SCORE + "," + _TOP + f""",
iw AS (SELECT timestamp, symbol, (1 / sigma) / SUM(1 / sigma) OVER ({_T}) AS w FROM top WHERE sigma > 0),
pl AS (SELECT timestamp, ROW_NUMBER() OVER (ORDER BY timestamp) AS place FROM (SELECT DISTINCT timestamp FROM p)),
px AS (SELECT p.symbol, p.r, pl.place FROM p JOIN pl ON pl.timestamp = p.timestamp WHERE r IS NOT NULL),
cv AS (SELECT x.timestamp, x.symbol AS a, y.symbol AS b, x.w AS wa, y.w AS wb, COUNT(*) AS n, COVAR_SAMP(u.r, v.r) AS cov FROM iw x JOIN iw y ON y.timestamp = x.timestamp
  JOIN pl ON pl.timestamp = x.timestamp JOIN px u ON u.symbol = x.symbol AND u.place BETWEEN pl.place - 25 AND pl.place JOIN px v ON v.symbol = y.symbol AND v.place = u.place GROUP BY 1, 2, 3, 4, 5),
fo AS (SELECT timestamp, SQRT(GREATEST(SUM(wa * wb * cov * 252.0), 0)) AS fv FROM cv WHERE n >= 20 GROUP BY timestamp)""",
    )
)
def e11_forecast_ceiling(spark, sf_dir):
    s = stored(_scores(spark, sf_dir))
    weights = stored(W.inverse_volatility(W.top_n(s, 3).join(s.select("timestamp", "symbol", "sigma"), ["timestamp", "symbol"]), "sigma").select("timestamp", "symbol", "target_weight"))
    out = P.forecast_ceiling(weights, P.trailing_pairs(s, weights, "r", 26, 20), 0.02)
    return out.select("timestamp", "symbol", F.round("target_weight", 6).alias("target_weight"), F.round("forecast_volatility", 6).alias("forecast_volatility"))


@query()
def e09_sleeve_band(spark, sf_dir):
    """Top three names as a sleeve of 60 %, for two bands; a variant is a group of its own."""
    s = _scores(spark, sf_dir)
    t = s.select("timestamp", "symbol", "r").join(W.top_n(s, 3).select("timestamp", "symbol", "target_weight"), ["timestamp", "symbol"], "left").withColumn("target_weight", F.coalesce("target_weight", F.lit(0.0)))
    narrow = P.sleeve(t.withColumn("variant_id", F.lit(0)), 0.6, 0.01, 4, 0.05, 12)
    wide = P.sleeve(t.withColumn("variant_id", F.lit(1)), 0.6, 0.2, 4)
    return narrow.union(wide).select("variant_id", "timestamp", "symbol", F.round("target_weight", 6).alias("target_weight"))


_OVERLAY = f"""ov AS (SELECT timestamp, CASE WHEN up THEN 1.0 ELSE 0.5 END * CASE WHEN sd > 0 THEN COALESCE(LEAST(GREATEST(0.02 / sd, 0.5), 1.0), 1.0) ELSE 1.0 END AS core_multiplier, CASE WHEN up THEN 1.0 ELSE 0.6 END AS active_multiplier
  FROM (SELECT timestamp, COALESCE(close >= {_full("AVG(close)", "close", 20)}, TRUE) AS up, ({_full("STDDEV_POP(r)", "r", 12)}) * SQRT(252.0) AS sd FROM p WHERE symbol = 'S0'))"""


def _overlay(spark, sf_dir):
    return Y.exposure_overlay(_weekly(spark, sf_dir).where("symbol = 'S0'"), "close", 20, 12, 0.02, 0.5, 0.5, 0.6)


@query(with_panel(f"SELECT timestamp, {_r6('core_multiplier')} AS core_multiplier, {_r6('active_multiplier')} AS active_multiplier FROM ov", "weekly10", _OVERLAY))
def d26_exposure_multipliers(spark, sf_dir):
    return _overlay(spark, sf_dir).select("timestamp", six(F.col("core_multiplier")).alias("core_multiplier"), six(F.col("active_multiplier")).alias("active_multiplier"))


@query(
    with_panel(
        f"SELECT tp.timestamp, tp.symbol, {_r6('w * CASE WHEN symbol = \'S0\' THEN core_multiplier ELSE active_multiplier END')} AS target_weight FROM tp JOIN ov ON ov.timestamp = tp.timestamp",
        "weekly10",
        _SCORE + "," + _TOP + f", tp AS (SELECT timestamp, symbol, 1.0 / COUNT(*) OVER ({_T}) AS w FROM top), " + _OVERLAY,
    )
)
def e12_exposure_overlay(spark, sf_dir):
    out = P.apply_overlay(W.top_n(_scores(spark, sf_dir), 3), _overlay(spark, sf_dir), "S0")
    return out.select("timestamp", "symbol", six(F.col("target_weight")).alias("target_weight"))


# ---- evaluation and books of record

@query(
    with_panel(
        f"SELECT timestamp, {_r6('value / LAG(value, 1, 1.0) OVER (PARTITION BY block ORDER BY timestamp) - 1 - cost')} AS daily_return FROM dv",
        "weekly10",
        _EVAL + f""",dx AS (SELECT hold.timestamp, hold.symbol, hold.block, hold.weight, LEAD(open, 1) OVER ({_S}) AS o1, LEAD(open, 2) OVER ({_S}) AS o2, weight - LAG(weight, 1, 0.0) OVER ({_S}) AS ch FROM hold),
dy AS (SELECT *, FIRST_VALUE(o1) OVER (PARTITION BY symbol, block ORDER BY timestamp) AS base, ROW_NUMBER() OVER (PARTITION BY symbol, block ORDER BY timestamp) AS k FROM dx),
dw AS (SELECT *, COALESCE(o2 / base, LAST_VALUE(o1 / base IGNORE NULLS) OVER (PARTITION BY symbol, block ORDER BY timestamp), 1.0) AS growth FROM dy),
dv AS (SELECT timestamp, block, 1 - SUM(weight) + SUM(weight * growth) AS value, SUM(CASE WHEN k = 1 THEN ABS(ch) ELSE 0 END) * 0.001 AS cost FROM dw GROUP BY 1, 2)""",
    )
)
def g03_drifting_returns(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return P.drift_returns(s, W.top_n(s, 3), 4, 10.0).select("timestamp", six(F.col("daily_return")).alias("daily_return"))


_PU = f"""pd AS (SELECT timestamp, symbol, close, close * COALESCE(volume, 0) AS dv FROM panel),
pm AS (SELECT *, CASE WHEN COUNT(dv) OVER ({_S} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 10 THEN MEDIAN(dv) OVER ({_S} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS liq FROM pd),
pe AS (SELECT CAST(DATE_TRUNC('month', timestamp) AS DATE) AS month, MAX(timestamp) AS timestamp FROM bars GROUP BY 1),
pk AS (SELECT pe.month, symbol, ROW_NUMBER() OVER (PARTITION BY pe.month ORDER BY liq DESC, symbol) AS k FROM pm JOIN pe ON pe.timestamp = pm.timestamp WHERE close >= 80 AND liq >= 0 AND symbol <> 'S0'),
ps AS (SELECT symbol, CAST(month + INTERVAL 1 MONTH AS DATE) AS s FROM pk WHERE k <= 4),
pr AS (SELECT symbol, s, s - CAST(ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY s) AS INTEGER) * INTERVAL 1 MONTH AS island FROM ps)"""


@query(with_panel("""SELECT symbol, MIN(s) AS "start", LAST_DAY(MAX(s)) AS "end" FROM pr GROUP BY symbol, island""", extra=_PU))
def i05_panel_universe(spark, sf_dir):
    from .registry import bars

    return universe.panel_universe(bars(spark, sf_dir), 4, 20, 80.0, 0.0, "S0")


@query(
    with_panel(
        f"""SELECT 1 AS variant_id, MAX(dd.timestamp) AS as_of_bar, (SELECT COUNT(*) FROM sl) AS n_positions, {_r6('COALESCE((SELECT SUM(w) FROM sl), 0)')} AS gross_weight,
  COALESCE((SELECT STRING_AGG(symbol || '=' || PRINTF('%.6f', w), ',' ORDER BY symbol || '=' || PRINTF('%.6f', w)) FROM sl), '') AS positions, {_r6('ARG_MAX(equity, timestamp)')} AS equity, {_r6('ARG_MAX(equity, timestamp) - 1')} AS total_return,
  {_r6('COALESCE(AVG(daily_return) * SQRT(252.0) / NULLIF(STDDEV_POP(daily_return), 0), 0)')} AS sharpe, {_r6('MIN(drawdown)')} AS max_drawdown FROM dd""",
        "weekly10",
        _EVAL + ", sl AS (SELECT symbol, w FROM tw WHERE timestamp = (SELECT MAX(timestamp) FROM tw))",
    )
)
def j10_shadow_snapshot(spark, sf_dir):
    from barlake.operators import lineage

    s = _scores(spark, sf_dir)
    targets = W.top_n(s, 3).withColumn("variant_id", F.lit(1))
    curve = V.equity_curve(V.portfolio_returns(s, W.top_n(s, 3), 4, 10.0)).withColumn("variant_id", F.lit(1))
    out = lineage.shadow_snapshot(targets, curve, V.metrics(curve, ("variant_id",)))
    return out.select(*[six(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(with_bars("""SELECT timestamp, symbol, close FROM bars WHERE symbol IN ('S1', 'S2') UNION ALL SELECT timestamp, symbol, close FROM bars WHERE symbol NOT IN ('S2', 'S4')""", "weekly10"))
def f10_union_bars(spark, sf_dir):
    from .registry import bars

    b = bars(spark, sf_dir, "weekly10")
    excluded = spark.createDataFrame([("S2",), ("S4",)], "symbol string")
    return universe.union_bars(b.where("symbol in ('S1', 'S2')"), b, excluded).select("timestamp", "symbol", "close")


_VARIANTS = "vs AS (SELECT * FROM (VALUES (0, 1, 10.0, 3), (1, 4, 10.0, 3), (2, 8, 10.0, 3), (3, 4, 10.0, 1), (4, 4, 10.0, 5), (5, 4, 50.0, 3)) v(variant_id, every, bps, lim))"
_GRID = f"""ga AS (SELECT *, ROW_NUMBER() OVER ({_T} ORDER BY score DESC, symbol) AS rk, COUNT(*) OVER ({_T}) AS cn FROM scores WHERE score > 0),
gb AS (SELECT timestamp, ROW_NUMBER() OVER (ORDER BY timestamp) - 1 AS place FROM (SELECT DISTINCT timestamp FROM p)),
gc AS (SELECT v.*, p.timestamp, p.symbol, LEAD(open, 2) OVER (PARTITION BY v.variant_id, p.symbol ORDER BY p.timestamp) / LEAD(open, 1) OVER (PARTITION BY v.variant_id, p.symbol ORDER BY p.timestamp) - 1 AS fwd,
  CASE WHEN place % every = 0 THEN CASE WHEN rk <= lim THEN 1.0 / LEAST(lim, cn) ELSE 0.0 END END AS w, SUM(CASE WHEN place % every = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY v.variant_id, p.symbol ORDER BY p.timestamp) AS block
  FROM p JOIN gb ON gb.timestamp = p.timestamp LEFT JOIN ga ON ga.timestamp = p.timestamp AND ga.symbol = p.symbol CROSS JOIN vs v),
gd AS (SELECT *, COALESCE(MAX(w) OVER (PARTITION BY variant_id, symbol, block), 0.0) AS weight FROM gc),
ge AS (SELECT *, ABS(weight - LAG(weight, 1, 0.0) OVER (PARTITION BY variant_id, symbol ORDER BY timestamp)) AS tr FROM gd),
gf AS (SELECT variant_id, timestamp, COALESCE(SUM(weight * fwd), 0) - COALESCE(SUM(tr * bps / 10000), 0) AS daily_return, SUM(tr) AS turnover FROM ge GROUP BY 1, 2)"""


def _cadences(spark, sf_dir):
    s = _scores(spark, sf_dir)
    grid = spark.createDataFrame([(0, 1, 10.0, 3), (1, 4, 10.0, 3), (2, 8, 10.0, 3), (3, 4, 10.0, 1), (4, 4, 10.0, 5), (5, 4, 50.0, 3)], "variant_id int, every int, bps double, limit int")
    return V.variant_returns(s, s.where("score > 0").select("timestamp", "symbol", "score"), grid)


@query(with_panel(f"SELECT variant_id, {_r6('EXP(SUM(LN(1 + daily_return))) - 1')} AS total_return, {_r6('COALESCE(AVG(daily_return) * SQRT(252.0) / NULLIF(STDDEV_POP(daily_return), 0), 0)')} AS sharpe, {_r6('SUM(turnover)')} AS turnover FROM gf GROUP BY variant_id", "weekly10", _SCORE + "," + _VARIANTS + "," + _GRID))
def h11_cadence_grid(spark, sf_dir):
    """Cadences, holding counts and costs as rows of one table of variants."""
    r = F.col("daily_return")
    sharpe = F.coalesce(F.try_divide(F.avg(r) * F.sqrt(F.lit(252.0)), F.stddev_pop(r)), F.lit(0.0))
    return _cadences(spark, sf_dir).groupBy("variant_id").agg(six(F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"), six(sharpe).alias("sharpe"), six(F.sum("turnover")).alias("turnover"))


@query(
    with_panel(
        f"""SELECT arm, {_r6('EXP(SUM(LN(1 + r))) - 1')} AS total_return, {_r6('COALESCE(AVG(r) * SQRT(252.0) / NULLIF(STDDEV_POP(r), 0), 0)')} AS sharpe FROM ar GROUP BY arm""",
        "weekly10",
        _EVAL + f""",fw AS (SELECT timestamp, symbol, LEAD(open, 2) OVER ({_S}) / LEAD(open, 1) OVER ({_S}) - 1 AS f FROM p),
ar AS (SELECT 'strategy' AS arm, daily_return AS r FROM port UNION ALL SELECT 'equal_weight', COALESCE(AVG(f), 0) FROM fw GROUP BY timestamp UNION ALL SELECT 'benchmark', COALESCE(MAX(CASE WHEN symbol = 'S0' THEN f END), 0) FROM fw GROUP BY timestamp)""",
    )
)
def h12_benchmark_arms(spark, sf_dir):
    s = _scores(spark, sf_dir)
    arms = V.compare_arms(V.portfolio_returns(s, W.top_n(s, 3), 4, 10.0), s, "S0")
    m = V.metrics(V.equity_curve(arms, ("arm",)), ("arm",))
    return m.select("arm", six(F.col("total_return")).alias("total_return"), six(F.col("sharpe")).alias("sharpe"))


@query(
    with_panel(
        f"""SELECT 0 AS variant_id, {_r6('ARG_MAX(equity, dd.timestamp) - 1')} AS total_return, {_r6('EXP(SUM(LN(1 + COALESCE(b.r, 0)))) - 1')} AS benchmark_total_return,
  {_r6('ARG_MAX(equity, dd.timestamp) - EXP(SUM(LN(1 + COALESCE(b.r, 0))))')} AS excess_return, (SELECT COUNT(*) FROM tr WHERE change <> 0) AS orders, {_r6('SUM(cost)')} AS fees FROM dd JOIN (SELECT timestamp, r FROM p WHERE symbol = 'S0') b ON b.timestamp = dd.timestamp""",
        "weekly10",
        _EVAL,
    )
)
def h02_whole_metrics(spark, sf_dir):
    s = _scores(spark, sf_dir)
    top = W.top_n(s, 3)
    market = s.where("symbol = 'S0'").select("timestamp", F.col("r").alias("benchmark_return"))
    curve = V.equity_curve(V.portfolio_returns(s, top, 4, 10.0)).join(market, "timestamp").withColumn("variant_id", F.lit(0))
    m = V.whole_metrics(curve, V.rebalance_legs(s, top, 4).withColumn("variant_id", F.lit(0)))
    return m.select("variant_id", *[six(F.col(c)).alias(c) for c in ("total_return", "benchmark_total_return", "excess_return")], "orders", six(F.col("fees")).alias("fees"))
