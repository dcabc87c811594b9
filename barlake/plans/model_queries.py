"""Queries of models and statistics at their full size: the setup regression, the bootstrap and the parameter sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import rolling_model, statistics
from barlake.operators import sweep as W
from barlake.sources.bars import densify

from .portfolio_queries import _r6, six
from .registry import ORACLES, PANEL_SQL, bars_of, bars_sql, query, table
from .registry import stored as _stored
from .session_bars import BENCHMARK, SESSION_SQL, session_bars
from .signal_queries import _CLOSES, _REL, _SETUP, _VW
from .table_queries import _CUST, held_suppliers


# ---- the setup regression: windows of 12 sessions, at least 5 of them and 20 rows, ridge 2.5, clip 1.6, label within 0.05

_X = rolling_model.FEATURES
_CELLS = [(i, j) for i in range(7) for j in range(i, 7)]
_SIGNAL = f"{SESSION_SQL}, {_VW}, {_REL}, {_CLOSES}, {_SETUP}".replace("'view'", f"'{BENCHMARK}'")
_RIDGE = f"""WITH RECURSIVE {_SIGNAL},
ft AS (SELECT s.session, s.symbol, -s.relative AS x0, k.close / d.o - 1 - b AS x1, k.close / k.vwap - 1 AS x2, s.relative_volume AS x3, se.prior_close / se.trend_average - 1 AS x4, k.close / s.close - 1 AS x5, b AS x6, d.c / k.nxt - 1 AS label
  FROM s1 s JOIN k1 k ON k.symbol = s.symbol AND k.session = s.session JOIN d1 d ON d.symbol = s.symbol AND d.session = s.session JOIN se ON se.symbol = s.symbol AND se.session = s.session JOIN mk ON mk.session = s.session),
ds AS (SELECT session, ROW_NUMBER() OVER (ORDER BY session) AS p FROM (SELECT DISTINCT session FROM ft)),
cl AS (SELECT p, symbol, x0, x1, x2, x3, x4, x5, x6, GREATEST(LEAST(label, 0.05), -0.05) AS y FROM ft JOIN ds USING (session) WHERE {' AND '.join(f'x{i} IS NOT NULL' for i in range(7))} AND label IS NOT NULL),
tr AS (SELECT t.session, t.p AS t, cl.* EXCLUDE (p) FROM ds t JOIN cl ON cl.p < t.p AND cl.p >= t.p - 12),
m0 AS (SELECT t, COUNT(*) AS n, AVG(y) AS my, {', '.join(f'AVG(x{i}) AS m{i}, STDDEV_POP(x{i}) AS d{i}' for i in range(7))} FROM tr GROUP BY t),
m1 AS (SELECT t, n, my, {', '.join(f'm{i}, CASE WHEN d{i} < 1e-12 THEN 1.0 ELSE d{i} END AS d{i}' for i in range(7))} FROM m0 WHERE n >= 20 AND t >= 6),
z AS (SELECT tr.t, tr.y - my AS y, {', '.join(f'GREATEST(LEAST((x{i} - m{i}) / d{i}, 1.6), -1.6) AS z{i}' for i in range(7))} FROM tr JOIN m1 USING (t)),
g AS (SELECT t, [{', '.join('[' + ', '.join([f'SUM(z{i} * z{j})' + (' + 2.5' if i == j else '') for j in range(7)] + [f'SUM(z{i} * y)']) + ']' for i in range(7))}] AS m FROM z GROUP BY t),
gj AS (SELECT t, 1 AS p, m FROM g UNION ALL SELECT t, p + 1, list_transform(range(1, 8), lambda i: CASE WHEN i = p THEN list_transform(m[p], lambda v: v / m[p][p]) ELSE list_transform(range(1, 9), lambda j: m[i][j] - m[i][p] / m[p][p] * m[p][j]) END) FROM gj WHERE p <= 7),
be AS (SELECT t, {', '.join(f'm[{i + 1}][8] AS b{i}' for i in range(7))} FROM gj WHERE p = 8),
pr AS (SELECT ft.*, ds.p, CASE WHEN {' AND '.join(f'x{i} IS NOT NULL' for i in range(7))} THEN my + {' + '.join(f'b{i} * GREATEST(LEAST((x{i} - m{i}) / d{i}, 1.6), -1.6)' for i in range(7))} END AS prediction FROM ft JOIN ds USING (session) LEFT JOIN m1 ON m1.t = ds.p LEFT JOIN be ON be.t = ds.p)"""


def _predicted(spark, sf_dir):
    rows = _stored(rolling_model.setup_features(_stored(session_bars(spark, sf_dir)), BENCHMARK, 765, 780, 2, 3, 5))
    return rolling_model.rolling_ridge(rows, _X, 12, 5, 20, 2.5, 1.6, 0.05)


@query(f"{_RIDGE} SELECT session, symbol, {_r6('prediction')} AS prediction FROM pr WHERE prediction IS NOT NULL")
def e19_setup_regression(spark, sf_dir):
    """Predictions of a ridge on the seven setup features, fitted anew for each session from the moments of those before."""
    return _predicted(spark, sf_dir).where("prediction is not null").select("session", "symbol", six("prediction").alias("prediction"))


@query(
    f"""{_RIDGE}, ca AS (SELECT p, session, symbol, prediction, GREATEST(LEAST(label - prediction, 0.05), -0.05) AS e FROM pr WHERE prediction IS NOT NULL AND x0 > -0.001),
sh AS (SELECT d.p, QUANTILE_CONT(e, 0.5) AS shift FROM (SELECT DISTINCT p FROM pr) d JOIN ca ON ca.p < d.p AND ca.p >= d.p - 12 WHERE e IS NOT NULL GROUP BY d.p HAVING COUNT(*) >= 4),
mv AS (SELECT session, symbol, prediction + shift AS prediction, ROW_NUMBER() OVER (PARTITION BY session ORDER BY prediction + shift, symbol) AS k FROM ca JOIN sh USING (p) WHERE prediction + shift <= 0.0005)
SELECT session, symbol, {_r6('prediction')} AS prediction FROM mv WHERE k <= 2"""
)
def e19_calibrated_picks(spark, sf_dir):
    """The lowest calibrated predictions of each session among the names below their relative dislocation."""
    found = _stored(_predicted(spark, sf_dir))
    picked = rolling_model.calibrated_pick(found, found.where("prediction is not null and relative_dislocation > -0.001"), 2, 0.0005, 12, 4)
    return picked.select("session", "symbol", six("prediction").alias("prediction"))


# ---- the bootstrap at its full size

_DRAW = "((b + 1) * 48271 + (j + 1) * 69621) % 2147483647"


@query(
    f"""WITH sr AS (SELECT l_suppkey % 5 AS variant_id, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS session, AVG(l_discount) - 0.05 AS r FROM lineitem GROUP BY 1, 2),
st AS (SELECT variant_id, COUNT(*) AS n, LIST(r ORDER BY session) AS v FROM sr GROUP BY 1), sb AS (SELECT variant_id, n, v, UNNEST(RANGE(100000)) AS b FROM st),
sh AS (SELECT variant_id, n, v, list_transform(range(n), lambda j: {_DRAW}) AS h FROM sb),
ss AS (SELECT variant_id, n, list_sum(list_transform(h, lambda x: v[1 + ((x * x % 2147483647) * (x * x % 2147483647) + 11 * x + 7) % 2147483647 % n])) AS s FROM sh)
SELECT variant_id, MAX(n) AS sessions, {_r6('QUANTILE_CONT(s, 0.025)')} AS p025, {_r6('QUANTILE_CONT(s, 0.5)')} AS p50, {_r6('QUANTILE_CONT(s, 0.975)')} AS p975, {_r6('AVG(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END)')} AS positive FROM ss GROUP BY variant_id"""
)
def h14_bootstrap_100000(spark, sf_dir):
    """100,000 resamples of the monthly returns of five streams."""
    lines = table(spark, sf_dir, "lineitem")
    r = lines.groupBy((F.col("l_suppkey") % 5).alias("variant_id"), F.trunc("l_shipdate", "month").alias("session")).agg((F.avg("l_discount") - 0.05).alias("daily_return"))
    out = statistics.session_bootstrap(r, 100_000)
    return out.select("variant_id", "sessions", *[six(F.col(c)).alias(c) for c in ("p025", "p50", "p975", "positive")])


# ---- the sweep: 4 lookbacks, 3 windows of volatility, 3 sizes and 2 cadences over weekly bars of names that grow with the suppliers

_GRID = {"lookback": [4, 8, 13, 26], "volatility": [4, 8, 16], "top_n": [1, 2, 4], "every": [1, 4]}
_NAMES = "(SELECT GREATEST(10, COUNT(*) // 10) FROM supplier)"
_GROWING = f"lg AS (SELECT * REPLACE (l_suppkey % {_NAMES} AS l_suppkey) FROM lineitem), " + bars_sql("weekly10").replace("% 10 AS k", "AS k").replace("FROM lineitem", "FROM lg")
_GRID_SQL = " CROSS JOIN ".join(f"(SELECT UNNEST({v}) AS {k}) {k[0]}t" for k, v in _GRID.items())
_SWEEP = f"""WITH {_GROWING}, {PANEL_SQL}, va AS (SELECT ROW_NUMBER() OVER (ORDER BY lookback, volatility, top_n, every) - 1 AS variant_id, * FROM {_GRID_SQL}),
dk AS (SELECT timestamp, ROW_NUMBER() OVER (ORDER BY timestamp) - 1 AS k FROM (SELECT DISTINCT timestamp FROM bars)),
pk AS (SELECT p.*, k, LEAD(open, 2) OVER w / LEAD(open, 1) OVER w - 1 AS forward, {', '.join(f'close / LAG(close, {v}) OVER w - 1 AS m{v}' for v in _GRID['lookback'])},
  {', '.join(f'CASE WHEN COUNT(r) OVER (PARTITION BY symbol ORDER BY p.timestamp ROWS BETWEEN {v - 1} PRECEDING AND CURRENT ROW) = {v} THEN STDDEV_SAMP(r) OVER (PARTITION BY symbol ORDER BY p.timestamp ROWS BETWEEN {v - 1} PRECEDING AND CURRENT ROW) * SQRT(252.0) END AS v{v}' for v in _GRID['volatility'])}
  FROM p JOIN dk ON dk.timestamp = p.timestamp WINDOW w AS (PARTITION BY symbol ORDER BY p.timestamp)),
sg AS ({' UNION ALL '.join(f'SELECT k, symbol, {a} AS lookback, {b} AS volatility, m{a} / NULLIF(v{b}, 0) AS score FROM pk' for a in _GRID['lookback'] for b in _GRID['volatility'])}),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k, lookback, volatility ORDER BY ROUND(score, 9) DESC, symbol) AS rank FROM sg WHERE score > 0),
ch AS (SELECT variant_id, rk.k, every, symbol, 0.9 / COUNT(*) OVER (PARTITION BY variant_id, rk.k) AS w FROM rk JOIN va USING (lookback, volatility) WHERE rank <= top_n AND rk.k % every = 0),
ws AS (SELECT va.variant_id, pk.k, pk.symbol, pk.forward, COALESCE(ch.w, 0) AS w FROM pk CROSS JOIN va LEFT JOIN ch ON ch.variant_id = va.variant_id AND ch.symbol = pk.symbol AND ch.k = pk.k - pk.k % va.every),
wt AS (SELECT *, w - LAG(w, 1, 0) OVER (PARTITION BY variant_id, symbol ORDER BY k) AS d FROM ws),
rt AS (SELECT variant_id, k, SUM(w * COALESCE(forward, 0)) - SUM(ABS(d)) * 0.001 AS r, SUM(ABS(d)) AS turnover, COUNT(*) FILTER (WHERE ABS(d) > 1e-12) AS orders FROM wt GROUP BY 1, 2),
fd AS (SELECT *, CASE WHEN k + 1 <= LEAST(GREATEST(FLOOR(COUNT(*) OVER (PARTITION BY variant_id) * 0.7 + 1e-9), 1), COUNT(*) OVER (PARTITION BY variant_id) - 1) THEN 'train' ELSE 'test' END AS fold FROM rt),
eq AS (SELECT *, EXP(SUM(LN(1 + r)) OVER (PARTITION BY variant_id, fold ORDER BY k)) AS e FROM fd), dd AS (SELECT *, e / MAX(e) OVER (PARTITION BY variant_id, fold ORDER BY k) - 1 AS dr FROM eq),
me AS (SELECT variant_id, fold, ARG_MAX(e, k) - 1 AS tr, COALESCE(AVG(r) * SQRT(252.0) / NULLIF(STDDEV_POP(r), 0), 0) AS sh, MIN(dr) AS md FROM dd GROUP BY 1, 2),
yr AS (SELECT GREATEST(DATE_DIFF('day', MIN(timestamp), MAX(timestamp)), 1) / 365.25 AS years FROM dk), tt AS (SELECT variant_id, SUM(turnover) AS turnover, SUM(orders) AS orders FROM rt GROUP BY 1),
al AS (SELECT va.variant_id, lookback, volatility, top_n, every, a.tr AS train_return, a.sh AS train_sharpe, a.md AS train_max_drawdown, b.tr AS test_return, b.sh AS test_sharpe, b.md AS test_max_drawdown, turnover / years AS annual_turnover, CAST(orders AS BIGINT) AS orders, LEAST(a.sh, b.sh) AS robust_score
  FROM va JOIN me a ON a.variant_id = va.variant_id AND a.fold = 'train' JOIN me b ON b.variant_id = va.variant_id AND b.fold = 'test' JOIN tt ON tt.variant_id = va.variant_id, yr)
SELECT variant_id, lookback, volatility, top_n, every, orders, ROW_NUMBER() OVER (ORDER BY ROUND(robust_score, 9) DESC, ROUND(test_sharpe, 9) DESC, variant_id) AS place,
  {', '.join(f'{_r6(c)} AS {c}' for c in ('train_return', 'train_sharpe', 'train_max_drawdown', 'test_return', 'test_sharpe', 'test_max_drawdown', 'annual_turnover', 'robust_score'))} FROM al"""


def growing_panel(spark, sf_dir):
    """Weekly bars of suppliers / 10 names (ten at least), a row for each week and name, stored."""
    names = F.greatest(F.lit(10), F.floor(F.count(F.lit(1)) / 10)).alias("_names")
    many = table(spark, sf_dir, "supplier").agg(names)  # one row
    lines = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(many)).withColumn("l_suppkey", F.col("l_suppkey") % F.col("_names"))
    return _stored(densify(bars_of(spark, lines, "weekly10", 1 << 62)))


@query(_SWEEP)
def h05_parameter_sweep(spark, sf_dir):
    """72 variants of momentum from signal to train and test metrics, ranked by the lesser Sharpe."""
    out = W.sweep(growing_panel(spark, sf_dir), statistics.grid(spark, _GRID), 0.7, 0.9, 10.0)
    return out.select(*[six(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# ---- all gates over the variants of the sweep, and control of false discoveries among those that pass

_GATES = ("return", "sharpe", "stability", "drawdown", "turnover", "alpha", "beta", "cost_stress")
_TESTS = ("test_return > 0", "test_sharpe >= 0.3", "stability >= 0", "max_drawdown >= -0.35", "annual_turnover <= 50", "alpha > 0", "abs_beta <= 1.5", "stressed_return > 0")
_PROMOTION = (
    _SWEEP.split(",\nfd AS")[0]
    + f""",
ca AS (SELECT k, timestamp, k + 1 AS place, COUNT(*) OVER () AS n FROM dk), cu AS (SELECT *, LEAST(GREATEST(FLOOR(n * 0.6), 1), n - 2) AS one FROM ca), cv AS (SELECT *, LEAST(GREATEST(FLOOR(n * 0.8), one + 1), n - 1) AS two FROM cu),
cf AS (SELECT k, timestamp, CASE WHEN place <= one THEN 'train' WHEN place <= two THEN 'val' ELSE 'test' END AS fold FROM cv), bm AS (SELECT k, forward AS b FROM pk WHERE symbol = 'S0'),
rb AS (SELECT rt.variant_id, rt.k, timestamp, fold, r, turnover, b FROM rt JOIN cf USING (k) LEFT JOIN bm USING (k)),
pe AS (SELECT *, EXP(SUM(LN(1 + r)) OVER (PARTITION BY variant_id, fold ORDER BY k)) AS e FROM rb), pd AS (SELECT *, e / MAX(e) OVER (PARTITION BY variant_id, fold ORDER BY k) - 1 AS dr FROM pe),
pm AS (SELECT variant_id, fold, COUNT(*) AS n, ARG_MAX(e, k) - 1 AS tr, COALESCE(AVG(r) * SQRT(252.0) / NULLIF(STDDEV_POP(r), 0), 0) AS sh, MIN(dr) AS md, COALESCE(COVAR_POP(r, b) / NULLIF(VAR_POP(b), 0), 0) AS beta, AVG(r) AS mr, AVG(b) AS mb,
  EXP(SUM(LN(1 + r - turnover * 0.0005))) - 1 AS stressed FROM pd GROUP BY 1, 2),
pt AS (SELECT variant_id, SUM(turnover) * 365.25 / GREATEST(DATE_DIFF('day', MIN(timestamp), MAX(timestamp)), 1) AS annual_turnover FROM rb GROUP BY 1),
pg AS (SELECT t.variant_id, t.n AS test_n, t.tr AS test_return, t.sh AS test_sharpe, LEAST(t.sh, v.sh) AS stability, t.md AS max_drawdown, annual_turnover, (t.mr - t.beta * t.mb) * 252 AS alpha, ABS(t.beta) AS abs_beta, t.stressed AS stressed_return
  FROM pm t JOIN pm v ON v.variant_id = t.variant_id AND v.fold = 'val' JOIN pt ON pt.variant_id = t.variant_id WHERE t.fold = 'test'),
ph AS (SELECT *, list_filter([{', '.join(f"CASE WHEN NOT COALESCE({t}, FALSE) THEN '{g}' END" for g, t in zip(_GATES, _TESTS, strict=True))}], lambda x: x IS NOT NULL) AS failed, ABS(test_sharpe / SQRT(252.0) * SQRT(test_n) / SQRT(2.0)) AS az FROM pg),
pi AS (SELECT *, 1 / (1 + 0.3275911 * az) AS t FROM ph), pj AS (SELECT *, 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * EXP(-az * az) AS tail FROM pi),
pv AS (SELECT *, CASE WHEN test_n < 2 THEN 1.0 WHEN test_sharpe >= 0 THEN tail ELSE 1 - tail END AS p_value FROM pj),
fk AS (SELECT variant_id, p_value, ROW_NUMBER() OVER (ORDER BY p_value, variant_id) AS k, COUNT(*) OVER () AS m FROM pv WHERE len(failed) = 0), fz AS (SELECT variant_id, COALESCE(k <= MAX(CASE WHEN p_value <= 0.2 * k / m THEN k END) OVER (), FALSE) AS kept FROM fk)"""
)
_SHOWN = ("test_return", "test_sharpe", "stability", "max_drawdown", "annual_turnover", "alpha", "abs_beta", "stressed_return")


def _promotion_metrics(spark, sf_dir):
    panel = growing_panel(spark, sf_dir)
    from barlake.operators.evaluate import holding_returns

    market = holding_returns(panel).where("symbol = 'S0'").select("timestamp", F.col("forward").alias("benchmark_return"))
    returns = _stored(W.sweep_returns(panel, statistics.grid(spark, _GRID), 0.9, 10.0).join(market, "timestamp", "left"))
    return statistics.promotion_metrics(returns)


@query(f"{_PROMOTION} SELECT variant_id, array_to_string(failed, ',') AS failed, CASE WHEN len(failed) = 0 THEN 'pass' ELSE 'fail' END AS verdict, {', '.join(f'{_r6(c)} AS {c}' for c in _SHOWN)} FROM pv")
def h15_gates_of_sweep(spark, sf_dir):
    """All eight gates over the variants of the sweep, with what they read."""
    out = statistics.gates(_promotion_metrics(spark, sf_dir), statistics.PROMOTION_GATES)
    return out.select("variant_id", F.array_join("failed", ",").alias("failed"), "verdict", *[six(F.col(c)).alias(c) for c in _SHOWN])


@query(
    f"""{_PROMOTION} SELECT pv.variant_id, {_r6('p_value')} AS p_value, CASE WHEN len(failed) > 0 THEN array_to_string(failed, ',') WHEN kept THEN '' ELSE 'fails_fdr' END AS failed, CASE WHEN COALESCE(kept, FALSE) THEN 'promote' ELSE 'reject' END AS verdict
FROM pv LEFT JOIN fz ON fz.variant_id = pv.variant_id"""
)
def h18_promotion_of_sweep(spark, sf_dir):
    """The variants of the sweep that pass all gates and the control of false discoveries."""
    out = statistics.promote_batch(_promotion_metrics(spark, sf_dir), 0.2)
    return out.select("variant_id", six(F.col("p_value")).alias("p_value"), F.array_join("failed", ",").alias("failed"), "verdict")


#: The same from the daily returns of suppliers, bought once at 10 bps, beside those of every tenth supplier.
_HELD = (
    f"""WITH {_CUST}, dk AS (SELECT timestamp, ROW_NUMBER() OVER (ORDER BY timestamp) - 1 AS k FROM (SELECT DISTINCT timestamp FROM ret)), hr AS (SELECT variant_id, timestamp, CASE WHEN timestamp = MIN(timestamp) OVER (PARTITION BY variant_id) THEN 1.0 ELSE 0.0 END AS turnover, daily_return FROM ret),
hb AS (SELECT CAST(l_shipdate AS DATE) AS timestamp, AVG(l_discount) - 0.05 AS forward FROM lineitem WHERE l_suppkey % 10 = 0 GROUP BY 1), pk AS (SELECT k, 'S0' AS symbol, forward FROM hb JOIN dk USING (timestamp)), rt AS (SELECT variant_id, k, daily_return - turnover * 0.001 AS r, turnover FROM hr JOIN dk USING (timestamp)),
ca AS"""
    + _PROMOTION.split("\nca AS")[1]
)
ORACLES["h15_promotion_gates_all_eight"] = f"{_HELD} SELECT variant_id, array_to_string(failed, ',') AS failed, CASE WHEN len(failed) = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM pv"


@query(
    f"""{_HELD} SELECT pv.variant_id, {_r6('p_value')} AS p_value, CASE WHEN len(failed) > 0 THEN array_to_string(failed, ',') WHEN kept THEN '' ELSE 'fails_fdr' END AS failed, CASE WHEN COALESCE(kept, FALSE) THEN 'promote' ELSE 'reject' END AS verdict
FROM pv LEFT JOIN fz ON fz.variant_id = pv.variant_id""".replace("0.2 * k / m", "0.4 * k / m")
)
def h18_promotion_all_gates(spark, sf_dir):
    """Suppliers as variants: some pass all gates and the control of false discoveries."""
    out = statistics.promote_batch(statistics.promotion_metrics(held_suppliers(spark, sf_dir)), 0.4)
    return out.select("variant_id", six(F.col("p_value")).alias("p_value"), F.array_join("failed", ",").alias("failed"), "verdict")
