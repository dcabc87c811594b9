"""Queries of confirmed intraday signals, the index sleeve and session-flat evaluation."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlake.operators import confirmed as C
from barlake.operators import index_sleeve as S
from barlake.operators import intraday as I
from barlake.operators import portfolio as P

from barlake.sources import bars as B

from .intraday_queries import _DAY, _RB, _VW, _W, _bars15, _daily_sql, _ntz
from .portfolio_queries import _r6, six
from .registry import query, register
from .strategy_queries import _rounded
from .table_queries import _resample_sql, _ticks

_B = "'view'"
_BY = "OVER (PARTITION BY symbol ORDER BY session)"


def _shown(df, *keys):
    return _ntz(df.select(*[six(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


def _last(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY session ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_CLOSES = f"""sc AS (SELECT symbol, session, ARG_MAX(close, timestamp) AS c FROM rb GROUP BY 1, 2),
sd AS (SELECT symbol, session, LAG(c) {_BY} AS prior_close, LAG(c) {_BY} / LAG(c, 2) {_BY} - 1 AS prior_return FROM sc),
se AS (SELECT *, CASE WHEN COUNT(prior_close) {_last(5)} = 5 THEN AVG(prior_close) {_last(5)} END AS trend_average,
  CASE WHEN COUNT(prior_return) {_last(5)} = 5 THEN STDDEV_POP(prior_return) {_last(5)} END * SQRT(252.0) AS daily_volatility FROM sd)"""


@query(f"WITH {_RB}, {_CLOSES} SELECT symbol, session, prior_close, {_r6('prior_return')} AS prior_return, {_r6('trend_average')} AS trend_average, {_r6('daily_volatility')} AS daily_volatility FROM se")
def d19_session_closes(spark, sf_dir):
    out = C.session_closes(_bars15(spark, sf_dir), 5, 5)
    return out.select("symbol", "session", "prior_close", *[six(F.col(c)).alias(c) for c in ("prior_return", "trend_average", "daily_volatility")])


_REL = f"""rh AS (SELECT oe.*, close / LAG(close, 2) {_W} - 1 AS horizon FROM oe),
rr AS (SELECT rh.*, rh.horizon - b.horizon AS relative FROM rh LEFT JOIN rh b ON b.timestamp = rh.timestamp AND b.symbol = {_B}),
sg AS (SELECT * FROM rr WHERE clock = 765 AND symbol <> {_B}),
sv AS (SELECT *, LAG(volume) {_BY} AS pv, LAG(-relative) {_BY} AS pd FROM sg),
ss AS (SELECT *, volume / NULLIF(CASE WHEN COUNT(pv) {_last(3)} = 3 THEN MEDIAN(pv) {_last(3)} END, 0) AS relative_volume,
  -relative / NULLIF(CASE WHEN COUNT(pd) {_last(2)} = 2 THEN STDDEV_POP(pd) {_last(2)} END, 0) AS dislocation_sigma FROM sv)"""


@query(f"WITH {_RB}, {_VW}, {_REL} SELECT timestamp, symbol, {_r6('relative')} AS relative FROM rr")
def d17_relative_return(spark, sf_dir):
    return _shown(C.relative_return(_bars15(spark, sf_dir), 2, "view").select("timestamp", "symbol", "relative"))


@query(f"WITH {_RB}, {_VW}, {_REL} SELECT symbol, session, {_r6('relative_volume')} AS relative_volume, {_r6('dislocation_sigma')} AS dislocation_sigma FROM ss")
def d22_same_clock_surprise(spark, sf_dir):
    rows = C.relative_return(_bars15(spark, sf_dir), 2, "view").withColumn("clock", I.clock())
    at = rows.where("clock = 765 and symbol <> 'view'")
    return _shown(C.same_clock(at, 3, 2).select("symbol", "session", "relative_volume", "dislocation_sigma"))


@query(f"WITH {_RB} SELECT timestamp, symbol, {_r6(f'SUM(close * volume) {_W}')} AS value FROM rb")
def d18_cumulative_dollar_volume(spark, sf_dir):
    b = _bars15(spark, sf_dir)
    return _shown(b.select("timestamp", "symbol", F.sum(F.col("close") * F.col("volume")).over(I.in_session()).alias("value")))


#: Rules small enough for the few names of the events, and what they add to the SQL.
_BASE = C.Confirmed(signal=765, lookback=2, dislocation=0.0001, top_n=2, cap=0.2, gross=0.3)
_RULES = {
    "e16_confirmed_reversal": (dataclasses.replace(_BASE, short=False, confirm_above_vwap=True), "", "k.close > s.high AND k.close >= k.vwap", ""),
    "e17_short_continuation": (_BASE, "", "k.close < s.low", ""),
    "e17_trend": (dataclasses.replace(_BASE, trend_sessions=5), " AND se.prior_close < se.trend_average", "k.close < s.low", ""),
    "e17_quiet_break": (dataclasses.replace(_BASE, volume_sessions=3, volume_most=1.5, confirm_break=0.0001), " AND relative_volume >= 0 AND relative_volume <= 1.5", "k.close < s.low * (1 - 0.0001)", ""),
    "e17_sigma": (dataclasses.replace(_BASE, sigma_sessions=2, sigma_least=0.2), " AND dislocation_sigma >= 0.2", "k.close < s.low", "dislocation_sigma"),
    "e17_stable_breadth": (dataclasses.replace(_BASE, volatility_sessions=5, volatility_most=5.0, breadth=0.1), " AND daily_volatility <= 5.0", "k.close < s.low", ""),
}


def _confirmed_sql(rule: C.Confirmed, extra: str, ok: str, score: str) -> str:
    side = "-1.0" if rule.short else "1.0"
    market = f" AND s.session IN (SELECT session FROM rr WHERE clock = 780 AND symbol <> {_B} GROUP BY session HAVING AVG(CASE WHEN close >= vwap THEN 1.0 ELSE 0.0 END) >= {rule.breadth})" if rule.breadth else ""
    return f"""WITH {_RB}, {_VW}, {_REL}, {_CLOSES},
ca AS (SELECT s.session, s.symbol, ROUND({score or '-relative'}, 9) AS score, s.low, s.high FROM ss s JOIN se ON se.symbol = s.symbol AND se.session = s.session WHERE ROUND(-relative, 9) >= 0.0001 AND s.close <= s.vwap{extra}),
cb AS (SELECT s.session, s.symbol, score FROM ca s JOIN rr k ON k.session = s.session AND k.symbol = s.symbol AND k.clock = 780 WHERE {ok}{market}),
cc AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS k FROM cb),
cd AS (SELECT session, symbol, score, {side} * LEAST(0.2, 0.3 / COUNT(*) OVER (PARTITION BY session)) AS w FROM cc WHERE k <= 2)
SELECT oe.timestamp, oe.symbol, {_r6('CASE WHEN clock < 945 THEN w ELSE 0.0 END')} AS target_weight, {_r6('score')} AS score FROM oe JOIN cd ON cd.symbol = oe.symbol AND cd.session = oe.session WHERE clock >= 780"""


def _hourly_sql(sql: str) -> str:
    for a, b in ((_RB, _RB.replace(_resample_sql(15), _resample_sql(60))), ("765", "690"), ("780", "750"), (f"LAG(close, 2) {_W} - 1 AS horizon", f"LAG(close, 1) {_W} - 1 AS horizon")):
        sql = sql.replace(a, b)
    return sql


for _name, (_rule, _extra, _ok, _score) in _RULES.items():
    _sql = _confirmed_sql(_rule, _extra, _ok, _score)
    if _name in ("e17_sigma", "e17_stable_breadth"):  # the events are too few for histories of quarter hours
        _rule, _sql = dataclasses.replace(_rule, signal=690, bar_minutes=60, lookback=1), _hourly_sql(_sql)
    _minutes = _rule.bar_minutes
    register(_name, lambda spark, sf_dir, rule=_rule, n=_minutes: _shown(C.confirmed_targets(_rounded(B.resample_sessions(_ticks(spark, sf_dir), n)), rule, "view")), _sql)


@query()
def e18_diversified_pick(spark, sf_dir):
    """The session's falls, picked so that no two move together."""
    b = _bars15(spark, sf_dir)
    at = C.relative_return(b, 2, "view").withColumn("clock", I.clock()).where("clock = 765 and symbol <> 'view' and relative is not null")
    return _shown(C.diversified_pick(at.select("session", "symbol", F.round(-F.col("relative"), 9).alias("score")), b, 2, 10, 0.2))


@query()
def e13_rotating_selection(spark, sf_dir):
    """Relative strength, two exit ranks; a variant's session is a group of its own."""
    rows = I.session_vwap(C.relative_return(_bars15(spark, sf_dir), 1, "view")).withColumn("clock", I.clock())
    market = rows.where("symbol = 'view'").select("timestamp", (F.col("close") >= F.col("vwap")).alias("market_up"))
    rows = rows.where("symbol <> 'view'").join(market, "timestamp")
    score = F.when((F.col("relative") > 0) & (F.col("close") >= F.col("vwap")), F.round("relative", 9))
    rows = rows.withColumn("_s", score).withColumn("rank", F.when(F.col("_s").isNotNull(), F.row_number().over(Window.partitionBy("timestamp").orderBy(F.col("_s").desc_nulls_last(), "symbol"))))
    ranked = rows.select(F.lit(0).alias("variant_id"), "session", "timestamp", "clock", "symbol", "rank", "market_up")
    out = C.rotating_selection(ranked, 2, 3, 2, 600, 930, 945, 0.3)
    return _shown(out)


# ---- the index sleeve

_SF = f"""sf AS (SELECT oe.session, oe.timestamp, oe.clock, LEAD(oe.open) {_W.replace('symbol, session', 'oe.symbol, oe.session').replace('BY timestamp', 'BY oe.timestamp')} AS next_open, oe.opening_return AS open_trend, oe.efficiency,
  oe.close / LAG(oe.close, 2) {_W.replace('symbol, session', 'oe.symbol, oe.session').replace('BY timestamp', 'BY oe.timestamp')} - 1 AS recent, oe.close / oe.vwap - 1 AS vwap_trend, dz.first_open / dz.prior_close - 1 AS gap, dz.prior_return
  FROM oe JOIN dz ON dz.symbol = oe.symbol AND dz.session = oe.session WHERE oe.symbol = 'click')"""
_FRAME = f"{_RB}, {_VW}, {_DAY}, {_SF}"


def _frame(spark, sf_dir):
    return S.signal_frame(_bars15(spark, sf_dir).where("symbol = 'click'"))


@query(f"WITH {_FRAME} SELECT timestamp, next_open, {', '.join(f'{_r6(c)} AS {c}' for c in S.SIGNALS)} FROM sf")
def d24_signal_frame(spark, sf_dir):
    return _shown(_frame(spark, sf_dir).select("timestamp", "next_open", *S.SIGNALS))


@query(
    f"""WITH {_FRAME}, sq AS (SELECT *, ROUND(open_trend, 9) AS s, ABS(ROUND(open_trend, 9)) * 10000 AS bps FROM sf),
sw AS (SELECT *, CASE WHEN clock IN (630, 720) AND s IS NOT NULL THEN CASE WHEN COALESCE(efficiency >= 0.2, FALSE) THEN SIGN(s) * CASE WHEN bps <= 1 THEN 0.02 ELSE 0.02 + LEAST((bps - 1) / 9.0, 1.0) * (CASE WHEN s > 0 THEN 0.1 ELSE 0.06 END - 0.02) END ELSE 0.0 END END AS sz FROM sq)
SELECT timestamp, 'click' AS symbol, {_r6('CASE WHEN clock >= 930 THEN 0.0 ELSE COALESCE(LAST_VALUE(sz IGNORE NULLS) OVER (PARTITION BY session ORDER BY timestamp), 0.0) END')} AS target_weight, {_r6('open_trend')} AS score FROM sw"""
)
def e21_index_targets(spark, sf_dir):
    return _shown(S.index_targets(_bars15(spark, sf_dir), "click", (630, 720), 930, {"least_bps": 1.0, "long": 0.1, "short": 0.06, "weak": 0.02, "full_bps": 10.0}, 0.2))


_GRID = "vr AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY feature, signal, exit, direction, threshold_bps) - 1 AS INTEGER) AS variant_id, * FROM (SELECT UNNEST(['gap', 'open_trend', 'prior_return', 'recent', 'vwap_trend']) AS feature) CROSS JOIN (SELECT UNNEST([615, 645]) AS signal) CROSS JOIN (SELECT UNNEST([915, 930]) AS exit) CROSS JOIN (SELECT UNNEST(['reversal', 'trend']) AS direction) CROSS JOIN (SELECT UNNEST([0.0, 2.0]) AS threshold_bps))"
_SLEEVE = f"""lf AS ({" UNION ALL ".join(f"SELECT session, clock, next_open, '{c}' AS feature, {c} AS score FROM sf" for c in S.SIGNALS)}),
sl AS (SELECT v.variant_id, l.session, l.score, l.next_open AS en, x.next_open AS ex, ABS(l.score) * 10000 >= threshold_bps AS strong, SIGN(l.score) * CASE WHEN direction = 'reversal' THEN -1.0 ELSE 1.0 END AS sd
  FROM lf l JOIN vr v ON v.feature = l.feature AND v.signal = l.clock LEFT JOIN sf x ON x.session = l.session AND x.clock = v.exit),
sm AS (SELECT *, CASE WHEN COALESCE(score IS NOT NULL AND en > 0 AND ex > 0 AND strong, FALSE) THEN sd ELSE 0.0 END AS side FROM sl),
sr AS (SELECT variant_id, session, side, CASE WHEN side > 0 THEN 0.05 * (ex * (1 - 0.0002) / (en * (1 + 0.0002)) - 1) WHEN side < 0 THEN 0.05 * ((en * (1 - 0.0002) - ex * (1 + 0.0002)) / en) ELSE 0.0 END AS sleeve_return FROM sm)"""


def _variants(spark):
    from barlake.operators.statistics import grid

    rows = grid(spark, {"feature": sorted(S.SIGNALS), "signal": [615, 645], "exit": [915, 930], "direction": ["reversal", "trend"], "threshold_bps": [0.0, 2.0]})
    return rows.withColumn("signal", F.col("signal").cast("int")).withColumn("exit", F.col("exit").cast("int"))


@query(f"WITH {_FRAME}, {_GRID}, {_SLEEVE} SELECT variant_id, session, ROUND(sleeve_return, 8) + 0.0 AS sleeve_return, side + 0.0 AS side FROM sr")
def g06_sleeve_returns(spark, sf_dir):
    out = S.sleeve_returns(_frame(spark, sf_dir), _variants(spark), 2.0)
    return out.select("variant_id", "session", (F.round("sleeve_return", 8) + 0.0).alias("sleeve_return"), (F.col("side") + 0.0).alias("side"))


_PERIODS = "pe AS (SELECT * FROM (VALUES ('train', DATE '2024-01-01', DATE '2024-01-15'), ('validation', DATE '2024-01-16', DATE '2024-01-23'), ('test', DATE '2024-01-24', DATE '2024-02-10')) v(period, a, b))"
_SUMMARY = f"""pq AS (SELECT variant_id, period, session, sleeve_return AS r, EXP(SUM(LN(1 + sleeve_return)) OVER (PARTITION BY variant_id, period ORDER BY session)) AS e FROM sr JOIN pe ON session BETWEEN a AND b),
pr AS (SELECT *, e / MAX(e) OVER (PARTITION BY variant_id, period ORDER BY session) - 1 AS d FROM pq),
pz AS (SELECT variant_id, period, COUNT(*) AS n, ARG_MAX(e, session) - 1 AS total_return, COALESCE(AVG(r) / NULLIF(STDDEV_POP(r), 0) * SQRT(252.0), 0) AS sharpe, MIN(d) AS max_drawdown FROM pr GROUP BY 1, 2)"""


def _periods(spark):
    return spark.sql("SELECT * FROM VALUES ('train', DATE '2024-01-01', DATE '2024-01-15'), ('validation', DATE '2024-01-16', DATE '2024-01-23'), ('test', DATE '2024-01-24', DATE '2024-02-10') AS v(period, start, end)")


def _returns(spark, sf_dir):
    return S.sleeve_returns(_frame(spark, sf_dir), _variants(spark), 2.0)


@query(f"WITH {_FRAME}, {_GRID}, {_SLEEVE}, {_PERIODS}, {_SUMMARY} SELECT variant_id, period, n, {', '.join(f'{_r6(c)} AS {c}' for c in ('total_return', 'sharpe', 'max_drawdown'))} FROM pz")
def h19_period_summary(spark, sf_dir):
    return _shown(S.period_summary(_returns(spark, sf_dir), _periods(spark)))


@query(
    f"""WITH {_FRAME}, {_GRID}, {_SLEEVE}, {_PERIODS}, {_SUMMARY},
q AS (SELECT variant_id, {", ".join(f"MAX(CASE WHEN period = '{p}' THEN {c} END) AS {p}_{c}" for p in ("train", "validation") for c in ("sharpe", "total_return"))} FROM pz GROUP BY 1),
a AS (SELECT variant_id, AVG(CASE WHEN side <> 0 THEN 1.0 ELSE 0.0 END) AS active_rate FROM sr GROUP BY 1),
o AS (SELECT q.*, active_rate, CASE WHEN train_sharpe IS NULL THEN validation_sharpe WHEN validation_sharpe IS NULL THEN train_sharpe ELSE LEAST(train_sharpe, validation_sharpe) END AS selection_score,
  COALESCE(active_rate >= 0.3 AND train_total_return > 0 AND validation_total_return > 0, FALSE) AS eligible FROM q JOIN a ON a.variant_id = q.variant_id)
SELECT variant_id, {", ".join(f"{_r6(c)} AS {c}" for c in ("train_sharpe", "train_total_return", "validation_sharpe", "validation_total_return", "active_rate", "selection_score"))}, eligible,
  CAST(ROW_NUMBER() OVER (ORDER BY eligible DESC, ROUND(selection_score, 9) DESC NULLS LAST, ROUND(validation_sharpe, 9) DESC NULLS LAST, ROUND(train_sharpe, 9) DESC NULLS LAST, variant_id) AS INTEGER) AS place FROM o"""
)
def h20_sleeve_screen(spark, sf_dir):
    return _shown(S.screen(_returns(spark, sf_dir), _periods(spark), 0.3))


# ---- evaluation

_FLAT = f"""tg AS ({_daily_sql(True)}),
fx AS (SELECT rb.symbol, rb.session, rb.timestamp, rb.open, rb.close, COALESCE(tg.target_weight, 0.0) AS t FROM rb LEFT JOIN tg ON tg.timestamp = rb.timestamp AND tg.symbol = rb.symbol),
fy AS (SELECT *, COALESCE(LAG(t) {_W}, 0.0) AS w, LEAD(open) {_W} AS nx FROM fx),
fz AS (SELECT *, ABS(w - LAG(w, 1, 0.0) {_W}) + CASE WHEN nx IS NULL THEN ABS(w) ELSE 0 END AS c, COALESCE(CASE WHEN nx IS NULL THEN close ELSE nx END / NULLIF(open, 0), 1.0) AS g FROM fy),
fr AS (SELECT session, timestamp, SUM(w * (g - 1)) - SUM(c) * 0.0002 AS bar_return, SUM(ABS(w)) AS gross_exposure, SUM(c) AS turnover FROM fz GROUP BY 1, 2)"""


def _flat(spark, sf_dir):
    b = _bars15(spark, sf_dir)
    t = I.once_daily_reversal(b, 630, 945, 0.0005, 3, 0.4, continuation=True).withColumn("target_weight", F.round("target_weight", 6))
    return P.session_flat_returns(b, t, 2.0)


@query(f"WITH {_RB}, {_FLAT} SELECT session, timestamp, ROUND(bar_return, 8) + 0.0 AS bar_return, {_r6('gross_exposure')} AS gross_exposure, {_r6('turnover')} AS turnover FROM fr")
def g04_session_flat_bars(spark, sf_dir):
    return _ntz(_flat(spark, sf_dir).select("session", "timestamp", (F.round("bar_return", 8) + 0.0).alias("bar_return"), six(F.col("gross_exposure")).alias("gross_exposure"), six(F.col("turnover")).alias("turnover")))


@query(f"WITH {_RB}, {_FLAT} SELECT session, ROUND(EXP(SUM(LN(1 + bar_return))) - 1, 8) + 0.0 AS daily_return, {_r6('SUM(turnover)')} AS turnover FROM fr GROUP BY session")
def g04_session_flat_returns(spark, sf_dir):
    out = P.session_returns(_flat(spark, sf_dir))
    return out.select("session", (F.round("daily_return", 8) + 0.0).alias("daily_return"), six(F.col("turnover")).alias("turnover"))


# ---- the rolling regression

_SETUP = f"""nx2 AS (SELECT oe.*, LEAD(open) {_W} AS nxt FROM oe), s1 AS (SELECT * FROM ss),
k1 AS (SELECT * FROM nx2 WHERE clock = 780), d1 AS (SELECT symbol, session, ARG_MIN(open, timestamp) AS o, ARG_MAX(close, timestamp) AS c FROM rb GROUP BY 1, 2),
mk AS (SELECT k1.session, k1.close / d1.o - 1 AS b FROM k1 JOIN d1 ON d1.symbol = k1.symbol AND d1.session = k1.session WHERE k1.symbol = {_B})"""


@query(
    f"""WITH {_RB}, {_VW}, {_REL}, {_CLOSES}, {_SETUP} SELECT s.session, s.symbol, {_r6('-s.relative')} AS relative_dislocation, {_r6('k.close / d.o - 1 - b')} AS session_relative_return, {_r6('k.close / k.vwap - 1')} AS vwap_distance,
  {_r6('s.relative_volume')} AS signal_relative_volume, {_r6('se.prior_close / se.trend_average - 1')} AS prior_trend_gap, {_r6('k.close / s.close - 1')} AS confirmation_return, {_r6('b')} AS benchmark_session_return, {_r6('d.c / k.nxt - 1')} AS label
FROM s1 s JOIN k1 k ON k.symbol = s.symbol AND k.session = s.session JOIN d1 d ON d.symbol = s.symbol AND d.session = s.session JOIN se ON se.symbol = s.symbol AND se.session = s.session JOIN mk ON mk.session = s.session"""
)
def d25_setup_features(spark, sf_dir):
    from barlake.operators import rolling_model

    return _shown(rolling_model.setup_features(_bars15(spark, sf_dir), "view", 765, 780, 2, 3, 5))


@query()
def e19_rolling_regression(spark, sf_dir):
    """A ridge of two bar features on the rest of the session, fitted on the sessions before, and its calibrated picks."""
    from barlake.operators import rolling_model

    b = I.opening_efficiency(I.session_vwap(_bars15(spark, sf_dir))).withColumn("clock", I.clock())
    close = b.groupBy("symbol", "session").agg(F.max_by("close", "timestamp").alias("c"))
    rows = b.where("clock >= 630 and clock < 780").join(close, ["symbol", "session"]).groupBy("session", "symbol").agg(
        F.max_by("opening_return", "timestamp").alias("x1"), F.max_by((F.col("close") / F.col("vwap") - 1), "timestamp").alias("x2"), F.max_by(F.col("c") / F.col("close") - 1, "timestamp").alias("label")
    )
    found = rolling_model.rolling_ridge(rows, ("x1", "x2"), 20, 5, 15, 0.5)
    return rolling_model.calibrated_pick(found, found.where("prediction is not null"), 2, 0.0, 20, 5).select("session", "symbol", six(F.col("prediction")).alias("prediction"))
