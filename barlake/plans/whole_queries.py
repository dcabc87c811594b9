"""Whole operators where earlier queries hold a part: entries, books, sleeves, diagnostics, walk-forward, exits, universes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.functions import features as Y
from barlake.operators import diagnostics as D
from barlake.operators import intraday as I
from barlake.operators import orders, tables, universe
from barlake.operators import portfolio as P
from barlake.operators import preprocess as R
from barlake.operators import session_entries as S
from barlake.operators import weights as W

from .intraday_queries import _VW
from .model_queries import _stored
from .portfolio_queries import _FILED, _RATIOS, _filings, _known_sql, _r6, _weekly, _win, _z, six
from .registry import panel_of, query, table, with_panel
from .session_bars import BENCHMARK, SESSION_SQL, session_bars
from .signal_queries import _REL, _shown
from .strategy_queries import _S, _SCORE, _TOP, _scores

_W = "OVER (PARTITION BY symbol, session ORDER BY timestamp)"
_ROWS = f"{SESSION_SQL}, {_VW}, {_REL}".replace("'view'", f"'{BENCHMARK}'")


def _all_six(df):
    return df.select(*[six(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- entries and books of a session

def _entry_sql(r: S.Entry) -> str:
    sign, side = (1, ">=") if r.continuation else (-1, "<=")
    return f"""WITH {_ROWS}, r1 AS (SELECT *, {sign} * relative AS score, close / LAG(close) {_W} - 1 AS last_move FROM rr),
ok AS (SELECT session FROM r1 WHERE symbol = '{BENCHMARK}' AND clock = {r.signal} AND close >= vwap),
ch AS (SELECT symbol, session, ROW_NUMBER() OVER (PARTITION BY session ORDER BY ROUND(score, 9) DESC, symbol) AS k FROM r1 WHERE clock = {r.signal} AND symbol <> '{BENCHMARK}' AND score >= {r.threshold} AND close {side} vwap AND close * volume >= {r.min_dollars}
  {'AND last_move > 0' if r.recovery else ''} {'AND session IN (SELECT session FROM ok)' if r.market else ''}),
cw AS (SELECT symbol, session, LEAST({r.cap}, {r.gross} / COUNT(*) OVER (PARTITION BY session)) AS w FROM ch WHERE k <= {r.top_n})
SELECT r1.timestamp, r1.symbol, {_r6(f'CASE WHEN clock < {r.flat} THEN w ELSE 0.0 END')} AS target_weight, {_r6('score')} AS score FROM r1 JOIN cw ON cw.symbol = r1.symbol AND cw.session = r1.session WHERE clock BETWEEN {r.signal} AND {r.flat}"""


_REVERSAL = S.Entry(750, 870, 2, 0.0001, 3, 0.3, 0.8, 9_000_000.0, False, True)
_RECOVERY = S.Entry(750, 870, 2, 0.0001, 3, 0.3, 0.8, 5_000_000.0, True, False)
_CONTINUATION = S.Entry(750, 870, 2, 0.0001, 3, 0.3, 0.8, 9_000_000.0, False, True, True)


@query(_entry_sql(_REVERSAL))
def e14_relative_reversal(spark, sf_dir):
    return _shown(S.daily_entries(_stored(session_bars(spark, sf_dir)), _REVERSAL, BENCHMARK))


@query(_entry_sql(_RECOVERY))
def e14_recovering_reversal(spark, sf_dir):
    return _shown(S.daily_entries(_stored(session_bars(spark, sf_dir)), _RECOVERY, BENCHMARK))


@query(_entry_sql(_CONTINUATION))
def e15_relative_continuation(spark, sf_dir):
    return _shown(S.daily_entries(_stored(session_bars(spark, sf_dir)), _CONTINUATION, BENCHMARK))


def _book_sql(r: S.Book) -> str:
    high, low = (1.0, -1.0) if r.momentum else (-1.0, 1.0)
    return f"""WITH {_ROWS}, r1 AS (SELECT *, relative AS score, SUM(close * volume) {_W} AS dollars FROM rr),
a AS (SELECT * FROM r1 WHERE clock = {r.signal} AND symbol <> '{BENCHMARK}' AND score IS NOT NULL AND dollars >= {r.min_dollars} AND ABS(score) >= {r.min_score}),
b AS (SELECT symbol, session, LEAST({r.per_side}, COUNT(*) OVER (PARTITION BY session) // 2) AS side, ROW_NUMBER() OVER (PARTITION BY session ORDER BY ROUND(score, 9) DESC, symbol) AS hi, ROW_NUMBER() OVER (PARTITION BY session ORDER BY ROUND(score, 9), symbol DESC) AS lo FROM a),
c AS (SELECT symbol, session, CASE WHEN hi <= side THEN {high} WHEN lo <= side THEN {low} END AS sg FROM b),
d AS (SELECT symbol, session, sg * LEAST({r.cap}, {r.gross} / COUNT(*) OVER (PARTITION BY session)) AS w FROM c WHERE sg IS NOT NULL)
SELECT r1.timestamp, r1.symbol, {_r6(f'CASE WHEN clock < {r.flat} THEN w ELSE 0.0 END')} AS target_weight, {_r6('score')} AS score FROM r1 JOIN d ON d.symbol = r1.symbol AND d.session = r1.session WHERE clock BETWEEN {r.signal} AND {r.flat}"""


_MOMENTUM = S.Book(750, 870, 2, 2, 0.2, 0.8, 30_000_000.0, 0.0001)
_REVERSED = S.Book(750, 960, 3, 1, 0.5, 0.8, 10_000_000.0, 0.0, False)


@query(_book_sql(_MOMENTUM))
def e20_momentum_book(spark, sf_dir):
    return _shown(S.ranked_book(_stored(session_bars(spark, sf_dir)), _MOMENTUM, BENCHMARK))


@query(_book_sql(_REVERSED).replace("LAG(close, 2)", "LAG(close, 3)"))
def e20_reversal_book(spark, sf_dir):
    return _shown(S.ranked_book(_stored(session_bars(spark, sf_dir)), _REVERSED, BENCHMARK))


# ---- a core and its sleeve

_SLEEVES = ((0, 0.01, 0.05, 12), (1, 0.2, None, 20))
_CORE = f"""{_SCORE}, {_TOP}, gr AS (SELECT * FROM (VALUES {', '.join(f"({v}, {b}, {'NULL' if t is None else t}, {k})" for v, b, t, k in _SLEEVES)}) t(variant_id, band, target, lookback)),
tw AS (SELECT timestamp, symbol, 1.0 / COUNT(*) OVER (PARTITION BY timestamp) AS w FROM top),
li AS (SELECT p.timestamp, ROW_NUMBER() OVER (ORDER BY p.timestamp) - 1 AS k, LIST(p.symbol ORDER BY p.symbol) AS names, LIST(COALESCE(w, 0.0) ORDER BY p.symbol) AS want, LIST(COALESCE(r, 0.0) ORDER BY p.symbol) AS moves
  FROM p LEFT JOIN tw ON tw.timestamp = p.timestamp AND tw.symbol = p.symbol WHERE p.symbol NOT IN ('S0', 'S9') GROUP BY p.timestamp),
fo AS (SELECT variant_id, CAST(-1 AS BIGINT) AS k, CAST(NULL AS DATE) AS timestamp, (SELECT names FROM li LIMIT 1) AS names, list_transform((SELECT names FROM li LIMIT 1), lambda x: CAST(0 AS DOUBLE)) AS now, CAST([] AS DOUBLE[]) AS past FROM gr
  UNION ALL SELECT variant_id, k, timestamp, names, CASE WHEN k % 4 <> 0 THEN now ELSE list_transform(n3, lambda v: CASE WHEN v > 1e-12 THEN v ELSE 0 END) END, past FROM (
    SELECT *, CASE WHEN target IS NOT NULL AND len(past) >= lookback AND list_stddev_pop(past) > 0 THEN list_transform(n2, lambda v: v * LEAST(1.0, target / (list_stddev_pop(past) * SQRT(252.0)))) ELSE n2 END AS n3 FROM (
      SELECT *, CASE WHEN list_sum(n1) > 0.6 THEN list_transform(n1, lambda v: v * (0.6 / list_sum(n1))) ELSE n1 END AS n2 FROM (
        SELECT gr.variant_id, gr.target, gr.lookback, li.k, li.timestamp, li.names, fo.now, list_transform(range(1, len(want) + 1), lambda i: CASE WHEN ABS(want[i] - fo.now[i]) < band THEN fo.now[i] ELSE want[i] END) AS n1,
          (fo.past || [list_sum(list_transform(range(1, len(want) + 1), lambda i: fo.now[i] * moves[i]))])[-gr.lookback:] AS past FROM fo JOIN li ON li.k = fo.k + 1 JOIN gr ON gr.variant_id = fo.variant_id)))),
un AS (SELECT variant_id, timestamp, UNNEST(names) AS symbol, UNNEST(now) AS target_weight FROM fo WHERE k >= 0 UNION ALL SELECT variant_id, timestamp, symbol, CASE symbol WHEN 'S0' THEN 0.3 ELSE 0.0 END FROM p CROSS JOIN gr WHERE symbol IN ('S0', 'S9'))"""


@query(with_panel(f"SELECT variant_id, timestamp, symbol, {_r6('target_weight')} AS target_weight FROM un", "weekly10", _CORE).replace("WITH", "WITH RECURSIVE", 1))
def e09_core_and_sleeve(spark, sf_dir):
    """A core of 30 % beside a sleeve of 60 % that trades outside of a band, once to a target of its volatility."""
    s = _scores(spark, sf_dir)
    t = s.select("timestamp", "symbol", "r").join(W.top_n(s, 3).select("timestamp", "symbol", "target_weight"), ["timestamp", "symbol"], "left").withColumn("target_weight", F.coalesce("target_weight", F.lit(0.0)))
    one, two = (P.core_and_sleeve(t.withColumn("variant_id", F.lit(v)), "S0", 0.3, 0.6, band, 4, target, k, ("S9",)) for v, band, target, k in _SLEEVES)
    return _all_six(one.union(two))


# ---- walk-forward with turnover, regimes

_MONTHS = """mr AS (SELECT l_suppkey % 10 AS variant_id, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS timestamp, (AVG(l_discount) - 0.05) * 0.987654321 AS daily_return, COUNT(*) % 7 * 0.1 AS turnover FROM lineitem GROUP BY 1, 2), my AS (SELECT *, CAST(EXTRACT(year FROM timestamp) AS INTEGER) AS y FROM mr)"""


def _metrics_sql(rows: str, keys: str) -> str:
    return f"""(SELECT {keys}, COUNT(*) AS n, ARG_MAX(e, timestamp) - 1 AS total_return, COALESCE(AVG(daily_return) * SQRT(252.0) / NULLIF(STDDEV_POP(daily_return), 0), 0) AS sharpe, MIN(e / m - 1) AS max_drawdown,
  SUM(turnover) * 365.25 / GREATEST(DATE_DIFF('day', MIN(timestamp), MAX(timestamp)), 1) AS annual_turnover FROM (SELECT *, MAX(e) OVER (PARTITION BY {keys} ORDER BY timestamp) AS m FROM (SELECT *, EXP(SUM(LN(1 + daily_return)) OVER (PARTITION BY {keys} ORDER BY timestamp)) AS e FROM {rows})) GROUP BY {keys})"""


def _months(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    by = [(F.col("l_suppkey") % 10).alias("variant_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("timestamp")]
    return lines.groupBy(*by).agg(((F.avg("l_discount") - 0.05) * 0.987654321).alias("daily_return"), (F.count(F.lit(1)) % 7 * 0.1).alias("turnover"))


@query(
    f"""WITH {_MONTHS}, fo AS (SELECT DISTINCT y AS year FROM my WHERE y - 3 >= (SELECT MIN(y) FROM my)), tr AS (SELECT fo.year, my.* FROM my JOIN fo ON my.y BETWEEN fo.year - 3 AND fo.year - 1),
me AS {_metrics_sql('tr', 'variant_id, year')}, ch AS (SELECT *, sharpe - 0.25 * ABS(max_drawdown) - 0.01 * annual_turnover AS objective FROM me), wi AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY year ORDER BY ROUND(objective, 9) DESC, variant_id) AS k FROM ch) WHERE k = 1),
te AS (SELECT wi.year, my.* FROM my JOIN wi ON wi.variant_id = my.variant_id AND wi.year = my.y), tm AS {_metrics_sql('te', 'variant_id, year')}
SELECT wi.year, wi.variant_id, {_r6('objective')} AS objective, {_r6('wi.sharpe')} AS train_sharpe, {_r6('wi.max_drawdown')} AS train_max_drawdown, {_r6('tm.total_return')} AS test_return, {_r6('tm.sharpe')} AS test_sharpe, {_r6('tm.max_drawdown')} AS test_max_drawdown FROM wi JOIN tm ON tm.variant_id = wi.variant_id AND tm.year = wi.year"""
)
def h07_walk_forward_turnover(spark, sf_dir):
    return _all_six(D.walk_forward(_months(spark, sf_dir)))


_REGIMES = (("early", "1992-01-01", "1994-12-31"), ("middle", "1995-01-01", "1996-12-31"), ("late", "1996-07-01", "1999-01-01"))


@query(
    f"""WITH {_MONTHS}, rg AS (SELECT * FROM (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _REGIMES)}) t(regime, a, b)), rr AS (SELECT regime, my.* FROM my JOIN rg ON timestamp BETWEEN a AND b), me AS {_metrics_sql('rr', 'variant_id, regime')}
SELECT variant_id, regime, n, {', '.join(f'{_r6(c)} AS {c}' for c in ('total_return', 'sharpe', 'max_drawdown', 'annual_turnover'))} FROM me"""
)
def h09_regime_table(spark, sf_dir):
    regimes = spark.createDataFrame(_REGIMES, "name string, start string, end string").selectExpr("name", "date(start) AS start", "date(end) AS end")
    return _all_six(D.regime_table(_months(spark, sf_dir), regimes).select("variant_id", "regime", "n", "total_return", "sharpe", "max_drawdown", "annual_turnover"))


# ---- positions

_POS = """ps AS (SELECT l_suppkey % 20 AS variant_id, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey % 12 AS VARCHAR) AS position, 'Y' || CAST(l_partkey % 12 AS VARCHAR) AS symbol, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS session, l_extendedprice * (l_discount - 0.0456789) AS p, l_extendedprice * 2 AS g FROM lineitem),
po AS (SELECT variant_id, position || '-' || CAST(session AS VARCHAR) AS position, symbol, session, ROUND(SUM(p), 4) AS pnl, SUM(g) AS gross_notional FROM ps GROUP BY ALL)"""


def _positions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    part = (F.col("l_partkey") % 12).cast("string")
    session = F.to_date(F.date_trunc("month", "l_shipdate"))
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), part, session.cast("string"))
    by = [(F.col("l_suppkey") % 20).alias("variant_id"), name.alias("position"), F.concat(F.lit("Y"), part).alias("symbol"), session.alias("session")]
    return lines.groupBy(*by).agg(F.round(F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.0456789)), 4).alias("pnl"), F.sum(F.col("l_extendedprice") * 2).alias("gross_notional"))


_UNITS = f"""{_POS}, un AS ({' UNION ALL '.join(f"SELECT variant_id, '{u}' AS unit, CAST({u} AS VARCHAR) AS name, SUM(pnl) AS pnl FROM po GROUP BY 1, 3" for u in ('position', 'symbol', 'session'))}),
lo AS (SELECT *, pnl / NULLIF(SUM(pnl) OVER w, 0) AS share, (SUM(pnl) OVER w - pnl) / 1000000.0 AS return_without, ROW_NUMBER() OVER (PARTITION BY variant_id, unit ORDER BY ROUND(pnl, 6) DESC, name) AS place FROM un WINDOW w AS (PARTITION BY variant_id, unit))"""


@query(f"WITH {_UNITS} SELECT variant_id, unit, name, place, {_r6('return_without')} AS return_without, {_r6('share')} AS share FROM lo WHERE unit <> 'position' OR place <= 50")
def h13_leave_out_returns(spark, sf_dir):
    """What each symbol, session and one of the 50 best positions (a report) of a variant is worth to it."""
    out = D.leave_out(_positions(spark, sf_dir), 1_000_000.0).where("unit <> 'position' or place <= 50")
    return _all_six(out.drop("pnl"))


def _skew_sql(x: str) -> str:
    return f"CASE WHEN COUNT({x}) > 2 THEN SKEWNESS({x}) END"


@query(
    f"""WITH {_UNITS}, ow AS (SELECT variant_id, COUNT(*) AS positions, AVG(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, {_skew_sql('pnl / NULLIF(gross_notional / 2, 0)')} AS position_skew, SUM(pnl) / 1000000.0 AS total_return FROM po GROUP BY 1),
be AS (SELECT variant_id, SUM(share) FILTER (WHERE unit = 'position' AND place <= 1) AS top_position_share, SUM(share) FILTER (WHERE unit = 'position' AND place <= 3) AS top_positions_share, SUM(share) FILTER (WHERE unit = 'symbol' AND place <= 3) AS top_symbols_share,
  (SUM(pnl) FILTER (WHERE unit = 'symbol') - SUM(pnl) FILTER (WHERE unit = 'position' AND place <= 3)) / 1000000.0 AS return_without_positions, (SUM(pnl) FILTER (WHERE unit = 'symbol' AND place > 3)) / 1000000.0 AS return_without_symbols FROM lo GROUP BY 1),
ss AS (SELECT v.variant_id, s.session, COALESCE(SUM(pnl), 0) / 1000000.0 AS d FROM (SELECT DISTINCT variant_id FROM po) v CROSS JOIN (SELECT DISTINCT CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS session FROM lineitem) s LEFT JOIN po ON po.variant_id = v.variant_id AND po.session = s.session GROUP BY 1, 2),
sl AS (SELECT *, CASE WHEN ABS(d) > 1e-12 THEN d END AS a, {', '.join(f'LAG(d, {k}) OVER (PARTITION BY variant_id ORDER BY session) AS l{k}' for k in (1, 2, 3))} FROM ss),
sr AS (SELECT variant_id, COUNT(*) AS sessions, COUNT(a) AS active_sessions, AVG(CASE WHEN a IS NULL THEN 0.0 ELSE 1.0 END) AS active_rate, {_skew_sql('a')} AS active_skew, {', '.join(f'CORR(d, l{k}) AS autocorrelation_{k}' for k in (1, 2, 3))} FROM sl GROUP BY 1)
SELECT variant_id, positions, sessions, active_sessions, {', '.join(f'{_r6(c)} AS {c}' for c in ('win_rate', 'position_skew', 'total_return', 'top_position_share', 'top_positions_share', 'top_symbols_share', 'return_without_positions', 'return_without_symbols', 'active_rate', 'active_skew', 'autocorrelation_1', 'autocorrelation_2', 'autocorrelation_3'))}
FROM ow JOIN be USING (variant_id) JOIN sr USING (variant_id)"""
)
def h13_position_report(spark, sf_dir):
    positions = _stored(_positions(spark, sf_dir))
    sessions = table(spark, sf_dir, "lineitem").select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("session")).distinct()
    return _all_six(D.position_report(positions, sessions, 1_000_000.0))


# ---- exits, universes, rebalances, roll-ups, fills

@query(
    with_panel(
        f"""SELECT timestamp, symbol, CASE WHEN gap >= 2 THEN 0.0 ELSE w END AS weight, CASE WHEN out THEN CASE WHEN w < 0 THEN 'buy' ELSE 'sell' END END AS side, {_r6('CASE WHEN out THEN last * CASE WHEN w < 0 THEN 1.1 ELSE 0.9 END END')} AS exit_price,
  {_r6('CASE WHEN out THEN -ABS(w) * 0.1 END')} AS exit_return, CASE WHEN out THEN 'missing_price_forced_exit' END AS exit_reason FROM (SELECT *, gap = 2 AND w <> 0 AS out FROM (SELECT *, CASE WHEN close IS NULL THEN seq - seen END AS gap, CASE WHEN symbol IN ('S1', 'S4') THEN -0.05 WHEN symbol = 'S2' THEN 0.0 ELSE 0.1 END AS w
  FROM (SELECT *, MAX(CASE WHEN close IS NOT NULL THEN seq END) OVER (PARTITION BY symbol ORDER BY seq) AS seen, LAST_VALUE(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq) AS last FROM q)))""",
        extra=f"q AS (SELECT timestamp, symbol, close, ROW_NUMBER() OVER ({_S}) AS seq FROM p)",
    )
)
def g07_forced_exits(spark, sf_dir):
    """Long, short and empty holdings of names whose closes are missing, with side, price, cost and reason."""
    p = panel_of(spark, sf_dir)
    w = F.when(F.col("symbol").isin("S1", "S4"), -0.05).when(F.col("symbol") == "S2", 0.0).otherwise(0.1)
    return _all_six(D.forced_exits(p, p.select("timestamp", "symbol", w.alias("weight")), 2, 0.1))


@query(
    f"""WITH ev AS (SELECT UPPER(event_type) AS symbol, COUNT(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1), rq AS (SELECT c_custkey AS candidate_id, c_custkey % 5 AS k FROM customer),
al AS (SELECT LIST(symbol ORDER BY n DESC, symbol) AS a FROM ev), bo AS (SELECT candidate_id, k, CASE k WHEN 0 THEN 'config' WHEN 1 THEN 'config' WHEN 2 THEN 'bundle_symbol_list' ELSE 'research_broad_pit' END AS source,
  CASE k WHEN 0 THEN list_filter(a, lambda x: x IN ('CLICK', 'ERROR')) WHEN 1 THEN [] WHEN 2 THEN list_filter(a, lambda x: x IN ('SIGNUP')) ELSE a END[1:3] AS symbols FROM rq, al)
SELECT candidate_id, source, len(symbols) > 0 AS ok, CASE WHEN len(symbols) > 0 THEN 'bound ' || CAST(len(symbols) AS VARCHAR) || ' symbols' ELSE 'config symbols not present in bars' END AS reason, array_to_string(symbols, ',') AS symbols FROM bo"""
)
def f12_bound_universes(spark, sf_dir):
    """Configured lists, wanted lists and all names, in this order of precedence, for requests of every kind."""
    k = F.col("c_custkey") % 5
    lists = lambda *values: F.array(*map(F.lit, values))
    configured = F.when(k == 0, lists("click", "ERROR", "view")).when(k == 1, lists("nowhere"))
    wanted = F.when(k == 1, lists("click")).when(k == 2, lists("SYM04", "SignUp", "view", "none")).when(k == 3, lists("SYM01", "sym2"))
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), configured.alias("configured"), wanted.alias("wanted"))
    bars = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"))
    return tables.bind_universes(requests, bars, "VIEW", 3).withColumn("symbols", F.array_join("symbols", ","))


@query(
    """WITH s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem), l AS (SELECT o_custkey AS account, MAX(CAST(o_orderdate AS DATE)) AS last_rebalance, ARG_MAX('v' || CAST(o_orderkey % 2 AS VARCHAR), (CAST(o_orderdate AS DATE), o_orderkey % 2)) AS was FROM orders GROUP BY 1),
c AS (SELECT account, COUNT(session) AS n FROM l LEFT JOIN s ON session > last_rebalance GROUP BY 1), a AS (SELECT c_custkey AS account, 'v' || CAST(c_custkey % 2 AS VARCHAR) AS strategy FROM customer)
SELECT a.account, strategy, CASE WHEN was = strategy THEN n ELSE 120 END AS sessions_since, NOT COALESCE(was = strategy, FALSE) OR n >= 120 AS due FROM a LEFT JOIN l ON l.account = a.account LEFT JOIN c ON c.account = a.account"""
)
def j06_strategy_change(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    name = lambda x: F.concat(F.lit("v"), (F.col(x) % 2).cast("string")).alias("strategy")
    last = o.select(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("last_rebalance"), name("o_orderkey"))
    sessions = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session"))
    return tables.strategy_rebalance_due(sessions, last, c.select(F.col("c_custkey").alias("account"), name("c_custkey")), 120)


@query(
    f"""WITH {SESSION_SQL}, br AS (SELECT timestamp, close / LAG(close) OVER (ORDER BY timestamp) - 1 AS b FROM rb WHERE symbol = '{BENCHMARK}'), cv AS (SELECT session, rb.timestamp, AVG(close) AS equity, MAX(b) AS b FROM rb LEFT JOIN br ON br.timestamp = rb.timestamp GROUP BY 1, 2),
dd AS (SELECT session, ARG_MAX(equity, timestamp) AS equity, EXP(SUM(LN(1 + COALESCE(b, 0)))) - 1 AS b FROM cv GROUP BY 1) SELECT session, {_r6('equity')} AS equity, {_r6('COALESCE(equity / LAG(equity) OVER (ORDER BY session) - 1, 0)')} AS daily_return, {_r6('b')} AS benchmark_return FROM dd"""
)
def b05_rollup_with_benchmark(spark, sf_dir):
    from pyspark.sql.window import Window

    b = _stored(session_bars(spark, sf_dir))
    market = b.where(F.col("symbol") == BENCHMARK).select("timestamp", (F.col("close") / F.lag("close").over(Window.orderBy("timestamp")) - 1).alias("benchmark_return"))
    curve = b.join(market, "timestamp", "left").groupBy("session", "timestamp").agg(F.avg("close").alias("equity"), F.max("benchmark_return").alias("benchmark_return"))
    return _all_six(I.session_rollup_with_benchmark(curve))


@query(
    """WITH od AS (SELECT o_orderkey AS client_order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM orders),
fi AS (SELECT l_orderkey AS client_order_id, l_linenumber AS seen_at, l_quantity AS filled_quantity, ROUND(30.0 * (1 + l_tax / 100), 6) AS price FROM lineitem), fl AS (SELECT client_order_id, MAX(filled_quantity) AS filled_quantity, MAX(price) AS price FROM (SELECT *, DENSE_RANK() OVER (PARTITION BY client_order_id ORDER BY seen_at DESC, filled_quantity DESC) AS k FROM fi) WHERE k = 1 GROUP BY 1 HAVING COUNT(*) = 1)
SELECT od.client_order_id, ROUND(filled_quantity / 50.0, 6) AS fill_rate, ROUND(CASE side WHEN 'buy' THEN 1.0 ELSE -1.0 END * (price - 30.0) / 30.0 * 10000, 4) AS shortfall_bps FROM od JOIN fl USING (client_order_id)"""
)
def f03_latest_fills(spark, sf_dir):
    """Shortfall by the last report of each order; orders whose last report is given twice are left to the other queries."""
    fills = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("client_order_id"), F.col("l_linenumber").alias("seen_at"), F.col("l_quantity").alias("filled_quantity"), F.round(30.0 * (1 + F.col("l_tax") / 100), 6).alias("filled_average_price"))
    twice = fills.groupBy("client_order_id", "seen_at", "filled_quantity").agg(F.count(F.lit(1)).alias("n"))
    last = orders.latest_fills(fills)
    last = last.join(twice.where("n > 1"), ["client_order_id", "seen_at", "filled_quantity"], "left_anti")
    plan = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("client_order_id"), F.when(F.col("o_orderkey") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(50.0).alias("quantity"), F.lit(30.0).alias("reference_price"))
    out = orders.implementation_shortfall(plan, last).where("not missed")
    return out.select("client_order_id", F.round("fill_rate", 6).alias("fill_rate"), F.round("shortfall_bps", 4).alias("shortfall_bps"))


# ---- settings of bundles, scores that stay null

_SETTINGS = ('{"winsorize": false}', '{"cross_sectional_zscore": false, "winsorize": true}', "{}", '[{"kind": "Winsor_2pct"}, {"op": "znorm"}]', '[{"op": "rank"}]', '["winsor"]', '"none"', '{"winsorize": 0, "cross_sectional_zscore": null}')
_WANTS = ((False, True), (True, False), (True, True), (True, True), (False, False), (True, True), (True, True), (False, False))
_STEPS_SQL = f"""vt AS (SELECT * FROM (VALUES {', '.join(f'({i}, {w}, {z})' for i, (w, z) in enumerate(_WANTS))}) t(variant_id, winsor, zscore)),
c0 AS (SELECT timestamp, symbol, CASE WHEN COUNT(r) OVER (PARTITION BY timestamp) >= 0.5 * COUNT(*) OVER (PARTITION BY timestamp) THEN r END AS r FROM p),
c1 AS (SELECT *, CASE WHEN r IS NOT NULL THEN LEAST(GREATEST(r, QUANTILE_CONT(r, 0.02) OVER (PARTITION BY timestamp)), QUANTILE_CONT(r, 0.98) OVER (PARTITION BY timestamp)) END AS rw FROM c0),
c2 AS (SELECT variant_id, timestamp, symbol, zscore, CASE WHEN winsor THEN rw ELSE r END AS x FROM c1 CROSS JOIN vt)"""


@query(with_panel(f"SELECT variant_id, timestamp, symbol, {_r6('CASE WHEN zscore THEN (x - AVG(x) OVER w) / NULLIF(STDDEV_SAMP(x) OVER w, 0) ELSE x END')} AS value FROM c2 WINDOW w AS (PARTITION BY variant_id, timestamp)", "weekly10", _STEPS_SQL))
def c31_bundle_settings(spark, sf_dir):
    """Preprocessing as the settings of bundles ask for it, as objects, lists and neither."""
    settings = spark.createDataFrame(list(enumerate(_SETTINGS)), "variant_id int, json string").select("variant_id", R.bundle_steps(F.col("json")).alias("s"))
    out = R.preprocess_variants(panel_of(spark, sf_dir, "weekly10"), "r", settings.select("variant_id", "s.*"))
    return out.withColumn("value", six(F.col("value")))


@query(
    with_panel(
        f"""SELECT timestamp, symbol, {_r6(f'0.2 * {_z("gross_profitability")} + 0.2 * {_z("cash_profitability")} - 0.2 * {_z("accruals")} - 0.2 * {_z("leverage")} - 0.2 * {_z("share_growth")}')} AS quality_score,
  {_r6(f'0.5 * {_z("revenue_growth")} + 0.5 * {_z("earnings_growth")}')} AS earnings_score FROM kw""",
        "weekly10",
        _FILED + f""", kn AS (SELECT timestamp, symbol, {", ".join(f"{_known_sql(c)} AS {c}" for c in _RATIOS)} FROM p),
kc AS (SELECT * REPLACE (CASE WHEN revenue_growth IS NOT NULL THEN LEAST(GREATEST(revenue_growth, -5), 5) END AS revenue_growth, CASE WHEN earnings_growth IS NOT NULL THEN LEAST(GREATEST(earnings_growth, -5), 5) END AS earnings_growth) FROM kn),
kw AS (SELECT timestamp, symbol, {", ".join(map(_win, _RATIOS))} FROM kc)""",
    )
)
def d12_scores_with_nulls(spark, sf_dir):
    known = universe.as_of(_weekly(spark, sf_dir).select("timestamp", "symbol"), _filings(spark, sf_dir), list(_RATIOS))
    return _all_six(Y.fundamental_scores(known, fill=False).select("timestamp", "symbol", "quality_score", "earnings_score"))
