"""Queries of selections that keep what they hold: 20 variants of their limits over names that grow with the suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlake.functions.factors import ts_returns
from barlake.operators import portfolio, selection
from barlake.operators.sweep import momentum_signals

from .model_queries import _GROWING, _stored, growing_panel
from .registry import PANEL_SQL, query

_GRID = [(i, c, n, x, s) for i, (c, (n, x), s) in enumerate((c, nx, s) for c in (-0.1, 0.0, 0.05, 0.2, 0.5) for nx in ((2, 4), (3, 5)) for s in (1, 2))]
_NAMES = "variant_id int, max_corr double, n int, exit_rank int, per_sector int"
_VALUES = ", ".join(map(str, _GRID))

#: Every fourth week the names with a positive score of 13 weeks over their deviation of 16; three sectors. A rival list per name and limit,
#: then a recursion over dates: the names held, walked as a list of one-element lists.
_BASE = f"""{_GROWING}, {PANEL_SQL}, gr AS (SELECT * FROM (VALUES {_VALUES}) t(variant_id, max_corr, n, exit_rank, per_sector)),
dk AS (SELECT timestamp, ROW_NUMBER() OVER (ORDER BY timestamp) - 1 AS k FROM (SELECT DISTINCT timestamp FROM bars)),
sc AS (SELECT p.timestamp, symbol, k, r, (close / LAG(close, 13) OVER w - 1) / NULLIF(CASE WHEN COUNT(r) OVER v = 16 THEN STDDEV_SAMP(r) OVER v * SQRT(252.0) END, 0) AS score FROM p JOIN dk ON dk.timestamp = p.timestamp
  WINDOW w AS (PARTITION BY symbol ORDER BY p.timestamp), v AS (PARTITION BY symbol ORDER BY p.timestamp ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)),
ra AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY ROUND(score, 9) DESC, symbol) AS rank, 'G' || CAST(CAST(SUBSTR(symbol, 2) AS INT) % 3 AS VARCHAR) AS sector, CAST(SUBSTR(symbol, 2) AS INT) % 7 <> 3 AS usable FROM sc WHERE score > 0 AND k % 4 = 0),
co AS (SELECT x.k, x.symbol, y.symbol AS other, CORR(a.r, b.r) AS corr FROM ra x JOIN ra y ON y.k = x.k AND y.symbol <> x.symbol JOIN sc a ON a.symbol = x.symbol AND a.k BETWEEN x.k - 25 AND x.k JOIN sc b ON b.symbol = y.symbol AND b.k = a.k AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) >= 20),
rv AS (SELECT variant_id, k, symbol, LIST(other) AS rivals FROM co JOIN gr ON corr > max_corr WHERE tested GROUP BY 1, 2, 3),
li AS (SELECT ra.k // 4 AS d, ra.timestamp, gr.variant_id, gr.n, gr.exit_rank, gr.per_sector, LIST({{'symbol': ra.symbol, 'sector': sector, 'rank': rank, 'usable': usable, 'rivals': COALESCE(rivals, CAST([] AS VARCHAR[]))}} ORDER BY rank) AS names
  FROM ra CROSS JOIN gr LEFT JOIN rv ON rv.variant_id = gr.variant_id AND rv.k = ra.k AND rv.symbol = ra.symbol GROUP BY ra.k, ra.timestamp, gr.variant_id, gr.n, gr.exit_rank, gr.per_sector),
al AS (SELECT q.variant_id, q.d, timestamp, n, exit_rank, per_sector, names FROM (SELECT variant_id, UNNEST(RANGE((SELECT MAX(k) // 4 + 1 FROM dk))) AS d FROM gr) q LEFT JOIN li ON li.variant_id = q.variant_id AND li.d = q.d),
fo AS (SELECT variant_id, CAST(-1 AS BIGINT) AS d, CAST(NULL AS DATE) AS timestamp, CAST([] AS VARCHAR[]) AS held FROM gr
  UNION ALL SELECT variant_id, d, timestamp, CASE WHEN names IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_transform(list_filter(two, lambda e: e.usable), lambda e: e.symbol) END FROM (
    SELECT *, list_reduce(list_prepend(one, list_transform(names, lambda e: [e])), lambda acc, x: CASE WHEN len(acc) < n AND NOT list_contains(list_transform(acc, lambda e: e.symbol), x[1].symbol) AND len(list_filter(acc, lambda e: e.sector = x[1].sector)) < per_sector THEN acc || x ELSE acc END) AS two FROM (
      SELECT *, list_reduce(list_prepend(names[1:0], list_transform(kept || names[1:GREATEST(3 * exit_rank, 5 * n)], lambda e: [e])), lambda acc, x: CASE WHEN len(acc) < n AND NOT list_contains(list_transform(acc, lambda e: e.symbol), x[1].symbol) AND len(list_filter(acc, lambda e: e.sector = x[1].sector)) < per_sector
        AND NOT list_has_any(x[1].rivals, list_transform(acc, lambda e: e.symbol)) THEN acc || x ELSE acc END) AS one FROM (
        SELECT al.*, list_filter(list_transform(fo.held, lambda h: list_filter(names, lambda e: e.symbol = h AND e.rank <= exit_rank)[1]), lambda e: e IS NOT NULL) AS kept FROM fo JOIN al ON al.variant_id = fo.variant_id AND al.d = fo.d + 1))))
SELECT variant_id, timestamp, UNNEST(held) AS symbol, UNNEST(RANGE(len(held))) AS place FROM fo WHERE timestamp IS NOT NULL"""


def _inputs(spark, sf_dir):
    panel = growing_panel(spark, sf_dir)
    days = panel.select("timestamp").distinct().withColumn("_k", F.row_number().over(Window.orderBy("timestamp")) - 1)
    dates = days.where("_k % 4 = 0").select("timestamp")
    rank = F.row_number().over(Window.partitionBy("timestamp").orderBy(F.round("score", 9).desc(), "symbol"))
    number = F.substring("symbol", 2, 9).cast("int")
    signals = momentum_signals(panel, [(13, 16)]).join(F.broadcast(dates), "timestamp", "left_semi")
    grid = spark.createDataFrame(_GRID, _NAMES)
    pools = signals.select("timestamp", "symbol", rank.alias("rank"), F.concat(F.lit("G"), (number % 3).cast("string")).alias("sector"), (number % 7 != 3).alias("usable"))
    ranked = _stored(selection.candidates(pools, grid))
    return panel.withColumn("r", ts_returns("close", 1)), ranked.where("walked"), ranked.drop("walked").crossJoin(F.broadcast(grid)), dates  # the grid has 20 rows


def _shown(held):
    return held.withColumn("place", F.col("place").cast("long"))


@query("WITH RECURSIVE " + _BASE.replace("WHERE tested", "WHERE FALSE"))
def e05_buffered_variants(spark, sf_dir):
    """20 variants of size, exit rank and sector limit, folded in runs, without a test of correlations."""
    _, _, rows, dates = _inputs(spark, sf_dir)
    return _shown(selection.select_held(rows, dates))


@query("WITH RECURSIVE " + _BASE.replace("WHERE tested", ""))
def e06_decorrelated_variants(spark, sf_dir):
    """The same with five limits on correlations over 26 weeks, and the limit of the pool."""
    panel, walked, rows, dates = _inputs(spark, sf_dir)
    pairs = portfolio.trailing_pairs(panel.select("timestamp", "symbol", "r"), walked, "r", 26, 20)
    return _shown(selection.select_held(rows, dates, pairs))
