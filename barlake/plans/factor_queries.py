"""Queries of the factor functions over the derived bars, each with its SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlake.functions import factors as X
from barlake.operators import preprocess

from .registry import panel_of, query, register, with_panel

_S = "PARTITION BY symbol ORDER BY timestamp"


def _w(n: int) -> str:
    return f"OVER ({_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN COUNT({x}) {_w(n)} = {n} THEN {agg} {_w(n)} END"


_X = "OVER (PARTITION BY timestamp)"
_RANK = "CASE WHEN close IS NOT NULL THEN RANK() OVER (PARTITION BY timestamp ORDER BY close NULLS LAST) + (COUNT(close) OVER (PARTITION BY timestamp, close) - 1) / 2.0 END"
_WINSOR = "CASE WHEN r IS NOT NULL THEN LEAST(GREATEST(r, QUANTILE_CONT(r, {p}) OVER (PARTITION BY timestamp)), QUANTILE_CONT(r, 1 - {p}) OVER (PARTITION BY timestamp)) END"
_DOWN = "CASE WHEN r < 0 THEN r ELSE 0 END"
_CORR = (
    f"CASE WHEN COUNT(close + volume) {_w(5)} = 5 THEN COVAR_POP(close, volume) {_w(5)}"
    f" / NULLIF(STDDEV_POP(CASE WHEN volume IS NOT NULL THEN close END) {_w(5)} * STDDEV_POP(CASE WHEN close IS NOT NULL THEN volume END) {_w(5)}, 0) END"
)

#: name: (column, SQL expression over p)
FACTORS: dict[str, tuple[Callable[[], Column], str]] = {
    "c01_ts_delay": (lambda: X.ts_delay("close", 3), f"LAG(close, 3) OVER ({_S})"),
    "c02_ts_delta": (lambda: X.ts_delta("close", 3), f"close - LAG(close, 3) OVER ({_S})"),
    "c03_ts_returns": (lambda: X.ts_returns("close", 2), f"close / LAG(close, 2) OVER ({_S}) - 1"),
    "c04_ts_mean": (lambda: X.ts_mean("close", 5), _full("AVG(close)", "close", 5)),
    "c05_ts_std": (lambda: X.ts_std("close", 5), _full("STDDEV_SAMP(close)", "close", 5)),
    "c06_ts_min": (lambda: X.ts_min("low", 5), _full("MIN(low)", "low", 5)),
    "c07_ts_max": (lambda: X.ts_max("high", 5), _full("MAX(high)", "high", 5)),
    "c08_ts_rank": (lambda: X.ts_rank("close", 5), f"CASE WHEN COUNT(close) {_w(5)} = 5 THEN LEN(LIST_FILTER(LIST(close) {_w(5)}, lambda v: v <= close)) / 5.0 END"),
    "c10_ts_corr": (lambda: X.ts_corr("close", "volume", 5), _CORR),
    "c11_ts_cov": (lambda: X.ts_cov("close", "volume", 5), _full("COVAR_SAMP(close, volume)", "close + volume", 5)),
    "c12_ts_downside_std": (lambda: X.ts_downside_std("r", 5), f"CASE WHEN COUNT(*) {_w(5)} = 5 THEN STDDEV_SAMP({_DOWN}) {_w(5)} END"),
    "c13_cs_rank": (lambda: X.cs_rank("close"), _RANK),
    "c14_cs_percentile": (lambda: X.cs_percentile("close"), f"({_RANK}) / NULLIF(COUNT(close) {_X}, 0)"),
    "c15_cs_zscore": (lambda: X.cs_zscore("close"), f"(close - AVG(close) {_X}) / NULLIF(STDDEV_SAMP(close) {_X}, 0)"),
    "c16_cs_demean": (lambda: X.cs_demean("close"), f"close - AVG(close) {_X}"),
    "c16_cs_demean_volume": (lambda: X.cs_demean("volume"), f"volume - AVG(volume) {_X}"),
    "c17_cs_neutralize": (lambda: X.cs_neutralize("r"), f"r - AVG(r) {_X}"),
    "c18_cs_winsor": (lambda: X.cs_winsor("r", 0.1), _WINSOR.format(p=0.1)),
    "c19_add": (lambda: X.add("open", "close"), "open + close"),
    "c20_subtract": (lambda: X.subtract("high", "low"), "high - low"),
    "c21_multiply": (lambda: X.multiply("close", "volume"), "close * volume"),
    "c22_divide": (lambda: X.divide("high", X.subtract("close", "close")), "high / NULLIF(close - close, 0)"),
    "c23_signed_power": (lambda: X.signed_power("r", 0.5), "SIGN(r) * POW(ABS(r), 0.5)"),
    "c24_abs": (lambda: X.absolute("r"), "ABS(r)"),
    "c25_neg": (lambda: X.negate("r"), "-r"),
    "c26_min": (lambda: X.lesser("open", "close"), "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN LEAST(open, close) END"),
    "c27_max": (lambda: X.greater("r", X.negate("r")), "CASE WHEN r IS NOT NULL THEN GREATEST(r, -r) END"),
    "c28_clip": (lambda: X.clip("r", -0.001, 0.001), "CASE WHEN r IS NOT NULL THEN LEAST(GREATEST(r, -0.001), 0.001) END"),
    "c32_sign_orientation": (lambda: X.oriented("r", -1), "-r"),
}

for _name, (_column, _sql) in FACTORS.items():
    register(
        _name,
        lambda spark, sf_dir, column=_column: panel_of(spark, sf_dir).select("timestamp", "symbol", F.round(column(), 6).alias("value")),
        with_panel(f"SELECT timestamp, symbol, ROUND({_sql}, 6) AS value FROM p"),
    )

_DECAY = 1 - 2 / 6


@query(
    with_panel(
        f"""SELECT x.timestamp, x.symbol, ROUND(CASE WHEN MAX(x.seen) >= 5 THEN SUM(POW({_DECAY}, x.t - y.t) * y.close) / SUM(POW({_DECAY}, x.t - y.t)) END, 6) AS value
FROM n x LEFT JOIN n y ON x.symbol = y.symbol AND y.t <= x.t AND y.t >= x.t - 92 AND y.close IS NOT NULL GROUP BY 1, 2""",
        extra=f"n AS (SELECT timestamp, symbol, close, ROW_NUMBER() OVER ({_S}) AS t, COUNT(close) OVER ({_S}) AS seen FROM p)",
    )
)
def c09_ts_ewm(spark, sf_dir):
    return panel_of(spark, sf_dir).select("timestamp", "symbol", F.round(X.ts_ewm("close", 5), 6).alias("value"))


@query(with_panel("SELECT timestamp, symbol, close, volume, ROUND(r, 6) AS returns FROM p"))
def c29_fields(spark, sf_dir):
    out = preprocess.fields(panel_of(spark, sf_dir).drop("r"), ["close", "volume", "returns"])
    return out.withColumn("returns", F.round("returns", 6))


@query(
    with_panel(
        f"SELECT timestamp, symbol, ROUND(LAG(m) OVER ({_S}), 6) AS value FROM h",
        extra=f"""
a AS (SELECT timestamp, symbol, CASE WHEN COUNT(r) {_X} >= 0.5 * COUNT(*) {_X} THEN r END AS r FROM p),
w AS (SELECT timestamp, symbol, {_WINSOR.format(p=0.02)} AS x FROM a),
z AS (SELECT timestamp, symbol, (x - AVG(x) {_X}) / NULLIF(STDDEV_SAMP(x) {_X}, 0) AS z FROM w),
h AS (SELECT timestamp, symbol, z - AVG(z) {_X} AS m FROM z)""",
    )
)
def c30_preprocess(spark, sf_dir):
    out = preprocess.preprocess(panel_of(spark, sf_dir), "r", preprocess.Steps())
    return out.select("timestamp", "symbol", F.round("value", 6).alias("value"))


@query(
    with_panel(
        f"SELECT timestamp, symbol, ROUND((x - AVG(x) {_X}) / NULLIF(STDDEV_SAMP(x) {_X}, 0), 6) AS value FROM w",
        extra=f"w AS (SELECT timestamp, symbol, {_WINSOR.format(p=0.05)} AS x FROM p)",
    )
)
def c33_winsorised_zscore(spark, sf_dir):
    out = panel_of(spark, sf_dir).withColumn("x", X.cs_winsor("r", 0.05))
    return out.select("timestamp", "symbol", F.round(X.cs_zscore("x"), 6).alias("value"))
