"""Factor functions: columns over a panel of (timestamp, symbol) rows.

Time-series functions (ts_*) look back over the rows of a symbol in `SERIES` order, which on a densified panel are the
market's timestamps; a window yields null unless all its cells have a value. Cross-section functions (cs_*) compare the
symbols of one timestamp. Windows of one nesting level share a partitioning, so a select of many costs one shuffle.
Missing values are null, never NaN; a division by zero is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIME, SYMBOL = "timestamp", "symbol"


def series(symbol: str = SYMBOL, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(symbol).orderBy(time)


def cross_section(time: str = TIME) -> WindowSpec:
    return Window.partitionBy(time)


def _in_order(time: str = TIME) -> WindowSpec:
    """A cross-section whose sums add in the order of symbols, so that they are the same however rows are dealt to tasks."""
    return Window.partitionBy(time).orderBy(SYMBOL).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _last(n: int, by: WindowSpec | None) -> WindowSpec:
    if not isinstance(n, int) or n < 1:
        raise ValueError("a window is a positive whole number of rows")
    return (by or series()).rowsBetween(1 - n, 0)


def _full(agg: Column, x: Column, n: int, w: WindowSpec) -> Column:
    return F.when(F.count(x).over(w) == n, agg.over(w))


def rounded(x, digits: int) -> Column:
    """x to so many digits by way of the double x * 10^digits, as SQL engines round doubles; halves go away from zero.

    Spark's round goes by the shortest decimal text of x instead, which parts from it where x is a written tie: 0.70815
    is 0.7081 here (7081.499... ten-thousandths) and 0.7082 there.
    """
    return F.round(_col(x) * 10.0**digits) / 10.0**digits


def ts_delay(x, n: int, by: WindowSpec | None = None) -> Column:
    _last(n, by)
    return F.lag(_col(x), n).over(by or series())


def ts_delta(x, n: int, by: WindowSpec | None = None) -> Column:
    return _col(x) - ts_delay(x, n, by)


def ts_returns(x, n: int, by: WindowSpec | None = None) -> Column:
    return F.try_divide(_col(x), ts_delay(x, n, by)) - 1


def ts_mean(x, n: int, by: WindowSpec | None = None) -> Column:
    return _full(F.avg(_col(x)), _col(x), n, _last(n, by))


def ts_sum(x, n: int, by: WindowSpec | None = None) -> Column:
    return _full(F.sum(_col(x)), _col(x), n, _last(n, by))


def ts_std(x, n: int, by: WindowSpec | None = None) -> Column:
    return _full(F.stddev_samp(_col(x)), _col(x), n, _last(n, by))


def ts_std_pop(x, n: int, by: WindowSpec | None = None) -> Column:
    return _full(F.stddev_pop(_col(x)), _col(x), n, _last(n, by))


def ts_min(x, n: int, by: WindowSpec | None = None) -> Column:
    return _full(F.min(_col(x)), _col(x), n, _last(n, by))


def ts_max(x, n: int, by: WindowSpec | None = None) -> Column:
    return _full(F.max(_col(x)), _col(x), n, _last(n, by))


def ts_median(x, n: int, by: WindowSpec | None = None) -> Column:
    return _full(F.percentile(_col(x), F.lit(0.5)), _col(x), n, _last(n, by))


def ts_rank(x, n: int, by: WindowSpec | None = None) -> Column:
    """Share of the window that is at most the current value."""
    x, w = _col(x), _last(n, by)
    return F.when(F.count(x).over(w) == n, F.size(F.filter(F.collect_list(x).over(w), lambda v: v <= x)) / F.lit(float(n)))


def ts_ewm(x, n: int, by: WindowSpec | None = None) -> Column:
    """Exponential mean of span n: weights fall by absolute lag, missing cells are skipped but age the rest.

    Null before n values were seen. The frame ends where weights fall below 1e-16 of the newest.
    """
    x, by = _col(x), by or series()
    decay = 1 - 2 / (n + 1)
    depth = 1 if decay <= 0 else math.ceil(37 / -math.log(decay))
    at = F.row_number().over(by)
    seen = F.collect_list(F.when(x.isNotNull(), F.struct(at.alias("t"), x.cast("double").alias("x")))).over(by.rowsBetween(-depth, 0))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

    def step(acc: Column, v: Column) -> Column:
        weight = F.pow(F.lit(decay), (at - v["t"]).cast("double"))
        return F.struct((acc["a"] + weight * v["x"]).alias("a"), (acc["b"] + weight).alias("b"))

    mean = F.aggregate(seen, zero, step, lambda acc: F.try_divide(acc["a"], acc["b"]))
    return F.when(F.count(x).over(by.rowsBetween(Window.unboundedPreceding, 0)) >= n, mean)


def ts_cov(x, y, n: int, by: WindowSpec | None = None) -> Column:
    x, y = _col(x), _col(y)
    return _full(F.covar_samp(x, y), x + y, n, _last(n, by))


def ts_corr(x, y, n: int, by: WindowSpec | None = None) -> Column:
    """Null where either side is constant."""
    x, y, w = _col(x), _col(y), _last(n, by)
    both = x.isNotNull() & y.isNotNull()
    sd = F.stddev_pop(F.when(both, x)).over(w) * F.stddev_pop(F.when(both, y)).over(w)
    return F.when(F.count(x + y).over(w) == n, F.try_divide(F.covar_pop(x, y).over(w), sd))


def ts_beta(x, benchmark, n: int, by: WindowSpec | None = None) -> Column:
    return F.try_divide(ts_cov(x, benchmark, n, by), _full(F.var_samp(_col(benchmark)), _col(benchmark), n, _last(n, by)))


def ts_downside_std(x, n: int, by: WindowSpec | None = None) -> Column:
    """Deviation of the losses; gains and missing values count as 0."""
    w = _last(n, by)
    loss = F.when(_col(x) < 0, _col(x)).otherwise(0.0)
    return F.when(F.count(F.lit(1)).over(w) == n, F.stddev_samp(loss).over(w))


def cs_rank(x, time: str = TIME) -> Column:
    """Average rank, ascending; null stays null."""
    x = _col(x)
    up = Window.partitionBy(time).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(Window.partitionBy(time, x))
    return F.when(x.isNotNull(), F.rank().over(up) + (ties - 1) / 2)


def cs_percentile(x, time: str = TIME) -> Column:
    return F.try_divide(cs_rank(x, time), F.count(_col(x)).over(cross_section(time)))


def cs_zscore(x, time: str = TIME) -> Column:
    w = _in_order(time)
    return F.try_divide(_col(x) - F.avg(_col(x)).over(w), F.stddev_samp(_col(x)).over(w))


def cs_demean(x, time: str = TIME) -> Column:
    return _col(x) - F.avg(_col(x)).over(_in_order(time))


cs_neutralize = cs_demean


def cs_winsor(x, p: float, time: str = TIME) -> Column:
    """Clip at the linearly interpolated p and 1 - p quantiles."""
    x, w = _col(x), cross_section(time)
    return clip_to(x, F.percentile(x, F.lit(p)).over(w), F.percentile(x, F.lit(1 - p)).over(w))


def add(a, b) -> Column:
    return _col(a) + _col(b)


def subtract(a, b) -> Column:
    return _col(a) - _col(b)


def multiply(a, b) -> Column:
    return _col(a) * _col(b)


def divide(a, b) -> Column:
    return F.try_divide(_col(a), _col(b))


def signed_power(a, p: float) -> Column:
    return F.signum(_col(a)) * F.pow(F.abs(_col(a)), F.lit(float(p)))


def absolute(a) -> Column:
    return F.abs(_col(a))


def negate(a) -> Column:
    return -_col(a)


def lesser(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def greater(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def clip_to(x, low, high) -> Column:
    x = _col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def clip(x, low: float, high: float) -> Column:
    return clip_to(x, F.lit(float(low)), F.lit(float(high)))


def oriented(x, expected_sign: int) -> Column:
    return -_col(x) if expected_sign < 0 else _col(x)
