"""Grids, promotion gates and false-discovery control; every variant is a key, nothing loops on the driver."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluate import equity_curve, metrics

#: Gate, metric column, test against a limit.
GATES = (
    ("return", "total_return", ">", 0.0), ("sharpe", "sharpe", ">=", 0.30), ("drawdown", "max_drawdown", ">=", -0.35),
    ("turnover", "annual_turnover", "<=", 50.0), ("volatility", "volatility", ">", 0.0),
)


def grid(spark: SparkSession, parameters: dict[str, list]) -> DataFrame:
    """(variant_id, one column for each parameter): all combinations; a table as small as the user's lists."""
    names = list(parameters)
    rows = [(i, *v) for i, v in enumerate(itertools.product(*parameters.values()))]
    kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
    schema = ", ".join(["variant_id int", *[f"{n} {kinds[type(parameters[n][0])]}" for n in names]])
    return spark.createDataFrame(rows, schema)


def one_at_a_time(spark: SparkSession, base: dict, changes: dict[str, list]) -> DataFrame:
    """The base and every single change to it, each once."""
    rows = [tuple(base.values()), *[tuple({**base, k: v}.values()) for k, vs in changes.items() for v in vs]]
    unique = list(dict.fromkeys(rows))
    kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
    schema = ", ".join(["variant_id int", *[f"{n} {kinds[type(v)]}" for n, v in base.items()]])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(unique)], schema)


def robust_score(metrics: DataFrame, value: str = "sharpe", fold: str = "fold", key: str = "variant_id") -> DataFrame:
    """For each variant its value in train and test and the lesser of them, best first by rank."""
    g = metrics.groupBy(key).agg(F.max(F.when(F.col(fold) == "train", F.col(value))).alias("train"), F.max(F.when(F.col(fold) == "test", F.col(value))).alias("test"))
    g = g.withColumn("robust", F.least("train", "test"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.col("robust").desc(), F.col("test").desc(), key)))


def walk_forward(returns: DataFrame, train_years: int = 3, key: str = "variant_id") -> DataFrame:
    """(year, variant_id, objective): for each year the variant that was best in the years before it.

    The objective is Sharpe - 0.25 * |drawdown| over the training years. returns: (timestamp, key, daily_return).
    Years without train_years of history before them are left out.
    """
    rows = returns.withColumn("y", F.year("timestamp"))
    years = rows.select(F.col("y").alias("year")).distinct()
    first = rows.agg(F.min("y").alias("_first"))
    folds = years.crossJoin(F.broadcast(first)).where(F.col("year") - train_years >= F.col("_first")).drop("_first")
    train = rows.join(F.broadcast(folds), F.col("y").between(F.col("year") - train_years, F.col("year") - 1))
    w = Window.partitionBy("year", key).orderBy("timestamp")
    curve = train.withColumn("equity", F.exp(F.sum(F.log1p("daily_return")).over(w))).withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)
    sharpe = F.coalesce(F.try_divide(F.avg("daily_return") * F.sqrt(F.lit(252.0)), F.stddev_pop("daily_return")), F.lit(0.0))
    g = curve.groupBy("year", key).agg((sharpe - 0.25 * F.abs(F.min("dd"))).alias("objective"))
    best = Window.partitionBy("year").orderBy(F.round("objective", 9).desc(), key)
    return g.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def stitch(returns: DataFrame, chosen: DataFrame, key: str = "variant_id") -> DataFrame:
    """The daily returns of each year's chosen variant as one stream."""
    rows = returns.withColumn("year", F.year("timestamp"))
    return rows.join(chosen.select("year", key), ["year", key]).select("timestamp", key, "daily_return")


def gates(metrics: DataFrame, table: tuple = GATES) -> DataFrame:
    """metrics with `failed` (names of the gates not passed) and `verdict`; a missing metric fails its gate."""
    tests = {">": lambda c, x: c > x, ">=": lambda c, x: c >= x, "<=": lambda c, x: c <= x, "<": lambda c, x: c < x}
    failed = [F.when(~F.coalesce(tests[op](F.col(c), F.lit(x)), F.lit(False)), F.lit(name)) for name, c, op, x in table]
    return metrics.withColumn("failed", F.array_compact(F.array(*failed))).withColumn("verdict", F.when(F.size("failed") == 0, "pass").otherwise("fail"))


def sharpe_pvalue(sharpe: Column, n: Column, periods: int = 252) -> Column:
    """One-sided p-value of a positive Sharpe ratio: the normal tail by Abramowitz and Stegun 7.1.26, |error| < 1.5e-7."""
    z = sharpe / F.sqrt(F.lit(float(periods))) * F.sqrt(n.cast("double")) / F.sqrt(F.lit(2.0))
    a = F.abs(z)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-a * a)
    return F.when(n < 2, 1.0).otherwise(F.when(z >= 0, tail).otherwise(1 - tail))


def benjamini_hochberg(tests: DataFrame, q: float, p: str = "p_value", key: str = "variant_id", family: list[str] | None = None) -> DataFrame:
    """tests with `rejected`: the greatest rank k with p <= q * k / m decides, and all ranks up to it are rejected."""
    all_ = Window.partitionBy(*(family or []))
    rows = tests.withColumn("_k", F.row_number().over(all_.orderBy(p, key))).withColumn("_m", F.count(F.lit(1)).over(all_))
    cut = F.max(F.when(F.col(p) <= q * F.col("_k") / F.col("_m"), F.col("_k"))).over(all_)
    return rows.withColumn("rejected", F.coalesce(F.col("_k") <= cut, F.lit(False))).drop("_k", "_m")


#: The eight promotion gates over the columns of promotion_metrics.
PROMOTION_GATES = (
    ("return", "test_return", ">", 0.0), ("sharpe", "test_sharpe", ">=", 0.30), ("stability", "stability", ">=", 0.0), ("drawdown", "max_drawdown", ">=", -0.35),
    ("turnover", "annual_turnover", "<=", 50.0), ("alpha", "alpha", ">", 0.0), ("beta", "abs_beta", "<=", 1.5), ("cost_stress", "stressed_return", ">", 0.0),
)


def promotion_metrics(returns: DataFrame, bps: float = 10.0, stress_bps: float = 15.0, key: str = "variant_id") -> DataFrame:
    """What the promotion gates read of each variant's (timestamp, daily_return, turnover, benchmark_return), net of bps.

    All distinct timestamps are cut at 60 and 80 % into train, val and test. Return, Sharpe, drawdown, alpha and beta are
    those of test, turnover that of all rows; stability is the lesser Sharpe of val and test; under stress traded weight
    costs stress_bps.
    """
    days = returns.select("timestamp").distinct()
    n, place = F.count(F.lit(1)).over(Window.partitionBy()), F.row_number().over(Window.orderBy("timestamp"))
    days = days.select("timestamp", place.alias("_k"), n.alias("_n"))  # a calendar table
    one = F.least(F.greatest(F.floor(F.col("_n") * 0.6), F.lit(1)), F.col("_n") - 2)
    two = F.least(F.greatest(F.floor(F.col("_n") * 0.8), one + 1), F.col("_n") - 1)
    fold = F.when(F.col("_k") <= one, "train").when(F.col("_k") <= two, "val").otherwise("test")
    rows = returns.join(days.select("timestamp", fold.alias("fold")), "timestamp")
    m = metrics(equity_curve(rows, (key, "fold")), (key, "fold"))
    of = lambda f, c: F.max(F.when(F.col("fold") == f, F.col(c)))
    g = m.groupBy(key).agg(of("test", "total_return").alias("test_return"), of("test", "sharpe").alias("test_sharpe"), of("test", "n").alias("test_n"), of("val", "sharpe").alias("_val"), of("test", "max_drawdown").alias("max_drawdown"), of("test", "alpha").alias("alpha"), F.abs(of("test", "beta")).alias("abs_beta"))
    whole = metrics(equity_curve(returns, (key,)), (key,)).select(key, "annual_turnover")
    extra = rows.where("fold = 'test'").withColumn("_s", F.col("daily_return") - F.col("turnover") * ((stress_bps - bps) / 1e4))
    stressed = extra.groupBy(key).agg((F.exp(F.sum(F.log1p("_s"))) - 1).alias("stressed_return"))
    # a missing fold makes the lesser Sharpe missing, which fails its gate
    stability = F.when(F.col("_val").isNotNull() & F.col("test_sharpe").isNotNull(), F.least("_val", "test_sharpe"))
    return g.withColumn("stability", stability).drop("_val").join(whole, key).join(stressed, key, "left")


_PRIME = 2147483647


def bootstrap_index(sample, draw, n):  # noqa: ANN001, ANN201
    """A place from 0 to n - 1 for each draw of each sample, of columns or of arrays of 64 bits: arithmetic that every engine repeats."""
    h = ((sample + 1) * 48271 + (draw + 1) * 69621) % _PRIME
    g = h * h % _PRIME
    return (g * g + 11 * h + 7) % _PRIME % n


#: Resamples that one row of the resampling makes.
BLOCK = 500


def session_bootstrap(returns: DataFrame, samples: int, value: str = "daily_return", key: str = "variant_id", time: str = "session") -> DataFrame:
    """(key, sessions, p025, p50, p975, positive) of the sums of `samples` resamples of each stream's returns.

    Each resample draws as many returns as the stream has, with replacement. A stream's returns, one a session, are
    gathered into an array once; blocks of resamples draw from it in tasks of their own, so that no row is made of a
    draw and what is ordered is the samples' sums.
    """
    point = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    streams = returns.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["v"]).alias("_values"))
    blocks = streams.select(key, "_values", F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(BLOCK))).alias("_first"))
    kind = returns.schema[key].dataType.simpleString()

    def draw(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for part in batches:
            for stream, values, first in zip(part[key], part["_values"], part["_first"], strict=True):
                values = np.asarray(values, float)
                sample = np.arange(first, min(first + BLOCK, samples), dtype=np.int64)
                at = bootstrap_index(sample[:, None], np.arange(len(values), dtype=np.int64), len(values))
                yield pd.DataFrame({key: stream, "_s": values[at].sum(axis=1)})

    sums = blocks.repartition(key, "_first").mapInPandas(draw, f"`{key}` {kind}, _s double")
    q = lambda p: F.percentile("_s", F.lit(p))
    out = sums.groupBy(key).agg(q(0.025).alias("p025"), q(0.5).alias("p50"), q(0.975).alias("p975"), F.avg((F.col("_s") > 0).cast("double")).alias("positive"))
    return streams.select(key, F.size("_values").cast("long").alias("sessions")).join(out, key)


def promote_batch(metrics: DataFrame, q: float = 0.10, table: tuple = PROMOTION_GATES, sharpe: str = "test_sharpe", n: str = "test_n", key: str = "variant_id") -> DataFrame:
    """metrics with p_value, failed and verdict (promote or reject): all gates, then false-discovery control over those that pass.

    The control looks at passers only, as the p-values of the others would relax its limit; one that fails it gets the
    reason fails_fdr.
    """
    judged = gates(metrics, table).withColumn("p_value", sharpe_pvalue(F.col(sharpe), F.col(n)))
    passed = benjamini_hochberg(judged.where("verdict = 'pass'").select(key, "p_value"), q, key=key).select(key, F.col("rejected").alias("_kept"))
    out = judged.join(passed, key, "left")
    failed = F.when((F.col("verdict") == "pass") & ~F.col("_kept"), F.array(F.lit("fails_fdr"))).otherwise(F.col("failed"))
    return out.withColumn("failed", failed).withColumn("verdict", F.when(F.coalesce("_kept", F.lit(False)), "promote").otherwise("reject")).drop("_kept")
