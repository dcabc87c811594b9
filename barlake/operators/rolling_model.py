"""A ridge regression fitted anew for each session on the sessions before it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barlake.functions.factors import clip_to, ts_mean

from .confirmed import relative_return, same_clock, session_closes
from .intraday import clock, in_session, session_vwap

FEATURES = ("relative_dislocation", "session_relative_return", "vwap_distance", "signal_relative_volume", "prior_trend_gap", "confirmation_return", "benchmark_session_return")


def setup_features(bars: DataFrame, benchmark: str, signal: int, confirmation: int, lookback: int, volume_sessions: int, trend_sessions: int) -> DataFrame:
    """(session, symbol, the seven features, label) at the confirmation bar of each session and name but the benchmark.

    The label is the session's close over the open after the confirmation; it is known only once the session is over.
    """
    w = in_session()
    rows = session_vwap(relative_return(bars, lookback, benchmark)).withColumn("clock", clock())
    rows = rows.withColumn("_next", F.lead("open").over(w))
    day = bars.groupBy("symbol", "session").agg(F.min_by("open", "timestamp").alias("_open"), F.max_by("close", "timestamp").alias("_close"))
    at = same_clock(rows.where(F.col("clock") == signal), volume_sessions).select("symbol", "session", F.col("relative").alias("_r"), F.col("close").alias("_s"), "relative_volume")
    later = rows.where(F.col("clock") == confirmation).select("symbol", "session", "close", "vwap", "_next")
    trend = session_closes(bars).withColumn("_t", F.try_divide("prior_close", ts_mean("prior_close", trend_sessions, Window.partitionBy("symbol").orderBy("session"))) - 1)
    one = at.join(later, ["symbol", "session"]).join(day, ["symbol", "session"]).join(trend.select("symbol", "session", "_t"), ["symbol", "session"])
    move = F.try_divide("close", "_open") - 1
    market = later.where(F.col("symbol") == benchmark).join(day, ["symbol", "session"]).select("session", move.alias("benchmark_session_return"))
    return one.where(F.col("symbol") != benchmark).join(market, "session").select(
        "session", "symbol", (-F.col("_r")).alias("relative_dislocation"), (move - F.col("benchmark_session_return")).alias("session_relative_return"),
        (F.try_divide("close", "vwap") - 1).alias("vwap_distance"), F.col("relative_volume").alias("signal_relative_volume"), F.col("_t").alias("prior_trend_gap"),
        (F.try_divide("close", "_s") - 1).alias("confirmation_return"), "benchmark_session_return", (F.try_divide("_close", "_next") - 1).alias("label"),
    )


def _solve(batches: Iterator) -> Iterator:
    """One small linear system a row."""
    import numpy as np
    import pandas as pd

    for part in batches:
        beta = []
        for gram, right in zip(part["gram"], part["right"], strict=True):
            k = len(right)
            full = np.zeros((k, k))
            full[np.triu_indices(k)] = gram
            beta.append(np.linalg.solve(full + np.triu(full, 1).T, np.array(right)).tolist())
        yield pd.DataFrame({"session": part["session"], "beta": beta, "y_mean": part["y_mean"], "_mean": part["_mean"], "_dev": part["_dev"]})


def _trailing(days: DataFrame, sessions: int) -> DataFrame:
    """(session, _q): the numbers of the up to `sessions` sessions before each one; days: (session, _p), numbered from 1."""
    reach = F.sequence(F.greatest(F.col("_p") - sessions, F.lit(1)), F.greatest(F.col("_p") - 1, F.lit(1)))
    return days.withColumn("_q", F.explode(reach)).where("_q < _p").select("session", "_q")


def session_moments(rows: DataFrame, features: tuple[str, ...], label: str = "_y") -> DataFrame:
    """One row a session: rows, means, sums of products of deviations (of features, and of features and label) and extremes.

    Sessions merge into windows from this without their rows: it holds all that a regression needs of them.
    """
    k = len(features)
    n = F.count(F.lit(1))
    return rows.groupBy("session").agg(
        n.alias("_n"), F.avg(label).alias("_my"), F.array(*[F.avg(c) for c in features]).alias("_m"),
        F.array(*[F.covar_pop(features[i], features[j]) * n for i in range(k) for j in range(i, k)]).alias("_c"), F.array(*[F.covar_pop(c, label) * n for c in features]).alias("_cy"),
        F.array(*[F.min(c) for c in features]).alias("_low"), F.array(*[F.max(c) for c in features]).alias("_high"),
    )


def rolling_ridge(rows: DataFrame, features: tuple[str, ...] = FEATURES, sessions: int = 504, least_sessions: int = 252, least_rows: int = 5000, alpha: float = 25.0, clip: float = 10.0, winsor: float = 0.05) -> DataFrame:
    """rows (session, symbol, features, label) with `prediction`: from a ridge on the `sessions` sessions before each one.

    Features are standardised by their means and population deviations there and clipped, labels winsorised and centred.
    Fewer than least_sessions sessions or least_rows whole rows give null.

    Rows are read once for their sessions' moments; windows are merged from those, and a row is copied into a window only
    where the window clips it, which its session's extremes tell, to put the clipped product in place of the plain one.
    What is solved is a system as large as the features. Sessions are numbered without a partition, they are a calendar;
    rows should be a stored table, as they are read for the moments, the clipped rows and the predictions.
    """
    k = len(features)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    clean = rows.na.drop(subset=[*features, "label"]).withColumn("_y", clip_to("label", F.lit(-winsor), F.lit(winsor)))
    days = rows.select("session").distinct().withColumn("_p", F.row_number().over(Window.orderBy("session")))
    moments = session_moments(clean, features).join(days, "session").select(F.col("_p").alias("_q"), F.col("session").alias("_of"), "_n", "_my", "_m", "_c", "_cy", "_low", "_high")
    pairs = _trailing(days, sessions).join(moments, "_q", "left")
    at = lambda name, i: F.get(name, F.lit(i))
    mean = lambda x: F.sum(F.col("_n") * x) / F.sum("_n")
    first = pairs.groupBy("session").agg(F.count(F.lit(1)).alias("_sessions"), F.sum("_n").alias("_rows"), mean(F.col("_my")).alias("y_mean"), F.array(*[mean(at("_m", i)) for i in range(k)]).alias("_mean"))
    first = first.where((F.col("_sessions") >= least_sessions) & (F.col("_rows") >= least_rows)).select("session", "_rows", "y_mean", "_mean")
    joined = pairs.where("_n > 0").join(first, "session")
    off = lambda i: at("_m", i) - at("_mean", i)
    whole = joined.groupBy("session").agg(
        F.first("y_mean").alias("y_mean"), F.first("_mean").alias("_mean"), F.first("_rows").alias("_rows"), F.array(*[F.sum(at("_c", c) + F.col("_n") * off(i) * off(j)) for c, (i, j) in enumerate(cells)]).alias("_c"),
        F.array(*[F.sum(at("_cy", i) + F.col("_n") * off(i) * (F.col("_my") - F.col("y_mean"))) for i in range(k)]).alias("_cy"),
    )
    deviation = [F.sqrt(at("_c", cells.index((i, i))) / F.col("_rows")) for i in range(k)]
    whole = whole.withColumn("_dev", F.array(*[F.when(d < 1e-12, 1.0).otherwise(d) for d in deviation]))
    # the sessions of a window that hold rows beyond its clip, and what clipping changes in their sums
    beyond = [((at("_high", i) - at("_mean", i)) > clip * at("_dev", i)) | ((at("_low", i) - at("_mean", i)) < -clip * at("_dev", i)) for i in range(k)]
    some = beyond[0]
    for x in beyond[1:]:
        some = some | x
    open_ = pairs.where("_n > 0").join(whole.select("session", "_mean", "_dev"), "session").where(some).select("session", "_of", "_mean", "_dev")
    clipped = clean.withColumnRenamed("session", "_of").join(open_, "_of")
    plain = [(F.col(c) - at("_mean", i)) / at("_dev", i) for i, c in enumerate(features)]
    held = [clip_to(z, F.lit(-clip), F.lit(clip)) for z in plain]
    fixes = clipped.select("session", "_y", F.array(*plain).alias("_z"), F.array(*held).alias("_h")).where("_z <> _h").groupBy("session").agg(
        F.array(*[F.sum(at("_h", i) * at("_h", j) - at("_z", i) * at("_z", j)) for i, j in cells]).alias("_dc"), F.array(*[F.sum(at("_h", i) - at("_z", i)) for i in range(k)]).alias("_dz"),
        F.array(*[F.sum((at("_h", i) - at("_z", i)) * F.col("_y")) for i in range(k)]).alias("_dzy"),
    )
    both = whole.join(fixes, "session", "left")
    fix = lambda name, i: F.coalesce(at(name, i), F.lit(0.0))
    gram = [at("_c", c) / (at("_dev", i) * at("_dev", j)) + fix("_dc", c) + (alpha if i == j else 0.0) for c, (i, j) in enumerate(cells)]
    right = [at("_cy", i) / at("_dev", i) + fix("_dzy", i) - F.col("y_mean") * fix("_dz", i) for i in range(k)]
    sums = both.select("session", F.array(*gram).alias("gram"), F.array(*right).alias("right"), "y_mean", "_mean", "_dev")
    kind = rows.schema["session"].dataType.simpleString()
    fitted = sums.mapInPandas(_solve, f"session {kind}, beta array<double>, y_mean double, _mean array<double>, _dev array<double>")
    scaled = [clip_to((F.col(c) - at("_mean", i)) / at("_dev", i), F.lit(-clip), F.lit(clip)) for i, c in enumerate(features)]
    dot = sum((at("beta", i) * z for i, z in enumerate(scaled)), F.lit(0.0))
    return rows.join(fitted, "session", "left").select(*rows.columns, (F.col("y_mean") + dot).alias("prediction"))


def calibrated_pick(predicted: DataFrame, candidates: DataFrame, n: int, threshold: float, sessions: int = 504, least: int = 100, clip: float = 0.05) -> DataFrame:
    """(session, symbol, prediction) of the n lowest predictions at or below the threshold among each session's candidates.

    A prediction is moved by the median of the clipped errors (label less prediction) of the candidates of the sessions
    before, of which there must be `least`.
    """
    rows = predicted.join(candidates.select("session", "symbol"), ["session", "symbol"])
    days = predicted.select("session").distinct().withColumn("_p", F.row_number().over(Window.orderBy("session")))
    errors = rows.select("session", clip_to(F.col("label") - F.col("prediction"), F.lit(-clip), F.lit(clip)).alias("_e")).where("_e is not null").join(days, "session")
    reach = _trailing(days, sessions)
    shift = reach.join(errors.select(F.col("_p").alias("_q"), "_e"), "_q").groupBy("session").agg(F.count(F.lit(1)).alias("_n"), F.percentile("_e", F.lit(0.5)).alias("_shift")).where(F.col("_n") >= least)
    moved = rows.join(shift, "session").withColumn("prediction", F.col("prediction") + F.col("_shift")).where(F.col("prediction") <= threshold)
    k = F.row_number().over(Window.partitionBy("session").orderBy("prediction", "symbol"))
    return moved.withColumn("_k", k).where(F.col("_k") <= n).select("session", "symbol", "prediction")
