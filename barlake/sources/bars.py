"""Bars: reading, conforming, filtering, resampling and the panel."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BAR_COLUMNS = ("timestamp", "symbol", "open", "high", "low", "close", "volume")
BAR_SCHEMA = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("symbol", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS[2:]]])
MARKET_ZONE = "America/New_York"


def read_csv_bars(spark: SparkSession, path: str, symbols: Iterable[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a CSV file; the time range is inclusive and, without a zone, in UTC."""
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in BAR_COLUMNS])).option("header", True).csv(path)
    return select_bars(conform(raw.withColumn("ingest_seq", F.lit(0))), symbols, start, end)


def select_bars(bars: DataFrame, symbols: Iterable[str] | None = None, start: str | None = None, end: str | None = None, time: str = "timestamp") -> DataFrame:
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin([s.upper() for s in symbols]))
    kind = bars.schema[time].dataType
    bound = lambda x: F.to_timestamp(F.lit(x if re.search(r"(Z|[+-]\d\d:?\d\d)$", x) and len(x) > 10 else x + (" 00:00:00Z" if len(x) <= 10 else "Z"))) if kind == T.TimestampType() and isinstance(x, str) else F.lit(x).cast(kind)
    if start is not None:
        bars = bars.where(F.col(time) >= bound(start))
    if end is not None:
        bars = bars.where(F.col(time) <= bound(end))
    return bars


def conform(raw: DataFrame, order: str = "ingest_seq", time: str = "timestamp") -> DataFrame:
    """Typed bars: text times read as UTC, symbols upper-cased, numbers coerced, rows without time, symbol or a positive open and close dropped.

    Of several rows for a (time, symbol) the one ingested last stays.
    """
    missing = [c for c in ("symbol", "open", "high", "low", "close", "volume") if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    number = [F.expr(f"try_cast({c} as double)").alias(c) for c in BAR_COLUMNS[2:]]
    at = utc_time(time) if raw.schema[time].dataType == T.StringType() else F.col(time)
    rows = raw.select(at.alias(time), F.upper("symbol").alias("symbol"), *number, order)
    rows = rows.where(F.col(time).isNotNull() & F.col("symbol").isNotNull() & (F.col("open") > 0) & (F.col("close") > 0))
    return latest(rows, [time, "symbol"], order).drop(order)


def utc_time(text: str) -> Column:
    """The moment that a text names; without an offset of its own it is UTC, unreadable is null."""
    x = F.trim(F.col(text))
    full = F.when(F.length(x) <= 10, F.concat(x, F.lit(" 00:00:00"))).otherwise(x)
    return F.try_to_timestamp(F.when(full.rlike(r"(Z|[+-]\d\d:?\d\d)$"), full).otherwise(F.concat(full, F.lit("Z"))))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes last."""
    by = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth")


def upsert(cached: DataFrame, fresh: DataFrame, start=None, time: str = "timestamp") -> DataFrame:
    """Cached bars with fresh ones put in or over them, from `start` on."""
    both = cached.withColumn("_from", F.lit(0)).unionByName(fresh.withColumn("_from", F.lit(1)))
    if start is not None:
        both = both.where(F.col(time) >= F.lit(start))
    return latest(both, [time, "symbol"], "_from").drop("_from")


def session_date(time: Column | str = "timestamp", zone: str = MARKET_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(time, zone))


def completed_sessions(bars: DataFrame, as_of, zone: str = MARKET_ZONE, time: str = "timestamp") -> DataFrame:
    """Bars of sessions before the one that `as_of` falls in."""
    return bars.where(session_date(time, zone) < session_date(F.lit(as_of).cast("timestamp"), zone))


def available_at_close(bars: DataFrame, observed_at, market_is_open: bool, zone: str = MARKET_ZONE, time: str = "timestamp") -> DataFrame:
    day, today = session_date(time, zone), session_date(F.lit(observed_at).cast("timestamp"), zone)
    return bars.where(day < today if market_is_open else day <= today)


def densify(bars: DataFrame, time: str = "timestamp") -> DataFrame:
    """Every symbol at every timestamp that any symbol has; cells without a bar are null.

    The calendar is one array of distinct times, which every symbol unfolds; it grows with time and not with symbols.
    """
    calendar = bars.agg(F.collect_set(time)).scalar()
    return bars.select("symbol").distinct().select(F.explode(calendar).alias(time), "symbol").join(bars, [time, "symbol"], "left")


def resample_sessions(bars: DataFrame, minutes: int, zone: str = MARKET_ZONE, regular_hours: bool = True, drop_incomplete: bool = True) -> DataFrame:
    """Bars of `minutes` counted from 09:30 local time, labelled by their end; buckets not yet over are withheld."""
    if minutes not in (1, 5, 10, 15, 30, 60):
        raise ValueError("minutes must be 1, 5, 10, 15, 30 or 60")
    local = F.from_utc_timestamp("timestamp", zone)
    minute = F.hour(local) * 60 + F.minute(local)
    rows = bars.withColumn("session", F.to_date(local)).withColumn("_m", minute)
    if regular_hours:
        rows = rows.where(F.col("_m").between(570, 959))
    bucket = ((F.floor((F.col("_m") - 570) / minutes) + 1) * minutes).cast("int")
    rows = rows.withColumn("_end", F.to_utc_timestamp(F.col("session").cast("timestamp") + F.make_interval(mins=F.lit(570) + bucket), zone))
    first, last = (lambda c: F.min_by(c, "timestamp")), (lambda c: F.max_by(c, "timestamp"))
    out = rows.groupBy("symbol", "session", F.col("_end").alias("timestamp_end")).agg(
        first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close").alias("close"), F.sum("volume").alias("volume")
    )
    if drop_incomplete:
        newest = bars.agg(F.max("timestamp").alias("_newest"))
        # the newest row is a one-minute bar: what it closes is complete up to its own end
        done = F.col("_newest") + F.expr("interval 1 minute")
        out = out.crossJoin(F.broadcast(newest)).where(F.col("timestamp_end") <= done).drop("_newest")
    return out.withColumnRenamed("timestamp_end", "timestamp")


def label_bar_ends(bars: DataFrame, minutes: int, zone: str = MARKET_ZONE) -> DataFrame:
    """Bars labelled by their start, in regular hours, relabelled by their end."""
    local = F.from_utc_timestamp("timestamp", zone)
    minute = F.hour(local) * 60 + F.minute(local)
    kept = bars.where(minute.between(570, 959) & (minute + minutes <= 960))
    return kept.withColumn("timestamp", F.col("timestamp") + F.make_interval(mins=F.lit(minutes)))
