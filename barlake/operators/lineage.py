"""Lifecycle audits, manifests and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Which state may follow which.
ALLOWED = (("quarantine", "shadow"), ("quarantine", "rejected"), ("shadow", "paper"), ("shadow", "rejected"), ("paper", "rejected"))


def illegal_transitions(events: DataFrame, key: str = "candidate", order: tuple[str, ...] = ("seen_at", "event_id"), allowed=ALLOWED) -> DataFrame:
    """Events whose state may not follow the one before; the first event of a candidate has none before it."""
    rows = events.withColumn("from", F.lag("state").over(Window.partitionBy(key).orderBy(*order))).withColumn("to", F.col("state"))
    legal = F.lit(False)
    for a, b in allowed:
        legal = legal | ((F.col("from") == a) & (F.col("to") == b))
    return rows.where(F.col("from").isNotNull() & ~legal)


def current_state(events: DataFrame, key: str = "candidate", order: tuple[str, ...] = ("seen_at", "event_id")) -> DataFrame:
    return events.groupBy(key).agg(F.max_by("state", F.struct(*order)).alias("state"))


def compare_manifests(left: DataFrame, right: DataFrame, volatile: tuple = ()) -> DataFrame:
    """Keys of a run whose values differ or are in one manifest only; (run, key, value) on both sides."""
    both = left.withColumnRenamed("value", "left").join(right.withColumnRenamed("value", "right"), ["run", "key"], "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")) & ~F.col("key").isin(*volatile))


def fingerprint(values: dict[str, Column], digits: int = 16) -> Column:
    """The first digits of the SHA-256 of compact JSON with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)])), 256), 1, digits)


#: The lifecycle of a candidate, and the steps that only a person may take.
LIFECYCLE = (
    ("quarantined", "validated_oos"), ("quarantined", "rejected"), ("validated_oos", "shadow"), ("validated_oos", "rejected"),
    ("shadow", "paper"), ("shadow", "rejected"), ("paper", "rejected"),
)
MANUAL_ONLY = (("shadow", "paper"),)


def _may_follow(before: Column, after: Column, manual: Column) -> Column:
    ok = F.lit(False)
    for a, b in LIFECYCLE:
        step = (before == a) & (after == b)
        ok = ok | (step & manual if (a, b) in MANUAL_ONLY else step)
    return F.coalesce(ok, F.lit(False))


def _walk(events: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Each candidate's events in order, with the state each one meets and whether it is legal there.

    A candidate starts quarantined; an illegal event changes nothing. The events of one candidate are few, so they are
    walked as an array in one aggregate.
    """
    item = F.struct(*order, F.col("state"), F.coalesce("manual", F.lit(False)).alias("manual"))
    lists = events.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_events"))
    seen = "array<struct<" + ", ".join(f"{c}: {dict(events.dtypes)[c]}" for c in order) + ", from: string, to: string, legal: boolean>>"
    start = F.struct(F.lit("quarantined").alias("state"), F.array().cast(seen).alias("log"))

    def step(acc: Column, e: Column) -> Column:
        legal = _may_follow(acc["state"], e["state"], e["manual"])
        line = F.struct(*[e[c].alias(c) for c in order], acc["state"].alias("from"), e["state"].alias("to"), legal.alias("legal"))
        return F.struct(F.when(legal, e["state"]).otherwise(acc["state"]).alias("state"), F.concat(acc["log"], F.array(line)).alias("log"))

    return lists.select(key, F.aggregate("_events", start, step).alias("_walk"))


def audit_transitions(events: DataFrame, key: str = "candidate", order: tuple[str, ...] = ("seen_at", "event_id")) -> DataFrame:
    """(key, *order, from, to) of events that may not follow the state they meet; shadow to paper needs a person (manual)."""
    rows = _walk(events, key, order).select(key, F.explode("_walk.log").alias("_e")).where("not _e.legal")
    return rows.select(key, *[F.col(f"_e.{c}").alias(c) for c in (*order, "from", "to")])


def legal_state(events: DataFrame, key: str = "candidate", order: tuple[str, ...] = ("seen_at", "event_id")) -> DataFrame:
    """(key, state): where each candidate is after its legal events."""
    return _walk(events, key, order).select(key, F.col("_walk.state").alias("state"))


BUNDLE_SCHEMA = "candidate_id string, source_project_version string, code_hash string, data_fingerprint string, bundle_schema_version string, signal_spec struct<expression: string>, evaluation_summary map<string, string>, approval_status string"


def candidate_lineage(bundles: DataFrame, json: str = "json", approval: str = "approval_state") -> DataFrame:
    """The lineage fields of each bundle; hashes default to empty, the approval state to the bundle's own status."""
    b = bundles.select(F.from_json(json, BUNDLE_SCHEMA).alias("b")).select("b.*")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    state = F.coalesce(F.nullif(F.try_element_at("evaluation_summary", F.lit(approval)), F.lit("")), "approval_status")
    return b.select("candidate_id", "source_project_version", empty("code_hash"), empty("data_fingerprint"), "bundle_schema_version", F.col("signal_spec.expression").alias("expression"), state.alias("approval_state"))


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bundles as of `tables.check_bundles`, split into quarantined records, in which nothing is enabled, and rejected ones."""
    return (
        checked.where("ok").drop("errors", "ok").withColumn("state", F.lit("quarantined")).withColumn("paper_enabled", F.lit(False)),
        checked.where("not ok").drop("ok"),
    )


def shadow_snapshot(targets: DataFrame, curve: DataFrame, metrics: DataFrame, key: str = "variant_id") -> DataFrame:
    """One row a variant: the positive weights of its newest timestamp, their sum, and equity and headline metrics."""
    newest = targets.groupBy(key).agg(F.max("timestamp").alias("timestamp"))
    latest = targets.join(newest, [key, "timestamp"], "left_semi").where("target_weight > 0").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_positions"), F.sum("target_weight").alias("gross_weight"),
        F.array_sort(F.collect_list(F.concat_ws("=", "symbol", F.format_string("%.6f", "target_weight")))).alias("positions"),
    )
    equity = curve.groupBy(key).agg(F.max("timestamp").alias("as_of_bar"), F.max_by("equity", "timestamp").alias("equity"))
    out = newest.select(key).join(latest, key, "left").join(equity, key).join(metrics.select(key, "total_return", "sharpe", "max_drawdown"), key)
    return out.select(key, "as_of_bar", F.coalesce("n_positions", F.lit(0)).cast("long").alias("n_positions"), F.coalesce("gross_weight", F.lit(0.0)).alias("gross_weight"), F.coalesce(F.array_join("positions", ","), F.lit("")).alias("positions"), "equity", "total_return", "sharpe", "max_drawdown")
