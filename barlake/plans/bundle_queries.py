"""Queries of candidate bundles: the walk, all rules, and import."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import bundles

from .registry import query, table

#: What is put in place of the good bundle's fields by the order's number modulo the number of cases: (field, JSON text or None to
#: leave it out, errors, warnings).
_GOOD = {
    "bundle_schema_version": '"candidate_bundle_v1"', "name": '"momentum"', "source_project_version": '"lab 0.1"', "signal_spec": '{"kind":"expression","expression":"ts_returns(close,20)","parameters":{"sign":1}}',
    "economic_hypothesis": '"winners win"', "required_inputs": '["close","volume"]', "frequency": '"1Day"', "lookback": "20", "approval_status": '"approved"', "created_at": '"2026-08-04"',
    "data_fingerprint": '"ab12"', "preprocessing": '{"winsorize":true}',
}
_CASES = [
    (None, None, "", ""), ("code_hash", '"9"', "", ""), ("extra", "1", "unknown:extra", ""), ("signal_spec", '{"kind":"expression","expression":{"eval":{"pickle":1}},"deep":[{"a":[{"pre-exec":null}]}]}', "unknown_signal:deep,forbidden:eval,forbidden:pickle,forbidden:pre-exec,expression", ""),
    ("signal_spec", '{"kind":"reference"}', "reference", ""), ("signal_spec", '"close"', "type:signal_spec", ""), ("signal_spec", '{"kind":"code"}', "kind", ""), ("bundle_schema_version", '"v2"', "version", ""), ("created_at", None, "missing:created_at", ""),
    ("name", '"  "', "type:name", ""), ("name", "7", "type:name", ""), ("required_inputs", "[]", "no_inputs", ""), ("required_inputs", '["close","news",3]', "input:3,input:news", ""), ("required_inputs", '"close"', "type:required_inputs", ""),
    ("frequency", '"2Min"', "frequency", ""), ("lookback", "0", "lookback", ""), ("lookback", "20.5", "lookback", ""), ("lookback", '"20"', "lookback", ""), ("lookback", "true", "lookback", ""), ("approval_status", '"draft"', "", "not_approved"), ("approval_status", '"paper"', "approval", "not_approved"),
    ("data_fingerprint", None, "", "no_fingerprint"), ("data_fingerprint", "5", "type:data_fingerprint", "no_fingerprint"), ("preprocessing", '[{"rank":1},"z",[2]]', "step:1,step:2", ""), ("preprocessing", "3", "type:preprocessing", ""),
    ("universe_assumptions", '["A",1,"B"]', "symbol:1", ""), ("universe_assumptions", '""', "type:universe_assumptions", ""), ("universe_assumptions", '"research-only"', "", ""), ("portfolio_construction", "[]", "type:portfolio_construction", ""),
    ("evaluation_summary", '{"note":"eval(x)","evaluation":{"Shell.Script":[1]}}', "forbidden:Shell.Script", ""),
]


def _texts() -> list[str]:
    """A text for each case, all but the candidate_id, which comes first."""
    out = []
    for field, value, _, _ in _CASES:
        own = {k: v for k, v in {**_GOOD, **({field: value} if field else {})}.items() if v is not None}
        out.append(",".join(f'"{k}":{v}' for k, v in own.items()))
    return out


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_N = len(_CASES)
_BUNDLES_SQL = f"""ct AS (SELECT UNNEST(RANGE({_N})) AS c, UNNEST([{', '.join(map(_quoted, _texts()))}]) AS body, UNNEST([{', '.join(_quoted(c[2]) for c in _CASES)}]) AS errors, UNNEST([{', '.join(_quoted(c[3]) for c in _CASES)}]) AS warnings),
bu AS (SELECT o_orderkey, '{{"candidate_id":"' || CAST(o_orderkey AS VARCHAR) || '",' || body || '}}' AS json, errors, warnings FROM orders JOIN ct ON c = o_orderkey % {_N})"""


def _bundles(spark, sf_dir):
    """A bundle for each order. The keys are dealt out first: they are small, and a file has fewer parts than the texts need tasks."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    body = F.get(F.array(*map(F.lit, _texts())), (F.col("o_orderkey") % _N).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey").repartition(parts, "o_orderkey").select("o_orderkey", F.concat(F.lit('{"candidate_id":"'), F.col("o_orderkey").cast("string"), F.lit('",'), body, F.lit("}")).alias("json"))


@query(f"WITH {_BUNDLES_SQL} SELECT o_orderkey, errors, warnings, errors = '' AS ok FROM bu")
def l01_bundle_rules(spark, sf_dir):
    """All rules over bundles of every order; every kind of error and warning occurs."""
    out = bundles.validate_bundles(_bundles(spark, sf_dir), "o_orderkey")
    return out.select("o_orderkey", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "ok")


@query(f"""WITH {_BUNDLES_SQL} SELECT o_orderkey, j.fullkey AS path, CASE WHEN j.type = 'OBJECT' THEN 'OBJECT' WHEN j.type = 'ARRAY' THEN 'ARRAY' WHEN j.type = 'VARCHAR' THEN 'STRING' WHEN j.type = 'BOOLEAN' THEN 'BOOLEAN' WHEN j.type = 'NULL' THEN 'VOID' WHEN j.type = 'DOUBLE' THEN 'DECIMAL' ELSE 'BIGINT' END AS kind
FROM bu, json_tree(bu.json) j WHERE j.fullkey <> '$' AND j.fullkey NOT LIKE '%"%'""")
def l01_bundle_walk(spark, sf_dir):
    """Every value of every bundle, with its path and type; keys that need quotes in a path are left to the rules."""
    return bundles.walk(_bundles(spark, sf_dir), "o_orderkey").where("path not like '%pre-exec%' and path not like '%Shell%'").select("o_orderkey", "path", "kind")


@query(f"WITH {_BUNDLES_SQL} SELECT o_orderkey, CASE WHEN errors = '' THEN 'quarantined' ELSE 'rejected' END AS state, FALSE AS paper_enabled FROM bu")
def l07_bundle_import(spark, sf_dir):
    """Bundles that pass all rules go to quarantine, the others are rejected; nothing is enabled."""
    return bundles.import_states(_bundles(spark, sf_dir), "o_orderkey").select("o_orderkey", "state", "paper_enabled")
