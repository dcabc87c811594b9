"""Candidate bundles as data: a walk over all values of JSON texts, and the rules that a bundle must pass before import.

A text is parsed once into a VARIANT. Its values are unfolded level by level inside the row, so that rules on keys hold at
any depth, rules on fields see the types that the text has, and neither the walk nor the rules move rows between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import quarantine

#: Fixed values of the bundle format.
VERSION = "candidate_bundle_v1"
REQUIRED = (
    "bundle_schema_version", "candidate_id", "name", "source_project_version", "signal_spec", "economic_hypothesis", "required_inputs", "frequency", "lookback", "approval_status", "created_at",
)
OPTIONAL = ("universe_assumptions", "preprocessing", "portfolio_construction", "evaluation_summary", "data_fingerprint", "code_hash")
SIGNAL_KEYS = ("kind", "expression", "reference", "parameters")
INPUTS = ("open", "high", "low", "close", "volume", "vwap")
FREQUENCIES = ("1Min", "5Min", "15Min", "1Day")
APPROVALS = ("draft", "approved", "rejected")
TOKENS = ("python", "pickle", "lambda", "exec", "eval", "callable", "entrypoint", "shell", "script", "command", "reduce")

#: Texts nested deeper than this are refused; a walk has as many steps as its deepest text has levels.
MAX_DEPTH = 64


#: A string of a JSON text. Possessive, so that a long one takes no stack.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def depth(json: Column) -> Column:
    """How deep objects and arrays are nested in a JSON text; brackets inside strings do not count."""
    marks = F.split(F.regexp_replace(json, _STRING + r'|[^"\[\]{}]++|"', ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, m: Column) -> Column:
        now = s["now"] + F.when(m.isin("{", "["), 1).when(m.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda s: s["most"])


def _openings(json: Column) -> Column:
    """The number of opening brackets, strings included: a text is nested no deeper."""
    return F.octet_length(json) - F.octet_length(F.replace(F.replace(json, F.lit("{"), F.lit("")), F.lit("["), F.lit("")))


def _too_deep(json: Column) -> Column:
    return F.when(_openings(json) <= MAX_DEPTH, F.lit(False)).otherwise(depth(json) > MAX_DEPTH)


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def _inside(value: Column) -> Column:
    """(path, name, value, kind) of what an object or array given as such a struct holds; nothing for other values."""
    fields = F.map_entries(F.try_variant_get(value["value"], "$", "map<string, variant>"))
    of = lambda path, name, x: F.struct(F.concat(value["path"], path).alias("path"), name.alias("name"), x.alias("value"), _kind(x).alias("kind"))
    named = F.transform(fields, lambda e: of(F.concat(F.lit("."), e["key"]), e["key"], e["value"]))
    entries = F.try_variant_get(value["value"], "$", "array<variant>")
    listed = F.transform(entries, lambda x, i: of(F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.lit(None).cast("string"), x))
    return F.when(value["kind"] == "OBJECT", named).otherwise(listed)


def walk(texts: DataFrame, key: str, json: str = "json") -> DataFrame:
    """(key, path, name, kind): every value of every JSON text, below the whole; name is null in arrays.

    Paths are like $.a.b[1].c. Texts that are no JSON, or hold an object with a repeated key, have no values here, nor
    have those nested deeper than MAX_DEPTH.
    """
    text = F.col(json)
    deep = texts.select(F.when(_openings(text) > 0, depth(text)).alias("deep")).where(f"deep <= {MAX_DEPTH}")
    levels = deep.agg(F.max("deep")).first()[0] or 0
    rows = texts.where(~_too_deep(text)).select(F.col(key).alias("id"), F.try_parse_json(json).alias("v"))
    whole = F.struct(F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.col("v").alias("value"), _kind(F.col("v")).alias("kind"))
    rows = rows.select("id", F.filter(F.array(whole), lambda e: e["kind"].isin("OBJECT", "ARRAY")).alias("open"))
    found = []
    for k in range(levels):
        rows = rows.withColumn("level", F.flatten(F.transform("open", _inside)))
        shown = F.transform("level", lambda e: F.struct(e["path"].alias("path"), e["name"].alias("name"), e["kind"].alias("kind")))
        rows = rows.select("id", *found, shown.alias(f"found_{k}"), F.filter("level", lambda e: e["kind"].isin("OBJECT", "ARRAY")).alias("open"))
        found.append(f"found_{k}")
    every = F.flatten(F.array(*found)) if found else F.array().cast("array<struct<path: string, name: string, kind: string>>")
    return rows.select("id", F.inline(every)).withColumnRenamed("id", key)


def _forbidden(json: Column, value: Column) -> Column:
    """The keys at any depth of a parsed text that hold a token of executable content, in order and once.

    Keys are read off the variant's own text, in which a key's closing quote is followed by a colon at once and the only
    escapes are those that JSON needs. Texts that hold no token anywhere, nor an escape that could hide one, are not looked at.
    """
    lower = F.lower(json)
    may = json.contains("\\u")
    for t in TOKENS:
        may = may | lower.contains(t)
    names = F.regexp_extract_all(F.to_json(value), F.lit(r'"([^"\\]*+(?:\\.[^"\\]*+)*+)":|' + _STRING), F.lit(1))
    plain = F.transform(names, lambda n: F.when(n.contains("\\"), F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), n, F.lit('"'))), "$", "string")).otherwise(n))
    hits = F.filter(plain, lambda n: F.arrays_overlap(F.split(F.lower(n), r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, TOKENS))))
    return F.when(may & ~_too_deep(json), F.array_sort(F.array_distinct(hits)))


def forbidden_keys(texts: DataFrame, key: str, json: str = "json") -> DataFrame:
    """(key, names): the keys at any depth that hold a token of executable content; tokens are split at what is no letter or digit."""
    parsed = texts.withColumn("_v", F.try_parse_json(json)).where("_v is not null")
    return parsed.select(key, _forbidden(F.col(json), F.col("_v")).alias("names")).where("size(names) > 0")


def validate_bundles(bundles: DataFrame, key: str, json: str = "json") -> DataFrame:
    """bundles with errors, warnings and ok (there are no errors); key tells bundles apart.

    Errors: json (no JSON object), depth, unknown:<top key>, unknown_signal:<key>, forbidden:<key at any depth>, version,
    missing:<key>, type:<key> (texts must not be blank), kind, expression, reference, no_inputs, input:<name>, frequency,
    lookback (a whole number of one or more), approval, step:<place> and symbol:<place> (entries of a list that are no
    object, or no text). Warnings: not_approved, no_fingerprint; neither keeps a bundle out.
    """
    v = F.try_parse_json(json)
    top = F.when(_kind(F.col("_v")) == "OBJECT", F.json_object_keys(json))
    rows = bundles.withColumn("_v", v).withColumns({"_keys": top, "_bad": _forbidden(F.col(json), F.col("_v")), "_deep": _too_deep(F.col(json))})
    # each field is taken out of the text once, and its kind named once; as columns, since a struct's fields would be made for each use
    paths = (*REQUIRED, *OPTIONAL, *(f"signal_spec.{k}" for k in ("kind", "expression", "reference")))
    rows = rows.withColumns({f"_at_{p.replace('.', '_')}": F.try_variant_get("_v", f"$.{p}", "variant") for p in paths})
    at = lambda path: F.col(f"_at_{path.replace('.', '_')}")
    rows = rows.withColumns({f"_kind_{p.replace('.', '_')}": F.coalesce(_kind(at(p)), F.lit("")) for p in paths})
    kind = lambda path: F.col(f"_kind_{path.replace('.', '_')}")
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(at(path), "$", "string"))
    has = lambda k: F.array_contains("_keys", k)
    none = F.array().cast("array<string>")
    rule = lambda bad, name: F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(name))).otherwise(none)
    named = lambda prefix, found: F.coalesce(F.transform(F.array_sort(found), lambda k: F.concat(F.lit(prefix), k)), none)
    lits = lambda values: F.array(*map(F.lit, values))
    filled = lambda k: F.coalesce(F.length(F.trim(text(k))) > 0, F.lit(False))
    entries = lambda path: F.try_variant_get(at(path), "$", "array<variant>")
    wrong = lambda path, right: F.when(kind(path) == "ARRAY", F.filter(F.transform(entries(path), lambda x, i: F.when(F.coalesce(_kind(x), F.lit("VOID")) != right, i.cast("string"))), lambda x: x.isNotNull()))
    signal = F.when(kind("signal_spec") == "OBJECT", F.map_keys(F.try_variant_get(at("signal_spec"), "$", "map<string, variant>")))
    whole = (kind("lookback") == "BIGINT") | F.schema_of_variant(at("lookback")).rlike(r"^DECIMAL\((19|[23][0-9]),0\)")
    inputs = F.when(kind("required_inputs") == "ARRAY", entries("required_inputs"))
    input_names = F.transform(inputs, lambda x: F.coalesce(F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")), F.to_json(x)))
    specified = kind("signal_spec") == "OBJECT"
    errors = F.concat(
        named("unknown:", F.array_except("_keys", lits(REQUIRED + OPTIONAL))), named("unknown_signal:", F.array_except(signal, lits(SIGNAL_KEYS))), named("forbidden:", F.col("_bad")),
        rule(~F.coalesce(text("bundle_schema_version") == VERSION, F.lit(False)), "version"), named("missing:", F.array_except(lits(REQUIRED), "_keys")),
        *[rule(has(k) & ~filled(k), f"type:{k}") for k in ("candidate_id", "name", "source_project_version", "economic_hypothesis", "created_at")],
        rule(has("signal_spec") & ~specified, "type:signal_spec"), rule(specified & ~F.coalesce(text("signal_spec.kind").isin("expression", "reference"), F.lit(False)), "kind"),
        *[rule(specified & (text("signal_spec.kind") == k) & (kind(f"signal_spec.{k}") != "STRING"), k) for k in ("expression", "reference")],
        rule(has("required_inputs") & (kind("required_inputs") != "ARRAY"), "type:required_inputs"), rule(F.size(inputs) == 0, "no_inputs"), named("input:", F.array_except(input_names, lits(INPUTS))),
        rule(has("frequency") & ~F.coalesce(text("frequency").isin(*FREQUENCIES), F.lit(False)), "frequency"),
        rule(has("lookback") & ~F.coalesce(whole & (F.try_variant_get(at("lookback"), "$", "decimal(38,0)") >= 1), F.lit(False)), "lookback"),
        rule(has("approval_status") & ~F.coalesce(text("approval_status").isin(*APPROVALS), F.lit(False)), "approval"),
        rule(has("preprocessing") & ~kind("preprocessing").isin("ARRAY", "OBJECT"), "type:preprocessing"), named("step:", wrong("preprocessing", "OBJECT")),
        rule(has("universe_assumptions") & (~kind("universe_assumptions").isin("ARRAY", "OBJECT", "STRING") | ((kind("universe_assumptions") == "STRING") & ~filled("universe_assumptions"))), "type:universe_assumptions"),
        named("symbol:", wrong("universe_assumptions", "STRING")), *[rule(has(k) & (kind(k) != "OBJECT"), f"type:{k}") for k in ("portfolio_construction", "evaluation_summary")],
        *[rule(has(k) & (kind(k) != "STRING"), f"type:{k}") for k in ("data_fingerprint", "code_hash")],
    )
    errors = F.when(F.col("_keys").isNull(), lits(["json"])).when(F.col("_deep"), lits(["depth"])).otherwise(errors)
    warnings = F.concat(rule(~F.coalesce(text("approval_status") == "approved", F.lit(False)), "not_approved"), rule(F.coalesce(F.length(text("data_fingerprint")), F.lit(0)) == 0, "no_fingerprint"))
    out = rows.select(*bundles.columns, errors.alias("errors"), F.when(F.col("_keys").isNull(), none).otherwise(warnings).alias("warnings"))
    return out.withColumn("ok", F.size("errors") == 0)


def import_states(bundles: DataFrame, key: str, json: str = "json") -> DataFrame:
    """`validate_bundles` with the state of each bundle, quarantined or rejected, and paper_enabled, which is false for all."""
    checked = validate_bundles(bundles, key, json)
    return checked.withColumn("state", F.when(F.col("ok"), F.lit("quarantined")).otherwise(F.lit("rejected"))).withColumn("paper_enabled", F.lit(False))


def import_bundles(bundles: DataFrame, key: str, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """Bundles that pass all rules as quarantined records, in which nothing is enabled, and the rejected ones."""
    return quarantine(validate_bundles(bundles, key, json))
