"""Fields of the panel and the factor preprocessing pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions import factors as X


@dataclass(frozen=True)
class Steps:
    """Order is fixed: eligibility, coverage, winsor, z-score, demean, lag. A step that is None or False is left out."""

    coverage: float | None = 0.5
    winsor: float | None = 0.02
    zscore: bool = True
    demean: bool = True
    lag: int = 1

    @classmethod
    def named(cls, steps: list[str], lag: int = 1) -> Steps:
        """Steps from a list of names such as "winsor_2pct" or "znorm"."""
        has = lambda *marks: any(m in s for s in steps for m in marks)
        return cls(winsor=0.02 if has("winsor") else None, zscore=has("zscore", "znorm"), demean=has("demean", "neutral"), lag=lag)


def bundle_steps(json: Column) -> Column:
    """struct of winsor and zscore, as a bundle's preprocessing (JSON text) asks for them: both unless it says otherwise.

    An object says so by false, null, 0 or an empty text under winsorize and cross_sectional_zscore. A list of step objects names
    what is to be done, by kind or else op: a name that holds winsor, and one that holds zscore or znorm. A list without
    objects, and anything else, asks for both.
    """
    whole = F.try_parse_json(json)
    steps = F.when(F.schema_of_variant(whole).startswith("ARRAY"), F.try_variant_get(whole, "$", "array<variant>"))
    objects = F.filter(steps, lambda s: F.coalesce(F.schema_of_variant(s).startswith("OBJECT"), F.lit(False)))
    text = lambda s, k: F.coalesce(F.try_variant_get(s, f"$.{k}", "string"), F.lit(""))
    names = F.filter(F.transform(objects, lambda s: F.lower(F.when(text(s, "kind") != "", text(s, "kind")).otherwise(text(s, "op")))), lambda n: n != "")
    listed = F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0
    named = lambda *marks: F.exists(names, lambda n: F.greatest(*[F.contains(n, F.lit(m)) for m in (*marks, marks[0])]))
    value = lambda k: F.get_json_object(json, f"$.{k}")
    set_ = F.from_json(json, "map<string,string>")
    off = lambda k: F.map_contains_key(set_, k) & (value(k).isNull() | value(k).isin("false", "0", "0.0", "", "[]", "{}"))
    is_object = F.coalesce(F.ltrim(json).startswith("{"), F.lit(False))
    one = lambda k, *marks: F.when(F.coalesce(listed, F.lit(False)), named(*marks)).when(is_object, ~F.coalesce(off(k), F.lit(False))).otherwise(F.lit(True))
    return F.struct(one("winsorize", "winsor").alias("winsor"), one("cross_sectional_zscore", "zscore", "znorm").alias("zscore"))


def preprocess_variants(panel: DataFrame, x: str, variants: DataFrame) -> DataFrame:
    """(variant_id, timestamp, symbol, value) of every variant (variant_id, winsor, zscore) of the steps, demeaned or lagged by none.

    Each kind of steps is made once, and joined to the variants that ask for it.
    """
    kinds = [(w, z) for w in (False, True) for z in (False, True)]
    made = [preprocess(panel, x, Steps(winsor=0.02 if w else None, zscore=z, demean=False, lag=0)).select("timestamp", "symbol", "value", F.lit(w).alias("winsor"), F.lit(z).alias("zscore")) for w, z in kinds]
    rows = made[0]
    for m in made[1:]:
        rows = rows.union(m)
    return rows.join(variants, ["winsor", "zscore"]).select("variant_id", "timestamp", "symbol", "value")


def fields(panel: DataFrame, names: list[str]) -> DataFrame:
    """The wanted raw fields; `returns` is derived, `vwap` passes through where the source has it."""
    derived = {"returns": X.ts_returns("close", 1)}
    unknown = [n for n in names if n not in derived and n not in panel.columns]
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    return panel.select("timestamp", "symbol", *[derived.get(n, F.col(n)).alias(n) for n in names])


def preprocess(panel: DataFrame, x: str, steps: Steps = Steps(), eligible: Column | None = None) -> DataFrame:
    """panel with `value`: x after the steps. Coverage counts values against all symbols of the panel at a timestamp."""
    out = panel.withColumn("value", F.when(eligible, F.col(x)) if eligible is not None else F.col(x))
    if steps.coverage is not None:
        w = X.cross_section()
        out = out.withColumn("value", F.when(F.count("value").over(w) >= steps.coverage * F.count(F.lit(1)).over(w), F.col("value")))
    for on, f in ((steps.winsor is not None, lambda: X.cs_winsor("value", steps.winsor)), (steps.zscore, lambda: X.cs_zscore("value")), (steps.demean, lambda: X.cs_demean("value")), (steps.lag > 0, lambda: X.ts_delay("value", steps.lag))):
        if on:
            out = out.withColumn("value", f())
    return out
