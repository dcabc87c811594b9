"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes documents with any further columns and returns the rows that it keeps with all of them, the last one
the packed pieces. An empty table passes every stage as an empty table; a null text is an empty one; null and repeated
keys are rows like any other unless a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barlake.llm import decontaminate, jaccard, packing, quality_model, toxicity
from barlake.llm.shared import load, materialize, release, ship_package


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Empty texts have the score of the bias; without labels all stay."""
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Empty texts have the score of the bias; without labels all stay."""
    return quality_model.drop_low_quality(docs, load(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least key, a null key being last, of equal keys that of
    the least text hash, of equal rows one. Documents without words all stay."""
    ship_package(spark)
    return jaccard.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, judged row by row; those without words stay."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences; an empty text is one piece of its end token."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_documents),
    ("quality_classifier", low_quality),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("best_fit_packing", packed),
]
#: The classifiers and the packing have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
