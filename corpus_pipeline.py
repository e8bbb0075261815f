"""The training-corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and reads whole tables and whole texts. All but the last hand on
the columns of documents, extra ones too, whatever their names (stages choose inner names that do not
clash); an empty table goes through all of them and gives no pieces. What each does with nulls, ties
and repeated rows is said with it, and with its operator in tabulith/llm.

A stage's result must be written before the next stage is called, as run() does it: the tables that a
stage writes on its way are deleted when the next one begins, so that they do not add up.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulith.llm import common, decontaminate, exact_dedup, jaccard_join, packing, toxicity


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Sends the code to the executors, drops what the stage before left, and notes what this one writes."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sc = spark.sparkContext
        common.package_zip(spark)
        common.drop_paths(spark, getattr(sc, "_tabulith_left", []))
        sc._tabulith_left = []
        before = set(common.made_paths(spark))
        out = function(spark, docs, sf_dir)
        sc._tabulith_left = [p for p in common.made_paths(spark) if p not in before]
        return out

    return run_stage


@stage
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on `labels`, does not reject (score below its threshold).

    Null and empty texts are scored by the bias and stay where that is low; rows without an id are scored
    like others; repeated rows share their fate; without labels every document has the base rate.
    """
    return toxicity.drop_toxic(spark, docs, common.table(spark, sf_dir, "labels"))


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest doc_id, of repeated rows one.

    Null and empty texts are equal to each other; a row without an id stays only where its group has none.
    """
    return exact_dedup.drop_copies(spark, docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles, the smallest doc_id, of repeated rows one.

    Texts without words and rows without an id are in no group and stay.
    """
    return jaccard_join.keep_one(spark, docs)


@stage
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of `benchmark` is found with question and answer.

    Null and empty texts hold none and stay; repeated rows share their fate; so do all where there are no items.
    """
    return decontaminate.drop_leaks(spark, docs, common.table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows; null and empty texts are the end mark alone, rows without an id are
    packed like others, repeated rows one by one."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", pack),
]

#: Trained scores and tokenised windows have no SQL; tests/llm/test_pipeline_brute.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = common.table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        result = step(spark, docs, sf_dir)
        before = set(common.made_paths(spark))
        docs = common.staged(spark, result, "stage-" + name)
        common.drop_paths(spark, old)
        old = [p for p in common.made_paths(spark) if p not in before]
    return STAGES[-1][1](spark, docs, sf_dir)
