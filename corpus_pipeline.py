"""The corpus pipeline: documents in, packed bins out.

Each stage takes the table its predecessor wrote and returns the next one. All but
the last return the columns of ``documents``; a stage's decisions are in its rows and
texts. Every stage takes null texts, ids and sources, repeated rows, empty tables and
further columns, as the docstring of the operator that it calls says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import contamination, jaccard, packing, quality, secrets
from weftline.plans.registry import Query
from weftline.scratch import written
from weftline.session import tune
from weftline.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that many documents of a source share; depleted and poor documents go."""
    tune(spark)
    return quality.keep_good_documents(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id."""
    tune(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go; spans of it in others are cut."""
    tune(spark)
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked."""
    tune(spark)
    return secrets.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in bins of bounded length: a row a piece."""
    tune(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", packed),
]

# SQL cannot state the forest's verdicts nor the bins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERY = Query("pipeline", run, ORACLE_SQL)
