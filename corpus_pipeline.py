"""The corpus pipeline: quality rules, quality classifier, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; between stages the rows are written
as Parquet and read again.  All but the last keep the columns of ``documents``.  The quality rules
take the lines above the limit out of the texts; the classifier and the removal of near
duplicates leave the texts as they are and decide which documents go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import byte_cnn, line_rules, minhash_forest, window_packing
from panelforge.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_rules.filter_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_cnn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_forest.one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return window_packing.pack(docs, known=100_000)  # the workers also hold what earlier stages need


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-duplicate removal", near_dedup),
    ("packing", packing),
]
#: The classifier, the sketches and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        df = written(stage(spark, df, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, df, sf_dir)
