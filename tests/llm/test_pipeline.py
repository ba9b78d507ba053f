"""The pipeline: columns, decisions, and the packing of what is left."""

from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import line_rules, minhash_forest
from panelforge.llm.common import written


def test_stages(spark, sf_dir):
    start = df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [df.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = written(stage(spark, df, sf_dir), "t")
        assert df.columns == start.columns
        sizes.append(df.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert df.count() == df.select("doc_id").distinct().count()
    left = minhash_forest.near_duplicates(df)
    assert left.where("not kept").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, df, sf_dir)
    assert packed.select("doc_id").distinct().count() == df.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, packed.collect()))


def test_rules_stage_rejects_what_the_operator_rejects(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in line_rules.judge(d).where("kept").collect()}
    assert {r.doc_id for r in line_rules.filter_documents(d).select("doc_id").collect()} == kept


def test_empty_documents(spark, docs, sf_dir):
    df = docs.where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        df = written(stage(spark, df, sf_dir), "t")
        assert df.count() == 0
