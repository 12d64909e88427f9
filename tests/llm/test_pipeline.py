"""The stages on the supplied tables: what they drop, what they keep, and that stages hand over documents."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import decontam, linededup, minhash
from loomgraph.llm.registry import QUERIES


def test_stages_hand_over_documents(spark, data, tmp_path):
    docs = first = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == first.columns
            assert out.count() <= docs.count()
            assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        if "minhash" in name:
            assert minhash.near_duplicates(out).where("doc_id <> group_id").count() == 0
        if "line" in name:
            # what repeats can still repeat only a line that went itself
            assert out.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()
            assert linededup.repeated_lines(out).where("distance = 0").count() == 0
        if "decontamination" in name:
            assert decontam.contaminated(out, bench).count() == 0
        docs = out
    assert docs.columns == ["doc_id", "token_ids", "n_tokens", "lossless"] and docs.where("not lossless").count() == 0
    assert docs.count() > 0.4 * first.count()


def test_empty_documents_pass_through(spark, data, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_columns_and_rows(spark, data):
    docs = spark.createDataFrame([(None, "no id", 1), (1, None, 2), (2, "", 3), (3, "word " * 5, 4), (3, "word " * 5, 4)], "doc_id long, text string, _reject int").withColumn("_leak", F.lit(1)).withColumn("_gone_doc", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        out.count()
        if "_leak" in out.columns:
            assert out.columns == docs.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_have_numbers(name):
    assert name.startswith("op") and name[2].isdigit()
