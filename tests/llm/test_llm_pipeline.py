"""The pipeline on the smallest tables: columns, what goes and what stays."""

import __spark_entry__
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidelode.llm.common import count_words

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    n = docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontaminate", "mix"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        path = str(tmp_path / str(i))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != "mix":
            assert out.columns == docs.columns
            assert 0 < out.count() <= n
            docs, n = out, out.count()
    # the mix: every slot's words are words of its documents, about one and a half times all words
    assert out.columns == ["shard", "slot", "source", "doc_ids", "text"]
    assert out.groupBy("shard", "slot").count().where("count > 1").isEmpty()
    words, size = out.agg(F.sum(count_words(F.col("text")))).first()[0], docs.agg(F.sum(count_words(F.col("text")))).first()[0]
    assert 1.4 * size < words < 1.6 * size
    each = out.select("text", F.explode("doc_ids").alias("doc_id")).groupBy("doc_id").count()
    assert each.join(docs, "doc_id", "left_anti").isEmpty()


def test_pipeline_is_registered():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "pipeline" in q and len([x for x in q if x.startswith("op")]) == 13
    assert set(o) <= set(q)


@pytest.mark.parametrize("name", ["op1_decontaminate", "op4_line_dedup", "op7_ngram_join"])
def test_queries_take_far_paths(spark, name):
    assert __spark_entry__.queries()[name](spark, f"file://{DIR}").count() == 200


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    run = "\n".join("word " * 20 + str(i) for i in range(4))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n ", "en", None, 3), (None, "some words here", None, "b", 15), (4, run, "en", "a", 9),
        (4, run, "en", "a", 9), (5, run + "\nmore", "en", "a", 9), (6, "x " * 40_000, "en", "b", 80_000), (None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, DIR)
    if name != "mix":
        assert out.count() <= len(rows)
        assert out.columns == docs.columns
        assert out.where("doc_id = 6").count() <= 1
    assert stage(spark, docs.limit(0), DIR).count() == 0
