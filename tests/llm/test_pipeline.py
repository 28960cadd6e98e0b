"""The pipeline's stages on odd tables: columns kept, odd rows without a crash, and decisions that take effect."""

import corpus_pipeline
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `__id` string, spans int"


def test_stages_in_turn(spark):
    read = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(1_000_001, None, None, None, None), (1_000_002, "", "en", "s", 0), (None, "no id here but some words", "en", "s", 25), (1_000_003, "1 2 3", "en", None, 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = read.unionByName(read.limit(5)).unionByName(odd).withColumns({"__id": F.lit("x"), "spans": F.lit(1)})
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").cache()
        assert out.columns == docs.columns, name
        assert out.filter("`__id` <> 'x' OR spans <> 1").count() == 0
        counts.append(out.count())
        docs = out
    assert counts[0] < 129 and counts[1] < counts[0] and counts[1] >= counts[2] == counts[3] > 60
    assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0 and len(docs.columns) == 7
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
