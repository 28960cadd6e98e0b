"""The corpus pipeline: stages in order, each rereading what the one before it wrote.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents,
n_chars being the length of the text as it is then. Each stage works on all documents
that its predecessor kept. Nulls, empty texts, repeated rows and empty tables have the
results that the operators' modules state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm import language_id, near_dedup, packing, pii, substring_dedup
from verisift.llm.common import shared_folder, table, tokenizer_path


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, if there is such a column, set to the length of the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.accepted_only(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.one_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out."""
    return _measured(substring_dedup.without_passages(docs))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return _measured(pii.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows of several lengths."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_languages),
    ("near_dedup", without_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; stages are written to the shared folder."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{place}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
