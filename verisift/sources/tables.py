"""Parquet tables of one scale factor, and event logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Row form of the append-only status log; never inferred.
STATUS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("stage", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("cost_usd", T.DoubleType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def status_log(spark: SparkSession, path: str) -> DataFrame:
    """The status lines under a path; a torn last line is dropped."""
    return spark.read.schema(STATUS).option("mode", "DROPMALFORMED").json(path)


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_no, text) of page text files; the number is read from the file's name, so page 1000 sorts after 999."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]+)[^0-9]*$", 1).try_cast("int")
    return spark.read.text(path, wholetext=True).select(number.alias("page_no"), F.col("value").alias("text"))


def readable_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, readable) of files: readable ones begin with the magic bytes. Empty files give no row."""
    files = spark.read.format("binaryFile").load(path)
    magic = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), ((F.col("length") > 0) & magic).alias("readable"))
