"""The evidence manifest: a table of contents by sha256, grown by each version's files and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "sha256 string, name string, bytes long, version long"


def files(df: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(sha256, name, bytes) of files or texts; what has no content is left out."""
    return df.filter(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.col(name).cast("string").alias("name"), F.octet_length(content).cast("long").alias("bytes"))


def additions(manifest: DataFrame, incoming: DataFrame, version: int) -> DataFrame:
    """The rows by which a version grows the manifest: of each content that it lacks one, by the least name.

    To be appended; the same files again add nothing.
    """
    once = incoming.groupBy("sha256").agg(F.min("name").alias("name"), F.max("bytes").alias("bytes"))
    return once.join(manifest, "sha256", "left_anti").withColumn("version", F.lit(version).cast("long"))


def bundle(manifest: DataFrame, version: int) -> DataFrame:
    """What a version rests on: its own additions and those carried forward from earlier ones."""
    return manifest.filter(F.col("version") <= version)


def changed(manifest: DataFrame, incoming: DataFrame) -> DataFrame:
    """(name, sha256, known): names whose content now differs from what the manifest last had under them."""
    last = manifest.groupBy("name").agg(F.max_by("sha256", "version").alias("known"))
    return incoming.join(last, "name").filter(F.col("sha256") != F.col("known")).select("name", "sha256", "known")
