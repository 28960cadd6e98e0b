"""Validate, then publish: rows reach their place only if none of them breaks a gate.

One pass writes the rows beside their place and counts the gates they break; the count is
known when the write ends. Only without a broken row are the files moved to where readers
look, by one rename. A failed or lost attempt leaves nothing there, and can be made again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from verisift.operators.documents import envelope_gates


class Rejected(Exception):
    """Broken gates with how many rows break each; nothing was published."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(", ".join(f"{name}: {n}" for name, n in counts.items()))
        self.counts = counts


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def published(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def publish(rows: DataFrame, gates: dict[str, Column], path: str, format_: str = "parquet") -> int:
    """Rows written to a path that isn't there yet; their number. Raises Rejected, and publishes nothing, if a row breaks a gate.

    A null condition is no violation, and an empty table is published as such. Of two that
    publish to one path at once, one fails.
    """
    spark, seen, staged = rows.sparkSession, Observation(), f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in gates.items()]
    files, place = _files(spark, path)
    if files.exists(place):
        raise FileExistsError(path)
    _, beside = _files(spark, staged)
    try:
        rows.observe(seen, F.count(F.lit(1)).alias("_rows"), *counts).write.format(format_).save(staged)
        found = seen.get
        broken = {name: found[name] for name in gates if found.get(name)}
        if broken:
            raise Rejected(broken)
        if not files.rename(beside, place):
            raise FileExistsError(path)
        return found.get("_rows", 0)
    finally:
        if files.exists(beside):
            files.delete(beside, True)


def publish_batches(gates: dict[str, Column], path: str, rejected: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is published whole as path/batch=<id>, or not at all.

    A batch that is delivered again is published once. A batch with a broken row stops the
    stream, or, if `rejected` is given, is written there as it is, and the stream goes on.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        place = f"{path.rstrip('/')}/batch={batch_id}"
        if published(batch.sparkSession, place):
            return
        try:
            publish(batch, gates, place)
        except Rejected:
            if rejected is None:
                raise
            batch.write.mode("overwrite").parquet(f"{rejected.rstrip('/')}/batch={batch_id}")

    return run


def artifacts(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """(file, text) of the stage artifacts under a path; reading one that breaks a gate fails, and names file and gate."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    first = F.coalesce(*[F.when(c, F.lit(name)) for name, c in envelope_gates(F.col("text"), F.lit(stage)).items()])
    # the check is part of what is read, so that no plan leaves it out
    checked = F.when(first.isNotNull(), F.raise_error(F.concat("file", F.lit(": "), first)).cast("string")).otherwise(F.col("text"))
    return read.select("file", checked.alias("text"))
