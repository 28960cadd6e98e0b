"""Run-level rules: budgets, retries, open items, routing and page extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verisift.operators.histories import running_sum

# The base and factor of the back-off in minutes, and the most attempts.
BACKOFF, FACTOR, MOST = 2, 4, 3
# Buckets of failure messages in the order in which they are tried.
REASONS = (
    ("timed out", "timeout"), ("timeout", "timeout"), ("not valid json", "invalid_json_output"), ("no structured_output", "missing_structured_output"),
    ("could not be parsed", "unparseable_tool_call"), ("overloaded", "overloaded"), ("rate limit", "rate_limit"), ("429", "rate_limit"),
    ("econnreset", "connection_reset"), ("exited", "nonzero_exit"),
)


def within_budget(df: DataFrame, keys: list, order: list, cost: Column, ceiling, block: Column) -> DataFrame:
    """The rows of each key whose running cost stays within the ceiling, with it as `spent`; `block` deals a key's rows over tasks."""
    return running_sum(df, keys, order, cost, block, "spent").filter(F.col("spent") <= ceiling)


def retried(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Failures with their attempt, the minutes to wait, and whether they are retried or given up."""
    attempt = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    wait = F.when(F.col("attempt") <= MOST, (BACKOFF * F.pow(F.lit(FACTOR), F.col("attempt") - 1)).cast("int"))
    return df.withColumn("attempt", attempt).withColumns({"wait_minutes": wait, "outcome": F.when(F.col("attempt") <= MOST, "retry").otherwise("failed")})


def reason_bucket(message: Column) -> Column:
    """The first bucket whose marker a message holds; unknown if none."""
    probe, out = F.lower(F.coalesce(message, F.lit(""))), F.lit("unknown")
    for marker, bucket in reversed(REASONS):
        out = F.when(F.contains(probe, F.lit(marker)), bucket).otherwise(out)
    return out


def open_items(items: DataFrame, kind: str, stage: str, seq: str) -> DataFrame:
    """Counts by kind and stage with the first place at which each was seen."""
    return items.groupBy(kind, stage).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first_seen"))


def extraction_method(blank: Column, pages: Column) -> Column:
    """text_layer if no page is blank, ocr if all are, else mixed."""
    return F.when(blank == 0, "text_layer").when(blank == pages, "ocr").otherwise("mixed")


def same_sets(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """(key, only_a, only_b, equal): how the item sets of each key differ; full outer on keys and items."""
    left = a.select(key, item).distinct().withColumn("_a", F.lit(1))
    right = b.select(key, item).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, [key, item], "full").groupBy(key)
    counted = both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))
    return counted.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))
