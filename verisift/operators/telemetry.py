"""Roll-ups of attempts and citations: tokens, models in order, cache share, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COUNTERS = ("tok_in", "tok_out", "tok_cache_new", "tok_cache_read")
#: Citations of a page that are listed.
LISTED = 6


def tokens(*counters: str) -> Column:
    """All four counters; what was cached is spent too."""
    total = F.lit(0).cast("long")
    for c in counters or COUNTERS:
        total = total + F.coalesce(F.col(c), F.lit(0)).cast("long")
    return total


def cache_share(read: Column, new: Column, plain: Column) -> Column:
    """Percent of input that was read from the cache; null if there was no input."""
    return F.round(F.try_divide(100.0 * read, read + new + plain), 4)


def in_order(df: DataFrame, keys: list[str], value: str, seq: str, name: str, glue: str = "+") -> DataFrame:
    """Distinct values of each key in the order in which they came first; one row per value is shuffled, not one per attempt."""
    firsts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(seq).alias("_at"))
    ranked = F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("_v"))))
    return firsts.groupBy(*keys).agg(F.array_join(F.transform(ranked, lambda x: x["_v"]), glue).alias(name))


def totals(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Nine measures and the models of each key; retries are the attempts beyond a stage's calls."""
    stages = attempts.groupBy(*keys, "stage").agg(
        F.countDistinct("call_no").alias("calls"),
        F.count(F.lit(1)).alias("attempts"),
        F.sum(F.col("cost_usd").cast("decimal(18,4)")).alias("cost"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c) for c in COUNTERS],
        F.sum(F.col("billable_s").cast("decimal(18,4)")).alias("billable"),
        F.bool_or("fallback").alias("fallback"),
    )
    summed = stages.groupBy(*keys).agg(
        *[F.sum(c).cast("double" if c in ("cost", "billable") else "long").alias(c) for c in ("calls", "attempts", "cost", *COUNTERS, "billable")],
        F.sum(F.greatest(F.lit(0), F.col("attempts") - F.col("calls"))).alias("retries"),
        F.bool_or("fallback").alias("fallback"),
    )
    share = cache_share(F.col("tok_cache_read"), F.col("tok_cache_new"), F.col("tok_in"))
    return summed.withColumns({"tokens": tokens(), "cache_share": share}).join(in_order(attempts, keys, "model", "seq", "models"), keys, "left")


def citation_tallies(citations: DataFrame, keys: list[str]) -> DataFrame:
    """Citations, distinct pages, verified and unverified ones; one that wasn't checked is neither."""
    return citations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("citations"),
        F.countDistinct("page").alias("pages"),
        F.count_if(F.col("quote_verified")).alias("verified"),
        F.count_if(~F.col("quote_verified")).alias("unverified"),
    )


def by_page(citations: DataFrame, keys: list[str], order: list[str], claim: str) -> DataFrame:
    """Citations of each page with the first LISTED claims; no more than these meet in a row."""
    n = citations.groupBy(*keys, "page").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys, "page").orderBy(*order))
    first = citations.withColumn("_rank", rank).filter(F.col("_rank") <= LISTED)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col(claim).cast("string").alias("_claim")))), lambda x: x["_claim"])
    return n.join(first.groupBy(*keys, "page").agg(F.array_join(listed, ",").alias("claims")), [*keys, "page"])
