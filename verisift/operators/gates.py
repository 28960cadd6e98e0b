"""Integrity gates as queries: a violation is a row (gate, key, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.numbers import canonical_number, is_small_integer, numbers


def untraceable_numbers(memo: DataFrame, corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number) of memo numbers that no corpus text has in any form; an anti join on canonical values."""
    allowed = corpus.select(F.explode(numbers(F.col(text))).alias("_n")).select(canonical_number(F.col("_n")).alias("canonical")).distinct()
    claimed = memo.select(key, F.explode(numbers(F.col(text))).alias("number")).withColumn("canonical", canonical_number(F.col("number")))
    return claimed.filter(~F.coalesce(is_small_integer(F.col("canonical")), F.lit(False))).join(allowed, "canonical", "left_anti").select(key, "number")


def violations(df: DataFrame, key: str, gates: dict[str, Column]) -> DataFrame:
    """A row for each gate that a row breaks; one scan for all gates. A null condition is no violation."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in gates.items()]))
    return df.select(F.col(key).alias("key"), F.explode(broken).alias("gate")).select("gate", "key")


def missing(expected: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    return expected.select(key).join(produced.select(key), key, "left_anti")


def illegal_moves(moves: DataFrame, legal: DataFrame) -> DataFrame:
    """Rows of moves(from_state, to_state, ...) that no row of legal allows."""
    return moves.join(legal, ["from_state", "to_state"], "left_anti")
