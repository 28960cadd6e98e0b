"""Event logs: first verdicts, idempotent reads, order within a stream, roll-ups, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key: an aggregation with partial results, no sort of a key's rows."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    pick = (F.max_by if last else F.min_by)(rest, F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*")


def top_n(df: DataFrame, keys: list, order: list, n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def moves(df: DataFrame, keys: list, order: list, state: str, at: str) -> DataFrame:
    """Each row with from_state, to_state and the days since the row before; the first has no from_state.

    A key's rows are sorted in one task, as their order is what is asked for.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns(
        {
            "from_state": F.lag(state).over(w),
            "to_state": F.col(state),
            "days": F.datediff(F.col(at), F.lag(at).over(w)),
        }
    )


def latest_known(df: DataFrame, keys: list, order: list, fields: list[str]) -> DataFrame:
    """Fold of partial updates: each field's last value that is not null."""
    return df.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields])


def delta(old: DataFrame, new: DataFrame, key: str, state: str) -> DataFrame:
    """(key, old_state, new_state, change): full outer, a side without the key being ABSENT."""
    both = old.select(key, F.col(state).alias("_o")).join(new.select(key, F.col(state).alias("_n")), key, "full")
    o, n = F.coalesce("_o", F.lit("ABSENT")), F.coalesce("_n", F.lit("ABSENT"))
    change = F.when(o == n, "unchanged").when(o == "ABSENT", "added").when(n == "ABSENT", "removed").otherwise("changed")
    return both.select(key, o.alias("old_state"), n.alias("new_state"), change.alias("change"))


def rank_fusion(rankings: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score): the sum of 1 / (k + rank) over rankings(key, rank)."""
    union = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        union = union.unionByName(r.select(key, "rank"))
    return union.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
