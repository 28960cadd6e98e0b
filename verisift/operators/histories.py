"""Histories of any length under one key: running sums, state machines and queue depths in blocks.

A key's rows are cut into blocks by a column that never falls as their order rises (a day, a
range of ids). A task holds one block of a key at most; between blocks one row per block is
passed on. So a key with a third of all rows is dealt over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Legal moves (from, event, to) of the state machines; from None is the first step.
RUN_MOVES = (
    (None, "DEAL_SUBMITTED", "QUEUED"),
    (None, "ANALYSIS_RERUN_REQUESTED", "QUEUED"),
    ("QUEUED", "ANALYSIS_RUN_STARTED", "RUNNING"),
    ("QUEUED", "ANALYSIS_RUN_CANCELLED", "CANCELLED"),
    ("RUNNING", "L1_MEMO_GENERATED", "COMPLETED"),
    ("RUNNING", "ANALYSIS_RUN_FAILED", "FAILED"),
    ("RUNNING", "ANALYSIS_RUN_CANCELLED", "CANCELLED"),
    ("RUNNING", "lease expiry", "QUEUED"),
    ("FAILED", "sweeper retry", "QUEUED"),
    ("FAILED", "ANALYSIS_RUN_STARTED", "RUNNING"),
)
RUN_STAGE_MOVES = (
    (None, "DEAL_SUBMITTED", "PENDING"),
    ("PENDING", "started", "RUNNING"),
    ("RUNNING", "stage event", "COMPLETED"),
    ("RUNNING", "ANALYSIS_RUN_FAILED", "FAILED"),
    ("PENDING", "ANALYSIS_RUN_FAILED", "SKIPPED"),
    ("PENDING", "resumed", "COMPLETED"),
    ("COMPLETED", "started", "RUNNING"),
)
DEAL_MOVES = (
    (None, "DEAL_SUBMITTED", "SOURCING"),
    ("SOURCING", "advanced", "INITIAL_SCREENING"),
    ("SOURCING", "passed", "PASSED"),
    ("INITIAL_SCREENING", "advanced", "IDD"),
    ("INITIAL_SCREENING", "passed", "PASSED"),
    ("INITIAL_SCREENING", "backward", "SOURCING"),
    ("IDD", "advanced", "IC"),
    ("IDD", "passed", "PASSED"),
    ("IDD", "backward", "INITIAL_SCREENING"),
    ("IC", "approved", "COMMITMENT"),
    ("IC", "declined", "PASSED"),
    ("IC", "backward", "IDD"),
    ("COMMITMENT", "advanced", "ONGOING_MONITORING"),
    ("COMMITMENT", "backward", "IC"),
    ("ONGOING_MONITORING", "advanced", "ARCHIVED"),
    ("PASSED", "reopened", "INITIAL_SCREENING"),
)
QUESTION_MOVES = (
    (None, "raised", "OPEN"),
    (None, "raised blocked", "BLOCKED"),
    ("OPEN", "EVIDENCE_UPLOADED", "EVIDENCE_PENDING"),
    ("OPEN", "QUESTION_ANSWERED", "EVIDENCE_PENDING"),
    ("OPEN", "QUESTION_DISMISSED", "DISMISSED"),
    ("OPEN", "QUESTION_MARKED_BLOCKED", "BLOCKED"),
    ("EVIDENCE_PENDING", "absent later", "RESOLVED"),
    ("EVIDENCE_PENDING", "present later", "OPEN"),
    ("EVIDENCE_PENDING", "QUESTION_DISMISSED", "DISMISSED"),
    ("EVIDENCE_PENDING", "QUESTION_MARKED_BLOCKED", "BLOCKED"),
    ("BLOCKED", "absent later", "RESOLVED"),
    ("BLOCKED", "QUESTION_DISMISSED", "DISMISSED"),
    ("DISMISSED", "absent later", "RESOLVED"),
)
VERSION_MOVES = (
    (None, "ANALYSIS_RERUN_REQUESTED", "PENDING"),
    (None, "L1_MEMO_GENERATED", "CURRENT"),
    ("PENDING", "ANALYSIS_RUN_STARTED", "RUNNING"),
    ("RUNNING", "ANALYSIS_VERSION_CREATED", "CURRENT"),
    ("RUNNING", "ANALYSIS_RUN_FAILED", "FAILED"),
    ("RUNNING", "ANALYSIS_RUN_CANCELLED", "FAILED"),
    ("CURRENT", "ANALYSIS_VERSION_CREATED", "FROZEN"),
    ("PENDING", "ANALYSIS_RUN_CANCELLED", "FAILED"),
)
MACHINES = {"run": RUN_MOVES, "run_stage": RUN_STAGE_MOVES, "deal": DEAL_MOVES, "question": QUESTION_MOVES, "version": VERSION_MOVES}


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, block: Column, name: str) -> DataFrame:
    """df with the sum of `value` over a key's rows up to each row, as `name`.

    Blocks are summed first; the sum before a block then stands before its rows as a row
    of its own. Null keys are keys like any other, null values count as nothing (a sum of
    nothing but nulls is null).
    """
    rows = df.withColumns({"_block": block, "_value": value, "_row": F.lit(1)})
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_value"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_value", F.sum("_value").over(earlier)).withColumn("_row", F.lit(0))
    w = Window.partitionBy(*keys, "_block").orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(before.filter("_value IS NOT NULL"), allowMissingColumns=True)
    return both.withColumn(name, F.sum("_value").over(w)).filter("_row = 1").drop("_block", "_value", "_row")


def replayed(log: DataFrame, keys: list[str], order: list[str], event: str, moves: tuple, block: Column) -> DataFrame:
    """(keys, state, events, illegal, first_illegal) of each history under the legal moves (from, event, to).

    An event that no move allows, an unknown one included, is illegal and changes nothing;
    a history without a legal step has a null state. Each event is a map from states to
    states; the maps of a block are composed to one, and then the blocks' maps of a key.
    first_illegal holds the `order` of the first illegal event.
    """
    states = [None, *sorted({s for a, _, b in moves for s in (a, b) if s is not None})]
    place = {s: i for i, s in enumerate(states)}
    names = sorted({e for _, e, _ in moves})
    steps = {e: [-1] * len(states) for e in names}
    for a, e, b in moves:
        steps[e][place[a]] = place[b]
    table = F.array(*[F.array(*map(F.lit, steps[e])) for e in names], F.array(*map(F.lit, [-1] * len(states))))
    code = F.array_position(F.array(*map(F.lit, names)), F.col(event)) - 1
    code = F.when(F.coalesce(code, F.lit(-1)) < 0, len(names)).otherwise(code).cast("int")
    when = F.struct(*order)
    rows = log.select(*keys, block.alias("_block"), F.struct(when.alias("when"), F.get(table, code).alias("to")).alias("_step"))
    every = F.sequence(F.lit(0), F.lit(len(states) - 1))
    none = rows.schema["_step"].dataType["when"].dataType
    start = F.transform(every, lambda s: F.struct(s.alias("at"), F.lit(0).cast("long").alias("bad"), F.lit(None).cast(none).alias("first")))

    def step(state: Column, e: Column) -> Column:
        def moved(x: Column) -> Column:
            to = F.get(e["to"], x["at"])
            return F.struct(
                F.when(to < 0, x["at"]).otherwise(to).alias("at"),
                (x["bad"] + F.when(to < 0, 1).otherwise(0)).alias("bad"),
                F.coalesce(x["first"], F.when(to < 0, e["when"])).alias("first"),
            )

        return F.transform(state, moved)

    def then(state: Column, m: Column) -> Column:
        """One state further, through a block's map."""
        x = F.get(m["map"], state["at"])
        return F.struct(x["at"].alias("at"), (state["bad"] + x["bad"]).alias("bad"), F.coalesce(state["first"], x["first"]).alias("first"))

    blocks = rows.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list("_step")).alias("_steps"))
    maps = blocks.select(*keys, F.struct("_block", F.size("_steps").alias("n"), F.aggregate("_steps", start, step).alias("map")).alias("_m"))
    held = maps.groupBy(*keys).agg(F.array_sort(F.collect_list("_m"), lambda a, b: _compared(a["_block"], b["_block"])).alias("_maps"), F.sum("_m.n").alias("events"))
    end = F.aggregate("_maps", F.get(start, F.lit(0)), then)
    named = F.get(F.array(*[F.lit(s).cast("string") for s in states]), F.col("_end.at"))
    return held.withColumn("_end", end).select(
        *keys, named.alias("state"), "events", F.col("_end.bad").alias("illegal"), F.col("_end.first").alias("first_illegal")
    )


def _compared(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), 0).when(a.isNull() | (a < b), -1).otherwise(1)


def queue_daily(items: DataFrame, by: list[str], entered: str, left: str) -> DataFrame:
    """(by, day, entered, left, depth, waited): how many came and went on a day, how many wait at its end, and the mean days of those that went.

    A sweep of +1 and -1: days are summed first, so that the window holds a row for each day.
    What never entered is no item; what left before it entered is kept as it is.
    """
    known = items.filter(F.col(entered).isNotNull())
    both = known.select(*by, F.explode(F.array(F.struct(F.to_date(entered).alias("day"), F.lit(1).alias("n"), F.lit(None).cast("int").alias("waited")),
        F.struct(F.to_date(left).alias("day"), F.lit(-1).alias("n"), F.datediff(left, entered).alias("waited")))).alias("_e")).select(*by, "_e.*")
    days = both.filter("day IS NOT NULL").groupBy(*by, "day").agg(
        F.count_if(F.col("n") > 0).alias("entered"), F.count_if(F.col("n") < 0).alias("left"), F.sum("n").alias("_net"), F.avg("waited").alias("waited")
    )
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.select(*by, "day", "entered", "left", F.sum("_net").over(w).alias("depth"), "waited")
