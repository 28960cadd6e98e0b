"""Streaming forms of the event jobs; each takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verisift.operators import events
from verisift.sources.tables import STATUS

#: Fixed order of the stages of a run.
STAGES = ("classification", "extraction", "diligence", "scoring", "memo")


def status_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The status log as it grows; torn lines are dropped."""
    reader = spark.readStream.schema(STATUS).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def without_progress(stream: DataFrame) -> DataFrame:
    """Progress is display state, not an event."""
    return stream.filter(F.col("event") != "stage_progress")


def idempotent(stream: DataFrame, keys: list[str], at: str = "ts", late: str = "1 day") -> DataFrame:
    """The first write of each key; state is dropped once the watermark is past it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def daily(stream: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts and cost by day, stage and event, emitted when a day can't change any more."""
    return (
        stream.withWatermark(at, late)
        .groupBy(F.window(at, "1 day"), "stage", "event")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("cost"))
        .select(F.col("window.start").alias("day"), "stage", "event", "n", "cost")
    )


def in_stage_order(stream: DataFrame, expire_ms: int = 3_600_000) -> DataFrame:
    """(run_id, seq, stage) of each run's finished stages, strictly in order.

    A stage that ends before its predecessors waits in the run's state, which holds at
    most one flag per stage, and goes out with them; a repeated end is dropped. A run that
    is silent for `expire_ms` loses its state.
    """

    def emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, ended = state.get if state.exists else (0, 0)
        for batch in batches:
            for stage in batch["stage"]:
                if stage in STAGES:
                    ended |= 1 << STAGES.index(stage)
        out = []
        while done < len(STAGES) and ended >> done & 1:
            out.append((key[0], done, STAGES[done]))
            done += 1
        state.update((done, ended))
        state.setTimeoutDuration(expire_ms)
        if out:
            yield pd.DataFrame(out, columns=["run_id", "seq", "stage"])

    finished = stream.filter(F.col("event") == "stage_completed").select("run_id", "stage")
    return finished.groupBy("run_id").applyInPandasWithState(
        emit, "run_id string, seq int, stage string", "done int, ended int", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def projection_updates(stream: DataFrame, keys: list[str], order: list[str], fields: list[str], kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """The fold of partial updates as a stream: each field's last known value, for the keys that a batch touched.

    Events of other kinds are ignored. The state holds a value and its order for each key and
    field, in Spark's state store, so that late events are put where they belong. To be written in
    update mode, by `upserts`.
    """
    return events.latest_known(stream.filter(F.col(kind).isin(*kinds)), keys, order, fields)


def upserts(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the rows of a batch, whole, under the batch's number. A batch that is delivered again replaces itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return run


def projection(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What `upserts` has written so far: of each key the row of its last batch."""
    return events.first_by(spark.read.parquet(path), keys, ["batch"], last=True).drop("batch")


def compacted(spark: SparkSession, path: str, keys: list[str], target: str) -> int:
    """The projection as one table at another path, which `upserts` may go on from: its rows get the last batch's number, which is returned."""
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    projection(spark, path, keys).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={last}")
    return last
