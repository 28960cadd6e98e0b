"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, LF, VT, FF and CR.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch of texts.
ARROW_ROWS = 1000
#: Rows up to which a side may be broadcast; above it the same join is shuffled.
BROADCAST_ROWS = 100_000


#: Where the public tokenizers' files are if their module can't be imported.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; it must be the same on every executor."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return os.path.join(TOKENIZERS, name)
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """What a Python worker keeps from task to task of one operator, made if it isn't there."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def forget_others(name: str) -> None:
    """Drop what the worker keeps for other operators, which would add up along a pipeline."""
    for other in [n for n in _kept if n != name]:
        del _kept[other]


def in_arrow(df: DataFrame, function: Callable[[Iterator], Iterator], schema, keeps: str = "") -> DataFrame:
    """mapInArrow with batches of at most ARROW_ROWS rows, so that long texts fit a worker's memory.

    The session's limit is lowered for this, never raised. `keeps` names what the function
    takes from `kept`; the worker drops all else.
    """

    def run(batches: Iterator) -> Iterator:
        forget_others(keeps)
        yield from function(batches)

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case: the name with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though body uses it many times or inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the folder that the cluster shares.

    spark.checkpoint.dir is read from the session.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session in one process may do without, and gets a folder of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="verisift-")
    return place


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df as it is.

    df must be cheap to count: a checkpoint, or a table that was read.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner", salts: int = 32
) -> DataFrame:
    """Equi-join in which the rows of one key of `left` are spread over `salts` tasks.

    Each row of `right`, which must hold few rows per key, is repeated once per salt;
    `by` is the column of `left` that deals its rows out.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
