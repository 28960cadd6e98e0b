"""Why two versions of an analysis differ: nine types of finding deltas, six of questions, and their causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRED, NOT_FIRED, CONTESTED, UNKNOWN, ABSENT = "FIRED", "NOT_FIRED", "CONTESTED", "VETO_UNEVALUATED", "ABSENT"
SETTLED = (FIRED, NOT_FIRED)
# Delta types by the states before and after.
DELTAS = (
    ((NOT_FIRED,), (FIRED,), "FLIPPED_TO_FIRED"),
    ((FIRED,), (NOT_FIRED,), "FLIPPED_TO_NOT_FIRED"),
    (SETTLED, (CONTESTED,), "BECAME_CONTESTED"),
    ((CONTESTED,), SETTLED, "CONTEST_RESOLVED"),
    ((UNKNOWN,), SETTLED, "BECAME_EVALUABLE"),
    (SETTLED, (UNKNOWN,), "BECAME_UNEVALUABLE"),
)
# Causes in the order in which they are tried, what tells them, and how sure they are.
CAUSES = (
    ("rule_changed", "CRITERIA_SET_CHANGE", "CERTAIN"),
    ("new_document", "EVIDENCE_DOCUMENT", "CERTAIN"),
    ("new_attestation", "EVIDENCE_ATTESTATION", "CERTAIN"),
    ("check_changed", "EXTERNAL_SOURCE_REACHABLE", "CERTAIN"),
    ("question_by_document", "EVIDENCE_DOCUMENT", "PROBABLE"),
    ("question_by_attestation", "EVIDENCE_ATTESTATION", "PROBABLE"),
    ("engine_changed", "ENGINE_VERSION_CHANGE", "INFERRED"),
)
UNATTRIBUTED = "UNATTRIBUTED"


def as_of(rows: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str) -> DataFrame:
    """rows with the version of their key that is valid at `at`: the last one since then; without one, nulls.

    Versions are cut into intervals first, so that a row meets one of them. Of several
    versions since one moment, any but one has an empty interval: they must differ in `since`.
    """
    until = F.lead(since).over(Window.partitionBy(*keys).orderBy(since))
    dated = versions.withColumn("_until", until).withColumnsRenamed({k: f"_v_{k}" for k in keys})
    same = [F.col(k) == F.col(f"_v_{k}") for k in keys]
    valid = (F.col(since) <= F.col(at)) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    joined = rows.join(dated, [*same, valid], "left")
    return joined.drop("_until", *[f"_v_{k}" for k in keys])


def finding_deltas(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old_state, new_state, delta) of old and new(keys, state, evidence: a sorted array).

    A side without the finding is ABSENT. Same state and evidence: UNCHANGED; a pair of
    states that no type names: OTHER.
    """
    before = old.select(*keys, F.struct("state", "evidence").alias("_o"))
    both = before.join(new.select(*keys, F.struct("state", "evidence").alias("_n")), keys, "full")
    o, n = F.coalesce("_o.state", F.lit(ABSENT)), F.coalesce("_n.state", F.lit(ABSENT))
    delta = F.when(F.col("_o").isNull(), "CRITERION_ADDED").when(F.col("_n").isNull(), "CRITERION_REMOVED")
    for a, b, name in DELTAS:
        delta = delta.when(o.isin(*a) & n.isin(*b), name)
    delta = delta.when((o == n) & ~F.col("_o.evidence").eqNullSafe(F.col("_n.evidence")), "EVIDENCE_STRENGTHENED").when(o == n, "UNCHANGED").otherwise("OTHER")
    return both.select(*keys, o.alias("old_state"), n.alias("new_state"), delta.alias("delta"), F.col("_o.evidence").alias("old_evidence"), F.col("_n.evidence").alias("new_evidence"))


def question_deltas(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome) of old and new(keys, kind, status), of six outcomes tried in order.

    A blocked question that is resolved became unblocked, rather than closed; one that only
    the earlier version has is closed.
    """
    both = old.select(*keys, F.struct("kind", "status").alias("_o")).join(new.select(*keys, F.struct("kind", "status").alias("_n")), keys, "full")
    blocked = lambda side: F.coalesce(F.col(f"{side}.kind") == "EXTERNALLY_BLOCKED", F.lit(False))
    now = F.coalesce("_n.status", F.lit(""))
    outcome = (
        F.when(F.col("_n").isNull(), "CLOSED")
        .when(F.col("_o").isNull(), "OPENED")
        .when(now == "DISMISSED", "DISMISSED")
        .when((now == "RESOLVED") & blocked("_o"), "BECAME_UNBLOCKED")
        .when(now == "RESOLVED", "CLOSED")
        .when(blocked("_n") & ~blocked("_o"), "BECAME_BLOCKED")
        .otherwise("PERSISTED")
    )
    return both.select(*keys, outcome.alias("outcome"))


def attributed(deltas: DataFrame, signs: dict[str, Column]) -> DataFrame:
    """Deltas with attribution and its confidence: the first of CAUSES whose sign is there; none is UNATTRIBUTED, and kept.

    A sign that isn't given, or null, is absent. A changed check counts for findings that
    became evaluable or stopped being so.
    """
    turned = F.col("delta").isin("BECAME_EVALUABLE", "BECAME_UNEVALUABLE")
    cause, sure = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for sign, name, confidence in CAUSES:
        holds = F.coalesce(signs.get(sign, F.lit(False)), F.lit(False)) & (turned if sign == "check_changed" else F.lit(True))
        cause, sure = cause.when(holds, name), sure.when(holds, confidence)
    return deltas.withColumns({"attribution": cause.otherwise(UNATTRIBUTED), "attribution_confidence": sure})
