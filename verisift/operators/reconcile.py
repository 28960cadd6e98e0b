"""Two readings of each rule, reconciled under three-valued logic, and the policy on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity multipliers, thresholds and the order of confidence.
SEVERITY = {"LOW": 1.0, "MEDIUM": 2.0, "HIGH": 3.0, "CRITICAL": 5.0}
HOLD_RED, HOLD_RATIO = 9.0, 2.0
CONFIDENCE = ("low", "medium", "high")


def lower_confidence(a: Column, b: Column) -> Column:
    """The lower of two; unknown ones are ignored, none known is low."""
    rank = lambda c: F.when(c.isin(*CONFIDENCE), F.array_position(F.array(*map(F.lit, CONFIDENCE)), c))
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.coalesce(F.least(rank(a), rank(b)), F.lit(1)).cast("int"))


def reconcile(criteria: DataFrame, lenient: DataFrame, strict: DataFrame, key: list[str]) -> DataFrame:
    """Findings: criteria with fired (null: not evaluated), status, contested and confidence.

    Readings hold key, fired, evaluable, confidence. Codes that no criterion has are
    dropped by the left joins. What one reading alone says stays, contested and of low
    confidence, even if that reading could not be evaluated.
    """

    def named(reading: DataFrame, to: str) -> DataFrame:
        return reading.select(*key, F.struct("fired", "evaluable", "confidence").alias(to))

    both = criteria.join(named(lenient, "_l"), key, "left").join(named(strict, "_s"), key, "left")
    l, s = F.col("_l"), F.col("_s")
    one = F.coalesce(s, l)
    unread = l.isNull() & s.isNull()
    single = l.isNull() | s.isNull()
    evaluable = F.coalesce(l["evaluable"], F.lit(True)) & F.coalesce(s["evaluable"], F.lit(True))
    lf, sf = F.coalesce(l["fired"], F.lit(False)), F.coalesce(s["fired"], F.lit(False))
    unknown = F.when(F.col("tier") == "VETO", "veto_unevaluated").otherwise("unevaluated")
    settled = lambda fired: F.when(fired, "fired").otherwise("not_fired")
    none = F.lit(None).cast("boolean")
    fired = F.when(unread, none).when(single, F.coalesce(one["fired"], F.lit(False))).when(evaluable, sf)
    status = (
        F.when(unread, unknown)
        .when(single, settled(F.coalesce(one["fired"], F.lit(False))))
        .when(~evaluable, unknown)
        .when(lf == sf, settled(sf))
        .otherwise("contested")
    )
    contested = F.when(unread, False).when(single, True).when(~evaluable, False).otherwise(lf != sf)
    confidence = (
        F.when(unread | (~single & ~evaluable), F.lit("low")).when(single | (lf != sf), "low").otherwise(lower_confidence(l["confidence"], s["confidence"]))
    )
    return both.withColumns({"fired": fired, "status": status, "contested": contested, "confidence": confidence}).drop("_l", "_s")


def weighted(findings: DataFrame) -> DataFrame:
    """Findings with effective_weight, and score_contribution, which only fired ones have."""
    times = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("severity"))
    effective = F.round(F.coalesce(times, F.lit(1.0)) * F.col("weight"), 2)
    return findings.withColumn("effective_weight", effective).withColumn(
        "score_contribution", F.when(F.col("fired"), F.col("effective_weight")).otherwise(0.0)
    )


def recommend(findings: DataFrame, by: list[str]) -> DataFrame:
    """One row per group with its weights, counts and recommendation; one aggregation."""
    veto, red, green = (F.col("tier") == t for t in ("VETO", "RED_FLAG", "GREEN_FLAG"))
    fired, firm = F.coalesce("fired", F.lit(False)), ~F.col("contested") & (F.col("confidence") != "low")
    weight = lambda tier: F.round(F.sum(F.when(tier & fired, F.col("effective_weight")).otherwise(0.0)), 2)
    scored = weighted(findings).groupBy(*by).agg(
        weight(red).alias("red_weight"),
        weight(green).alias("green_weight"),
        F.count_if(veto & fired & firm).alias("vetoes_decisive"),
        F.count_if(veto & fired & ~firm).alias("vetoes_downgraded"),
        F.count_if(red & fired).alias("red_fired"),
        F.count_if("contested").alias("contested_n"),
        F.count_if(F.col("fired").isNull()).alias("unevaluated_n"),
    )
    heavy = (F.col("red_weight") >= HOLD_RED) & (F.col("red_weight") > F.col("green_weight") * HOLD_RATIO)
    advice = (
        F.when(F.col("vetoes_decisive") > 0, "pass")
        .when((F.col("vetoes_downgraded") > 0) | heavy, "hold")
        .when(F.col("red_fired") > 0, "pursue_with_questions")
        .otherwise("pursue")
    )
    return scored.withColumn("recommendation", advice)


def block(findings: DataFrame, blocked: DataFrame, key: list[str]) -> DataFrame:
    """Findings whose key is blocked become not evaluated, uncontested and of low confidence."""
    marked = findings.join(blocked.select(*key).distinct().withColumn("_b", F.lit(True)), key, "left")
    hit = F.coalesce("_b", F.lit(False))
    return marked.withColumns(
        {
            "fired": F.when(~hit, F.col("fired")),
            "status": F.when(hit, F.when(F.col("tier") == "VETO", "veto_unevaluated").otherwise("unevaluated")).otherwise(F.col("status")),
            "contested": F.col("contested") & ~hit,
            "confidence": F.when(hit, "low").otherwise(F.col("confidence")),
        }
    ).drop("_b")
