"""Rule sets as tables: projections, validation and the lint of their guidance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tiers, severities, the least guidance, and words of which guidance should hold one.
TIERS = ("GREEN_FLAG", "RED_FLAG", "VETO")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
MIN_GUIDANCE = 40
NOUNS = (
    "fee", "carry", "hurdle", "return", "irr", "auditor", "custodian", "registrar", "counsel", "valuation", "track record", "fund",
    "manager", "sponsor", "sebi", "registration", "commitment", "capital", "portfolio", "sector", "investor", "committee", "team",
    "document", "date", "distribution", "waterfall", "catch-up", "dpi", "exit", "clause", "succession", "enforcement", "aif", "number",
    "policy", "provider", "lp", "gp", "anchor", "position",
)
#: Columns that a reading is shown; why a rule exists isn't among them.
PAYLOAD = ("criterion_code", "name", "tier", "category", "severity", "detection_guidance", "evidence_requirement")


def active(criteria: DataFrame) -> DataFrame:
    return criteria.filter("is_active")


def by_code(criteria: DataFrame, code: str) -> DataFrame:
    """The first rule of a code, or no row."""
    return criteria.filter(F.col("criterion_code") == code).orderBy("seq").limit(1)


def payload(criteria: DataFrame) -> DataFrame:
    return active(criteria).select(*PAYLOAD)


def has_noun(guidance: Column) -> Column:
    return F.exists(F.array(*map(F.lit, NOUNS)), lambda n: F.contains(F.lower(guidance), n))


def gates() -> dict[str, Column]:
    """Gates of one rule, for gates.violations; repeated codes are found by `repeated_codes`."""
    none = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return {
        "code_missing": none("criterion_code"),
        "tier_unknown": ~F.coalesce(F.col("tier").isin(*TIERS), F.lit(False)),
        "severity_unknown": ~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)),
        "weight_not_positive": ~F.coalesce(F.col("weight").try_cast("double") > 0, F.lit(False)),
        "guidance_short": F.length(F.trim(F.coalesce("detection_guidance", F.lit("")))) < MIN_GUIDANCE,
        "text_missing": none("name") | none("category") | none("evidence_requirement"),
        "guidance_vague": ~has_noun(F.coalesce("detection_guidance", F.lit(""))),
    }


def repeated_codes(criteria: DataFrame) -> DataFrame:
    return criteria.groupBy("criterion_code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def set_status(version: Column) -> Column:
    """A rule set without a version is a draft."""
    return F.when(version.isNotNull(), "ACTIVE").otherwise("DRAFT")


def hashed(criteria: DataFrame, key: str, to: str = "rule_hash") -> DataFrame:
    """criteria with a digest of each rule's content: all columns but its key, by name."""
    content = F.struct(*[F.col(c) for c in sorted(criteria.columns) if c != key])
    return criteria.withColumn(to, F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256))


def reevaluated(found: DataFrame, before: DataFrame, after: DataFrame, key: str, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Findings of the rules `after`, from findings `found` of the rules `before`, evaluating only rules that are new or changed.

    Equal to evaluate(after) if a rule's findings depend on that rule alone; policies over
    several rules come afterwards. Rules that are gone lose their findings.
    """
    old, new = (hashed(df, key).select(key, "rule_hash") for df in (before, after))
    same = new.join(old, [key, "rule_hash"], "left_semi").select(key)
    kept = found.join(same, key, "left_semi")
    return kept.unionByName(evaluate(after.join(same, key, "left_anti")))
