"""Findings with their evidence: union of readings, repair, exclusive pairs, causes and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.text import one_spaced


def unknown_status(tier: Column) -> Column:
    return F.when(tier == "VETO", "veto_unevaluated").otherwise("unevaluated")


def evidence_union(evidence: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Evidence of all readings, one row per key, page and quote (white space and case aside): the first seen.

    One aggregation with partial results; `n` is how many rows stood for it.
    """
    place = one_spaced(F.col("quote")).alias("_quote")
    first = F.min_by(F.struct(*[c for c in evidence.columns if c not in (*key, "page")]), F.struct(*order)).alias("_first")
    return evidence.groupBy(*key, "page", place).agg(first, F.count(F.lit(1)).alias("n")).select(*key, "page", "_first.*", "n")


def within_pages(evidence: DataFrame, pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Evidence whose page exists; what cites another page is removed, what isn't verified stays."""
    return evidence.join(pages.select(doc, page).distinct(), [doc, page], "left_semi")


def has_support(evidence: Column, absence: Column) -> Column:
    return (F.size(F.coalesce(evidence, F.array())) > 0) | (F.trim(F.coalesce(absence, F.lit(""))) != "")


def repair_absence(findings: DataFrame, evidence: str = "evidence", absence: str = "absence_evidence") -> DataFrame:
    """A fired finding with neither evidence nor a statement of what was searched becomes not evaluated."""
    bare = F.coalesce("fired", F.lit(False)) & ~has_support(F.col(evidence), F.col(absence))
    return findings.withColumns(
        {
            "fired": F.when(~bare, F.col("fired")),
            "status": F.when(bare, unknown_status(F.col("tier"))).otherwise(F.col("status")),
            "repaired": bare,
        }
    )


def evidence_violations(evidence: Column, absence: Column, fired: Column) -> dict[str, Column]:
    """Gates of a finding: support at all, a page from 1 on, and a quote in each item."""
    on = F.coalesce(fired, F.lit(False))
    return {
        "evidence_missing": on & ~has_support(evidence, absence),
        "page_invalid": on & F.exists(evidence, lambda e: F.coalesce(e["page"] < 1, F.lit(True))),
        "quote_empty": on & F.exists(evidence, lambda e: F.trim(F.coalesce(e["quote"], F.lit(""))) == ""),
    }


def exclusive_pairs(findings: DataFrame, pairs: DataFrame, run: list[str], code: str) -> tuple[DataFrame, DataFrame]:
    """(findings, notes): inverse rules a, b of pairs that both fired become contested, and a note is kept for each pair.

    Pairs are a dimension, which Spark broadcasts if it is small; fired findings meet it
    twice, no finding meets another directly, and both stay fired.
    """
    fired = findings.filter("fired").select(*run, F.col(code).alias("_code"))
    first = fired.join(pairs, F.col("_code") == F.col("a")).drop("_code")
    notes = first.join(fired, [*run], "inner").filter(F.col("_code") == F.col("b")).select(*run, "a", "b").distinct()
    hit = notes.select(*run, F.explode(F.array("a", "b")).alias(code)).distinct().withColumn("_hit", F.lit(True))
    marked = findings.join(hit, [*run, code], "left")
    both = F.coalesce("_hit", F.lit(False))
    out = marked.withColumns({"contested": F.col("contested") | both, "status": F.when(both, "contested").otherwise(F.col("status"))})
    return out.drop("_hit").select(*findings.columns), notes


def blocked_causes(checks: DataFrame, criteria_of: DataFrame, run: list[str]) -> DataFrame:
    """(run, code, causes, first_check, blocker, owner) of rules whose checks were unavailable; the first by seq names them."""
    lost = checks.filter("outcome = 'UNAVAILABLE'").join(criteria_of, "check")
    first = F.min_by(F.struct("check", "blocker", "owner"), F.struct("seq", "check")).alias("_first")
    return (
        lost.groupBy(*run, "code")
        .agg(F.countDistinct("check").alias("causes"), first)
        .select(*run, "code", "causes", F.col("_first.check").alias("first_check"), "_first.blocker", "_first.owner")
    )


def veto_halt(findings: DataFrame, run: list[str]) -> DataFrame:
    """Whether a run halts: a fired veto of high confidence."""
    firm = (F.col("tier") == "VETO") & F.coalesce("fired", F.lit(False)) & (F.col("confidence") == "high")
    return findings.groupBy(*run).agg(F.bool_or(firm).alias("halted"), F.count_if(firm).alias("vetoes"))


def code_lists(findings: DataFrame, run: list[str], bucket: str, code: str) -> DataFrame:
    """Sorted codes of each bucket; a run has as many as the rule set, which is small."""
    return findings.groupBy(*run, bucket).agg(F.array_join(F.array_sort(F.collect_set(F.col(code).cast("string"))), ",").alias("codes"), F.count(F.lit(1)).alias("n"))
