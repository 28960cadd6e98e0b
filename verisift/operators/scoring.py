"""Findings from readings to entries: reconciled, with verified evidence, repaired, under policy, and what they leave open.

`findings` is one plan over rules, readings, evidence, pages and checks; write its result,
then derive `entries` from the table written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.text import one_spaced
from verisift.operators import findings as parts
from verisift.operators.reconcile import block, reconcile
from verisift.operators.unresolved import ACCOUNT_HEAD, BLOCKED, KINDS, OWNERS, coerced, kind_safety
from verisift.operators.verify import verify_cited

UNREAD = "neither reading gave a verdict"
UNPERFORMED = "the check could not be performed"
UNSUPPORTED = "fired without evidence and without a statement of what was searched"
UNREACHABLE = "a source that this rule depends on was not available"
READING = ("fired", "evaluable", "confidence", "reasoning", "absence_evidence")


def verified_citations(cited: DataFrame, pages: DataFrame, run: str, page: str = "page", quote: str = "quote", text: str = "text") -> DataFrame:
    """Citations with verification and quote_verified; those of pages that don't exist stay, counted as out of range."""
    found = verify_cited(cited, pages, run, page, quote, text)
    return found.withColumn("quote_verified", F.col("verification").isin("exact", "layout"))


def verified_fields(fields: DataFrame, pages: DataFrame, run: str, page: str = "page", quote: str = "quote", text: str = "text") -> DataFrame:
    """Extracted fields with their quotes verified: an unverified one lowers its field's confidence, a page that doesn't exist only the flag.

    A field without a quote or without a page is passed on as it is, its verification null.
    """
    asked = (F.trim(F.coalesce(F.col(quote), F.lit(""))) != "") & F.col(page).isNotNull()
    found = verified_citations(fields, pages, run, page, quote, text)
    return found.withColumns(
        {
            "confidence": F.when(asked & (F.col("verification") == "unverified"), "low").otherwise(F.col("confidence")),
            "verification": F.when(asked, F.col("verification")),
            "quote_verified": F.when(asked, F.col("quote_verified")),
        }
    )


def quote_counts(verified: DataFrame, by: list[str]) -> DataFrame:
    """(by, checked, matched, out_of_range) of verified quotes, for each stage or run."""
    known = F.col("verification").isNotNull()
    return verified.groupBy(*by).agg(
        F.count_if(known & (F.col("verification") != "out_of_range")).alias("checked"),
        F.count_if(F.col("quote_verified")).alias("matched"),
        F.count_if(F.col("verification") == "out_of_range").alias("out_of_range"),
    )


def blocking(checks: DataFrame, criteria_of: DataFrame, run: str) -> DataFrame:
    """(run, code, causes, blocker, owner) of rules with unavailable checks; the first check by seq that has a blocker names it and its owner."""
    lost = checks.filter("outcome = 'UNAVAILABLE'").join(criteria_of, "check")
    said = F.transform(F.array_sort(F.collect_list(F.struct("seq", "check", "reason"))), lambda c: F.concat_ws(": ", c["check"], c["reason"]))
    first = F.min_by(F.struct("blocker", "owner"), F.when(F.col("blocker").isNotNull(), F.struct("seq", "check"))).alias("_first")
    return lost.groupBy(run, "code").agg(F.array_join(said, "; ").alias("causes"), first).select(
        run, "code", "causes", "_first.blocker", F.coalesce("_first.owner", F.lit(OWNERS[2])).alias("owner")
    )


def _evidence(cited: DataFrame, pages: DataFrame, run: str) -> DataFrame:
    """(run, code, _cited): each finding's citations of pages that exist, lenient ones first; a finding has few."""
    found = verified_citations(cited, pages, run).filter("verification <> 'out_of_range'")
    item = F.struct(
        F.when(F.col("pass") == "lenient", 0).otherwise(1).alias("strict"), "seq", "page", "quote", one_spaced(F.col("quote")).alias("norm"), "verification", "quote_verified"
    )
    return found.groupBy(run, "code").agg(F.array_sort(F.collect_list(item)).alias("_cited"))


def _once(items: Column) -> Column:
    """The first item of each page and quote."""
    same = lambda x: lambda y: y["page"].eqNullSafe(x["page"]) & y["norm"].eqNullSafe(x["norm"])
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, F.lit(1), i), same(x)))


def findings(
    criteria: DataFrame, lenient: DataFrame, strict: DataFrame, evidence: DataFrame, pages: DataFrame,
    checks: DataFrame, criteria_of: DataFrame, pairs: DataFrame, run: str,
) -> DataFrame:
    """Whole findings, one for each row of criteria(run, code, name, tier, ...).

    lenient and strict hold run, code and READING; evidence run, code, pass, seq, page and
    quote; pages run, page and text. Both readings are kept as they came. Evidence is that of
    the reading that decides, of both if they differ; what cites a page that doesn't exist
    is removed. A rule whose check was unavailable is not evaluated, whatever was read, and
    keeps the reading from before in `before_policy`. Inverse rules that both fired are contested.
    Rules of the same run and code, or two readings of one rule, are not expected.
    """
    key = [run, "code"]
    both = reconcile(criteria, lenient, strict, key)
    for name, reading in (("lenient", lenient), ("strict", strict)):
        both = both.join(reading.select(*key, F.struct(*READING).alias(name)), key, "left")
    l, s = F.col("lenient"), F.col("strict")
    single, unread = l.isNull() | s.isNull(), l.isNull() & s.isNull()
    s_evaluable, l_evaluable = (F.coalesce(x["evaluable"], F.lit(True)) for x in (s, l))
    differ = ~single & F.col("contested")
    # the strict reading decides if it fired, else the lenient one that fired, else the strict one
    by_lenient = F.when(single, s.isNull()).otherwise(~F.coalesce(s["fired"], F.lit(False)) & F.coalesce(l["fired"], F.lit(False)))
    chosen = F.when(by_lenient, l).otherwise(s)
    failed = F.coalesce(F.when(~s_evaluable, s["reasoning"]).otherwise(l["reasoning"]), F.lit(UNPERFORMED))
    why = F.when(unread, UNREAD).when(~single & ~(s_evaluable & l_evaluable), failed)
    cited = F.coalesce("_cited", F.expr("filter(_cited, x -> false)"))
    own = F.filter(cited, lambda x: x["strict"] == F.when(by_lenient, 0).otherwise(1))
    kept = F.when(differ, _once(cited)).otherwise(own)
    read = both.join(_evidence(evidence, pages, run), key, "left").withColumns(
        {
            "evidence": F.when(why.isNull(), F.transform(kept, lambda x: F.struct(x["page"], x["quote"], x["verification"], x["quote_verified"]))),
            "absence_evidence": F.when(why.isNull(), chosen["absence_evidence"]),
            "unevaluated_reason": why,
            "reasoning": F.coalesce(why, chosen["reasoning"]),
            "contested_reason": F.when(unread, F.lit(None).cast("string"))
            .when(l.isNull(), "no lenient reading").when(s.isNull(), "no strict reading")
            .when(F.col("contested") & F.coalesce(l["fired"], F.lit(False)), "fires by the lenient reading only").when(F.col("contested"), "fires by the strict reading only"),
        }
    ).drop("_cited")
    repaired = parts.repair_absence(read).withColumn("unevaluated_reason", F.when(F.col("repaired"), UNSUPPORTED).otherwise(F.col("unevaluated_reason")))
    repaired = repaired.withColumn("reasoning", F.when(F.col("repaired") & (F.trim(F.coalesce("reasoning", F.lit(""))) == ""), UNSUPPORTED).otherwise(F.col("reasoning")))
    return _exclusive(_blocked(repaired, blocking(checks, criteria_of, run), key), pairs, run)


def _blocked(found: DataFrame, lost: DataFrame, key: list[str]) -> DataFrame:
    before = found.join(lost, key, "left").withColumn("before_policy", F.when(F.col("causes").isNotNull(), F.struct("fired", "reasoning")))
    hit, reason = F.col("before_policy").isNotNull(), F.concat_ws(": ", F.lit(UNREACHABLE), F.nullif("causes", F.lit("")))
    return block(before, lost, key).withColumns({c: F.when(hit, reason).otherwise(F.col(c)) for c in ("reasoning", "unevaluated_reason")})


def _exclusive(found: DataFrame, pairs: DataFrame, run: str) -> DataFrame:
    marked, notes = parts.exclusive_pairs(found, pairs, [run], "code")
    told = notes.withColumn("_note", _inverse("a", "b")).select(run, F.explode(F.array("a", "b")).alias("code"), "_note")
    told = told.groupBy(run, "code").agg(F.array_join(F.array_sort(F.collect_set("_note")), " ").alias("_note"))
    reason = F.concat_ws(" ", "contested_reason", "_note")
    return marked.join(told, [run, "code"], "left").withColumn("contested_reason", F.nullif(reason, F.lit(""))).drop("_note")


def _inverse(a: str, b: str) -> Column:
    return F.concat(F.col(a), F.lit(" and "), F.col(b), F.lit(" exclude each other, and both fired"))


def entries(found: DataFrame, model: DataFrame, pairs: DataFrame, run: str) -> DataFrame:
    """What findings leave open: (run, field_path, kind, account, blocker_class, unblock_owner, origin).

    Entries of the readings, model(run, seq, field_path, kind, account, stage_origin, typical_source,
    blocker_class, unblock_owner), notes of fired rules that were blocked, and notes of inverse
    pairs are kept once for each field path and beginning of an account, in this order. One
    for each finding that isn't evaluated and one for each contested finding follow, never merged.
    """
    columns = [run, "field_path", "kind", "account", "blocker_class", "unblock_owner", "origin"]
    text = lambda x: F.lit(x).cast("string")

    def made(df: DataFrame, origin: str, path: Column, kind: str, account: Column, blocker: Column | None = None, owner: Column | None = None) -> DataFrame:
        values = (path, F.lit(kind), account, text(None) if blocker is None else blocker, text(None) if owner is None else owner, F.lit(origin))
        return df.select(run, *[v.alias(c) for c, v in zip(columns[1:], values, strict=True)])

    owner = F.coalesce("owner", F.lit(OWNERS[2]))
    safe = kind_safety(coerced(model, "scoring")).withColumn("origin", F.lit("reading")).select(*columns, F.lit(0).alias("_order"), F.col("seq").cast("long").alias("_seq"))
    was_fired = found.filter(F.coalesce("before_policy.fired", F.lit(False)))
    blocked = made(was_fired, "blocked", F.col("code"), BLOCKED, F.concat(F.col("code"), F.lit(" fired, but "), F.col("reasoning")), F.col("blocker"), owner)
    _, notes = parts.exclusive_pairs(found, pairs, [run], "code")
    inverse = made(notes, "pair", F.concat_ws("+", "a", "b"), KINDS[1], _inverse("a", "b"))
    three = safe
    for i, df in enumerate((blocked, inverse), 1):
        three = three.unionByName(df.withColumns({"_order": F.lit(i), "_seq": F.lit(0).cast("long")}))
    head = F.substring(F.coalesce("account", F.lit("")), 1, ACCOUNT_HEAD).alias("_head")
    first = F.min_by(F.struct("kind", "account", "blocker_class", "unblock_owner", "origin"), F.struct("_order", "_seq")).alias("_first")
    once = three.groupBy(run, "field_path", head).agg(first).select(run, "field_path", "_first.*")
    unknown = found.filter("fired IS NULL")
    reason = F.coalesce("unevaluated_reason", "reasoning", F.lit(""))
    open_ = made(unknown, "unevaluated", F.col("code"), BLOCKED, F.concat(F.col("name"), F.lit(" could not be evaluated: "), reason), F.col("blocker"), owner)
    told = F.concat(F.col("name"), F.lit(" is contested: "), F.coalesce("contested_reason", F.lit("")))
    disputed = made(found.filter("contested"), "contested", F.col("code"), KINDS[1], told)
    return once.select(columns).unionByName(open_).unionByName(disputed)
