"""A memo as a set of files: the gates in sequence over all of them, the numbers that a memo may state, and what is published.

Gates meet through equi-joins on the run, numbers on the run and their value, so that a run
with a third of all rows is dealt over tasks by its numbers.

Defined results
- a run without a scorecard breaks `scorecard_missing`, and what would compare with it is not asked;
- a file that is missing is neither empty nor without a label; of several rows of one file each is checked;
- null bodies are empty, null numbers and texts allow nothing, and an empty table of runs gives no rows;
- a violation that several rows show is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.numbers import all_numbers, canonical_number, is_small_integer, numbers
from verisift.operators import memo, unresolved

# A memo's files in reading order, the two that gates name, and a section's two titles.
FILES = (
    "00-index.md", "01-recommendation.md", "02-rationale.md", "03-fund-facts.md", "04-risk-factors.md", "05-supporting-factors.md", "06-fees-and-terms.md",
    "07-team.md", "08-track-record.md", "09-contested-findings.md", "10-asks.md", "11-open-questions.md", "12-sources.md",
)
RECOMMENDATION, OPEN_QUESTIONS = "01-recommendation.md", "11-open-questions.md"
TITLES = ("Open Questions", "What We Could Not Determine")
# What the file of the recommendation says for each verdict.
LABELS = {
    "pass": "PASS — do not proceed",
    "hold": "HOLD — defer pending answers",
    "pursue_with_questions": "PURSUE WITH QUESTIONS — proceed to manager interview",
    "pursue": "PURSUE — proceed",
}
#: The gates in the order in which they stop a memo.
GATES = (
    "file_missing", "file_empty", "scorecard_missing", "recommendation_missing", "recommendation_differs", "veto_differs", "label_missing",
    "label_of_another", "number_untraceable", "open_questions_empty", "entry_missing", "account_missing",
)


def _broken(df: DataFrame, run: str, name: Column, conditions: dict[str, Column]) -> DataFrame:
    """(run, gate, name, detail) of the conditions that hold, in one scan."""
    gates = F.array_compact(F.array(*[F.when(c, F.lit(gate)) for gate, c in conditions.items()]))
    return df.select(run, F.explode(gates).alias("gate"), name.alias("name"), F.lit("").alias("detail"))


def _incomplete(files: DataFrame, memos: DataFrame, run: str) -> DataFrame:
    """Files of the fixed list that a run lacks, and those with nothing beyond their scaffolding."""
    place = F.array_position(F.array(*map(F.lit, FILES)), F.col("name")).cast("int")
    held = files.filter(F.col("name").isin(*FILES)).groupBy(run).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), place)).alias("_held"))
    bits = F.coalesce("_held", F.lit(0))
    lacking = F.array_compact(F.array(*[F.when(bits.bitwiseAND(1 << i) == 0, F.lit(name)) for i, name in enumerate(FILES, 1)]))
    missing = memos.select(run).join(held, run, "left").select(run, F.lit("file_missing").alias("gate"), F.explode(lacking).alias("name"), F.lit("").alias("detail"))
    empty = F.col("name").isin(*FILES) & (F.length(memo.bare_body(F.coalesce("body", F.lit("")))) < memo.MIN_BODY)
    return missing.unionByName(_broken(files, run, F.col("name"), {"file_empty": empty}))


def _disagreeing(files: DataFrame, memos: DataFrame, scored: DataFrame, run: str) -> DataFrame:
    """A memo's verdict and veto against its scorecard's, in its fields and in the file that a reader opens."""
    computed = scored.select(run, F.col("recommendation").alias("_computed"), F.col("vetoed").alias("_vetoed"))
    body = files.filter(F.col("name") == RECOMMENDATION).select(run, F.col("body").alias("_body"), F.lit(True).alias("_there"))
    both = memos.select(run, "recommendation", "vetoed").join(computed, run, "left").join(body, run, "left")
    known = F.coalesce(F.col("_computed"), F.lit("")) != ""
    asked = memo.memo_gates(F.col("recommendation"), F.col("_computed"), F.col("vetoed"), F.col("_vetoed"), F.col("_body"), LABELS)
    of_fields = {gate: known & asked[gate] for gate in ("recommendation_missing", "recommendation_differs", "veto_differs")}
    rendered = {gate: known & F.col("_there") & asked[gate] for gate in ("label_missing", "label_of_another")}
    return _broken(both, run, F.lit(""), {"scorecard_missing": ~known} | of_fields).unionByName(_broken(both, run, F.lit(RECOMMENDATION), rendered))


def _untraceable(files: DataFrame, sources: DataFrame, declared: DataFrame, run: str) -> DataFrame:
    """Numbers of any file that no source of the run has in any form, and that the run doesn't declare."""
    value = canonical_number(F.col("detail")).alias("_value")
    long_ = F.filter(numbers(F.col("body")), lambda n: F.length(n) > 2)  # two characters are a small integer
    stated = files.select(run, "name", F.explode(long_).alias("detail")).select("*", value)
    stated = stated.filter(~F.coalesce(is_small_integer(F.col("_value")), F.lit(False)))
    found = sources.select(run, F.explode(all_numbers(F.col("text"))).alias("detail")).unionByName(declared.select(run, F.col("number").alias("detail")))
    allowed = found.filter("detail IS NOT NULL").select(run, value).distinct()
    return stated.join(allowed, [run, "_value"], "left_anti").select(run, F.lit("number_untraceable").alias("gate"), "name", "detail")


def _dropped(files: DataFrame, entries: DataFrame, run: str) -> DataFrame:
    """Open entries that the file of open questions lacks; the whole file stands for a section that it doesn't have."""
    body = F.coalesce("body", F.lit(""))
    section = F.coalesce(*[memo.section(body, title) for title in TITLES], body)
    sections = files.filter(F.col("name") == OPEN_QUESTIONS).select(run, section.alias("section"))
    blank = sections.filter(F.trim(F.regexp_replace("section", r"\s+", " ")) == "")
    empty = blank.join(entries.select(run).distinct(), run, "left_semi").select(run, F.lit("open_questions_empty").alias("gate"), F.lit("").alias("detail"))
    asked = entries.join(sections.select(run), run, "left_semi").join(blank.select(run), run, "left_anti")
    gate = F.when(F.col("missing") == "account", "account_missing").otherwise("entry_missing").alias("gate")
    lost = unresolved.not_carried(asked, sections, [run]).select(run, gate, F.col("field_path").alias("detail"))
    return empty.unionByName(lost).select(run, "gate", F.lit(OPEN_QUESTIONS).alias("name"), "detail")


def violations(files: DataFrame, memos: DataFrame, scored: DataFrame, sources: DataFrame, declared: DataFrame, entries: DataFrame, run: str) -> DataFrame:
    """(run, step, gate, name, detail): all that keeps a memo from being published; step is the gate's place.

    files(run, name, body); memos and scored(run, recommendation, vetoed), one row a run; sources(run, text)
    are pages and texts of artifacts; declared(run, number) is `declared_numbers`; entries(run, field_path,
    account) are open. A single numeral of the memo must be traceable whichever file states it.
    """
    parts = [_incomplete(files, memos, run), _disagreeing(files, memos, scored, run), _untraceable(files, sources, declared, run), _dropped(files, entries, run)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    step = F.array_position(F.array(*map(F.lit, GATES)), F.col("gate")).cast("int").alias("step")
    return every.select(run, step, "gate", "name", "detail").distinct()


def first_violations(broken: DataFrame, run: str) -> DataFrame:
    """The violation that a run stops at: gates in their order, files and details in theirs."""
    return broken.groupBy(run).agg(F.min(F.struct("step", "gate", "name", "detail")).alias("_first")).select(run, "_first.*")


def passed(files: DataFrame, broken: DataFrame, run: str) -> DataFrame:
    """The files of runs without any violation: what a sink may write, the whole memo or nothing of it."""
    return files.filter(F.col("name").isin(*FILES)).join(broken.select(run).distinct(), run, "left_anti")


def outcomes(files: DataFrame, broken: DataFrame, run: str) -> DataFrame:
    """(run, gate, name): what each run stops at, or `passed` and how many files `passed` lets through; the violations are worked out once."""
    held = files.filter(F.col("name").isin(*FILES)).groupBy(run).agg(F.count(F.lit(1)).alias("_files"))
    both = held.join(first_violations(broken, run), run, "full")
    passes = F.concat(F.lit("files: "), F.col("_files").cast("string"))
    return both.select(run, F.coalesce("gate", F.lit("passed")).alias("gate"), F.when(F.col("gate").isNull(), passes).otherwise(F.col("name")).alias("name"))


def declared_numbers(entries: DataFrame, citations: DataFrame, absences: DataFrame, scored: DataFrame, run: str) -> DataFrame:
    """(run, number): what a memo counts itself, so that no size of number is exempt.

    entries(run, kind, unblock_owner): open ones in all, of each kind, and the blocked of each owner;
    citations(run, page, quote_verified): in all, their pages, the unverified and the others, those without a page
    left out; absences(run, disclosed): the undisclosed; scored(run, agreement_rate, red_flag_weight,
    green_flag_weight, cost_usd): the rate in percent, weights, and a cost other than zero in cents.
    """
    count = F.count(F.lit(1)).cast("string")
    paged = citations.filter(F.col("page").isNotNull())
    unverified = F.count(F.when(~F.col("quote_verified"), 1))
    cited = paged.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages"), unverified.alias("bad"))
    of_citations = F.array(*[c.cast("string") for c in (F.col("n"), F.col("pages"), F.col("bad"), F.col("n") - F.col("bad"))])
    rate = F.round(F.col("agreement_rate") * 100, 1).cast("string")
    cost = F.when(F.col("cost_usd") != 0, F.format_number("cost_usd", 2))
    of_scores = F.array(rate, F.col("red_flag_weight").cast("string"), F.col("green_flag_weight").cast("string"), cost)
    parts = [
        entries.groupBy(run).agg(count.alias("number")),
        unresolved.by_kind(entries, [run]).select(run, F.col("n").cast("string").alias("number")),
        entries.filter(F.col("kind") == unresolved.BLOCKED)
        .groupBy(run, F.coalesce("unblock_owner", F.lit(unresolved.OWNERS[2])).alias("_owner"))
        .agg(count.alias("number"))
        .select(run, "number"),
        cited.select(run, F.explode(of_citations).alias("number")),
        absences.groupBy(run).agg(F.count(F.when(~F.coalesce("disclosed", F.lit(False)), 1)).cast("string").alias("number")),
        scored.select(run, F.explode(F.array_compact(of_scores)).alias("number")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.distinct()
