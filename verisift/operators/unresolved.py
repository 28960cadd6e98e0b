"""Open questions: coercion, kind safety, validation, grouping, and whether a memo carries them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.text import one_spaced

# Kinds in the order in which they are listed, and what may name a source, a blocker and an owner.
KINDS = ("DOCUMENT_ANSWERABLE", "ANALYST_ANSWERABLE", "EXTERNALLY_BLOCKED")
SOURCES = ("ppm", "audited_accounts", "ddq", "side_letter")
BLOCKERS = ("geo_fence", "login_required", "captcha", "paid_source")
OWNERS = ("infrastructure", "procurement", "manual_analyst_check")
# What an account of a check that could not be performed says.
UNPERFORMED = (
    "could not be checked", "not performed", "could not be performed", "unreachable", "geo-fence", "geofence", "captcha",
    "requires an authenticated", "requires a login", "login required", "could not be evaluated",
)
BLOCKED = KINDS[2]
#: Characters of an account that tell entries of one field apart, and of its end that a memo must carry.
ACCOUNT_HEAD, ACCOUNT_TAIL = 160, 80


def leading_identifier(account: Column) -> Column:
    """First word of what stands before a dash between spaces, if that is at most 80 characters; else null."""
    out = F.lit(None).cast("string")
    for dash in reversed((" — ", " – ", " - ")):
        head = F.trim(F.substring_index(account, dash, 1))
        word = F.regexp_replace(F.regexp_extract(head, r"^\S+", 0), r"^[\[\]()]+|[\[\]()]+$", "")
        out = F.when(F.contains(account, F.lit(dash)) & (head != "") & (F.length(head) <= 80), word).otherwise(out)
    return out


def unperformed(account: Column) -> Column:
    text = F.lower(F.coalesce(account, F.lit("")))
    return F.exists(F.array(*map(F.lit, UNPERFORMED)), lambda m: F.contains(text, m))


def coerced(entries: DataFrame, stage: str) -> DataFrame:
    """Entries with a field path, a kind and a stage, whatever a model left out."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    return entries.withColumns(
        {
            "field_path": F.coalesce(blank("field_path"), leading_identifier(F.col("account")), F.lit("unspecified")),
            "kind": F.coalesce(blank("kind"), F.lit(BLOCKED)),
            "stage_origin": F.coalesce(blank("stage_origin"), F.lit(stage)),
            "account": F.coalesce("account", F.lit("")),
        }
    )


def kind_safety(entries: DataFrame) -> DataFrame:
    """Entries moved only towards blocked, without fields that their kind doesn't have; `forced` says why one was moved."""
    strange = ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
    moved = ~strange & (F.col("kind") != BLOCKED) & unperformed(F.col("account"))
    kind = F.when(strange | moved, F.lit(BLOCKED)).otherwise(F.col("kind"))
    blocked, by_document = kind == BLOCKED, kind == KINDS[0]
    allowed = lambda c, values: F.when(F.col(c).isin(*values), F.col(c))
    return entries.withColumns(
        {
            "forced": F.when(strange, "unrecognised kind").when(moved, "check not performed"),
            "typical_source": F.when(by_document, allowed("typical_source", SOURCES)),
            "blocker_class": F.when(blocked, allowed("blocker_class", BLOCKERS)),
            "unblock_owner": F.when(blocked, F.coalesce(allowed("unblock_owner", OWNERS), F.lit(OWNERS[2]))),
            "kind": kind,
        }
    )


def entry_gates() -> dict[str, Column]:
    """Gates of an entry, for gates.violations."""
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    blocked = F.col("kind") == BLOCKED
    return {
        "field_missing": none("field_path") | none("kind") | none("stage_origin") | none("account"),
        "kind_unknown": ~none("kind") & ~F.col("kind").isin(*KINDS),
        "blocked_names_source": blocked & F.col("typical_source").isNotNull(),
        "blocked_without_owner": blocked & none("unblock_owner"),
        "answerable_names_blocker": ~blocked & F.col("kind").isin(*KINDS) & (F.col("blocker_class").isNotNull() | F.col("unblock_owner").isNotNull()),
    }


def assembled(by_stage: dict[str, DataFrame], run: list[str], order: str, once: tuple[str, ...] = ("scoring",)) -> DataFrame:
    """All stages' entries; within the stages `once` each field path and beginning of an account once, the first by `order`.

    Accounts are told apart as they are written, case and blanks included.
    """
    parts = [df.withColumn("stage", F.lit(stage)) for stage, df in by_stage.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    twice, rest = F.col("stage").isin(*once), [c for c in every.columns if c not in (*run, "field_path", "stage")]
    head = F.substring(F.coalesce("account", F.lit("")), 1, ACCOUNT_HEAD).alias("_head")
    first = F.min_by(F.struct(*rest), order).alias("_first")
    columns = [*run, "field_path", "stage", *rest]
    kept = every.filter(twice).groupBy(*run, "field_path", "stage", head).agg(first).select(*run, "field_path", "stage", "_first.*")
    return every.filter(~twice).select(columns).unionByName(kept.select(columns))


def by_kind(entries: DataFrame, run: list[str]) -> DataFrame:
    """Counts in the fixed order, blocked last and unknown kinds after it; empty groups don't show."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)), F.lit(len(KINDS) + 1))
    return entries.groupBy(*run, "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place)


def by_owner(entries: DataFrame, run: list[str], seq: str) -> DataFrame:
    """Blocked entries by who can unblock them, with the first place at which the owner was seen."""
    owner = F.coalesce("unblock_owner", F.lit(OWNERS[2])).alias("owner")
    return entries.filter(F.col("kind") == BLOCKED).groupBy(*run, owner).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first_seen"))


def not_carried(entries: DataFrame, sections: DataFrame, run: list[str]) -> DataFrame:
    """(run, field_path, missing): entries that their run's section lacks, by path or by the end of a long account.

    An entry meets its own run's section only, through an equi-join.
    """
    read = sections.select(*run, one_spaced(F.col("section")).alias("_section"))
    path, account = F.lower(F.trim(F.col("field_path"))), one_spaced(F.coalesce("account", F.lit("")))
    no_path = (path != "") & ~F.contains(F.coalesce("_section", F.lit("")), path)
    no_tail = (F.length(account) > ACCOUNT_TAIL) & ~F.contains(F.coalesce("_section", F.lit("")), F.substring(account, -ACCOUNT_TAIL, ACCOUNT_TAIL))
    missing = F.when(no_path, "field_path").when(no_tail, "account")
    return entries.join(read, run, "left").select(*run, "field_path", missing.alias("missing")).filter("missing IS NOT NULL")
