"""Memo gates: sections by heading, bodies without scaffolding, agreement with the scorecard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verisift.functions.text import let

# The least of a section's body in characters, the form of a heading, and what is no text of a body's own.
MIN_BODY = 20
HEADING = r"^(#{1,6})\s+"
SCAFFOLDING = (r"(?m)^#.*$", r"(?m)^---+$", r"\[[^\]]*\]\(\./[^)]*\)", r"(?m)^_Written for:.*$")


def section(markdown: Column, title: str) -> Column:
    """What follows the first heading that holds the title, up to the next of its level or a higher one; null if there is none."""
    lines = F.transform(F.split(markdown, "\r?\n", -1), lambda x: F.struct(x.alias("line"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level")))

    def from_first(all_: Column) -> Column:
        titled = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: (all_[i]["level"] > 0) & F.contains(F.lower(all_[i]["line"]), F.lit(title.lower())))
        return F.when(F.size(titled) > 0, let(F.slice(all_, titled[0] + 1, F.size(all_)), up_to_next))

    def up_to_next(rest: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(rest) - 1), lambda i: (i > 0) & rest[i]["level"].between(1, rest[0]["level"]))
        body = F.slice(rest, 2, F.coalesce(F.get(ends, F.lit(0)), F.size(rest)) - 1)
        return F.array_join(F.transform(body, lambda x: x["line"]), "\n")

    return let(lines, from_first)


def bare_body(body: Column) -> Column:
    """A section's own text: no headings, rules, links of the navigation or audience line."""
    for pattern in SCAFFOLDING:
        body = F.regexp_replace(body, pattern, "")
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def memo_gates(stated: Column, computed: Column, memo_veto: Column, scored_veto: Column, body: Column, labels: dict[str, str]) -> dict[str, Column]:
    """Gates of a memo, for gates.violations: agreement, veto, exactly one verdict's label, a body at all."""
    same = lambda a, b: F.lower(F.trim(F.coalesce(a, F.lit("")))) == F.lower(F.trim(F.coalesce(b, F.lit(""))))
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), computed), computed)
    others = F.array(*[F.when(computed != verdict, F.lit(text)) for verdict, text in labels.items()])
    return {
        "recommendation_missing": F.trim(F.coalesce(stated, F.lit(""))) == "",
        "recommendation_differs": (F.trim(F.coalesce(stated, F.lit(""))) != "") & ~same(stated, computed),
        "veto_differs": F.coalesce(memo_veto, F.lit(False)) != F.coalesce(scored_veto, F.lit(False)),
        "label_missing": ~F.contains(F.coalesce(body, F.lit("")), label),
        "label_of_another": F.exists(F.array_compact(others), lambda x: F.contains(body, x)),
        "body_empty": F.length(bare_body(F.coalesce(body, F.lit("")))) < MIN_BODY,
    }
