"""Whole findings and their entries, and verified citations and fields, on small tables."""

from pyspark.sql import functions as F

from verisift.operators import scoring

READING = "run string, code string, fired boolean, evaluable boolean, confidence string, reasoning string, absence_evidence string"
CITED = "run string, code string, pass string, seq int, page int, quote string"
CHECKS = "run string, check string, seq int, outcome string, blocker string, owner string, reason string"
MODEL = "run string, seq int, field_path string, kind string, account string, stage_origin string, typical_source string, blocker_class string, unblock_owner string"
TEXT = "The manager commits two percent of the fund in cash"


def made(spark, lenient, strict, cited, checks=(), model=(), pairs=()):
    rules = spark.createDataFrame([("r", c, f"Rule {c}", "VETO" if c == "A" else "RED_FLAG") for c in "ABCD"], "run string, code string, name string, tier string")
    pages = spark.createDataFrame([("r", 1, TEXT), ("r", 2, None)], "run string, page int, text string")
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    needs, inverse = frame([("K", "A"), ("K", "B")], "check string, code string"), frame(pairs, "a string, b string")
    found = scoring.findings(rules, frame(lenient, READING), frame(strict, READING), frame(cited, CITED), pages, frame(checks, CHECKS), needs, inverse, "run")
    left = [(r["field_path"], r["kind"], r["origin"], r["blocker_class"], r["unblock_owner"]) for r in scoring.entries(found, frame(model, MODEL), inverse, "run").collect()]
    return {r["code"]: r for r in found.collect()}, sorted(left)


def yes(code, fired=True, evaluable=True, why="seen", absence=None):
    return ("r", code, fired, evaluable, "high", why, absence)


def test_evidence_of_the_reading_that_decides_and_of_both_if_they_differ(spark):
    cited = [
        ("r", "A", "lenient", 0, 1, "two  percent"), ("r", "A", "strict", 0, 1, "Two percent"), ("r", "A", "strict", 1, 9, "two percent"),
        ("r", "B", "lenient", 0, 1, "two percent"), ("r", "B", "strict", 0, 1, "in cash"), ("r", "B", "strict", 1, 2, "in cash"), ("r", "C", "lenient", 0, 9, "in cash"),
    ]
    found, left = made(spark, [yes("A"), yes("B"), yes("C")], [yes("A", False), yes("B"), ("r", "X", True, True, "high", "", None)], cited)
    items = lambda c: [(e["page"], e["quote"], e["verification"]) for e in found[c]["evidence"] or []]
    assert items("A") == [(1, "two  percent", "exact")] and found["A"]["status"] == "contested" and found["A"]["contested_reason"] == "fires by the lenient reading only"
    assert items("B") == [(1, "in cash", "exact"), (2, "in cash", "unverified")] and found["B"]["status"] == "fired"
    # its only citation is of a page that doesn't exist: nothing is left to support it
    assert items("C") == [] and found["C"]["fired"] is None and found["C"]["unevaluated_reason"] == scoring.UNSUPPORTED and found["C"]["contested"]
    assert found["D"]["unevaluated_reason"] == scoring.UNREAD and found["D"]["lenient"] is None and found["A"]["strict"]["reasoning"] == "seen"
    assert set(found) == set("ABCD")
    assert [x[:3] for x in left] == [
        ("A", "ANALYST_ANSWERABLE", "contested"), ("C", "ANALYST_ANSWERABLE", "contested"), ("C", "EXTERNALLY_BLOCKED", "unevaluated"), ("D", "EXTERNALLY_BLOCKED", "unevaluated"),
    ]


def test_a_blocked_rule_keeps_what_was_read_before(spark):
    checks = [("r", "K", 2, "UNAVAILABLE", "captcha", "procurement", "late"), ("r", "K", 1, "UNAVAILABLE", None, None, "down"), ("r", "L", 0, "UNAVAILABLE", "geo_fence", "infrastructure", "x")]
    both = [yes("A", absence="all pages"), yes("B", False), yes("C", absence="all pages"), yes("D", False, False, "no access")]
    found, left = made(spark, both, both, [], checks)
    a = found["A"]
    assert (a["fired"], a["status"], a["confidence"], a["contested"], a["before_policy"]["fired"], a["before_policy"]["reasoning"]) == (None, "veto_unevaluated", "low", False, True, "seen")
    assert a["reasoning"] == f"{scoring.UNREACHABLE}: K: down; K: late" and a["blocker"] == "captcha"
    assert found["C"]["before_policy"] is None and found["D"]["unevaluated_reason"] == "no access"
    assert left == [
        ("A", "EXTERNALLY_BLOCKED", "blocked", "captcha", "procurement"), ("A", "EXTERNALLY_BLOCKED", "unevaluated", "captcha", "procurement"),
        ("B", "EXTERNALLY_BLOCKED", "unevaluated", "captcha", "procurement"), ("D", "EXTERNALLY_BLOCKED", "unevaluated", None, "manual_analyst_check"),
    ]


def test_inverse_rules_and_entries_of_readings_once(spark):
    both = [yes(c, absence="all pages") for c in "ABCD"]
    model = [("r", i, "f", None, a, None, None, None, None) for i, a in enumerate(["same", "same", "Same", None])]
    found, left = made(spark, both, both, [], model=model, pairs=[("A", "C"), ("A", "Z")])
    assert {c: r["contested"] for c, r in found.items()} == {"A": True, "B": False, "C": True, "D": False}
    assert found["A"]["fired"] and found["A"]["contested_reason"] == "A and C exclude each other, and both fired"
    assert [x[:3] for x in left] == [("A", "ANALYST_ANSWERABLE", "contested"), ("A+C", "ANALYST_ANSWERABLE", "pair"), ("C", "ANALYST_ANSWERABLE", "contested")] + [
        ("f", "EXTERNALLY_BLOCKED", "reading")
    ] * 3


def test_no_rules_and_no_readings(spark):
    found, left = made(spark, [], [], [])
    assert all(r["fired"] is None for r in found.values()) and len(left) == 4


def test_fields_with_quotes(spark):
    rows = [(1, 1, "two percent", "high"), (2, 1, "three percent", "high"), (3, 7, "two percent", "high"), (4, None, "two percent", "high"), (5, 1, " ", None)]
    fields = spark.createDataFrame([("r", *x) for x in rows], "run string, i int, page int, quote string, confidence string")
    pages = spark.createDataFrame([("r", 1, TEXT)], "run string, page int, text string")
    out = scoring.verified_fields(fields, pages, "run")
    got = [(r["confidence"], r["verification"], r["quote_verified"]) for r in out.orderBy("i").collect()]
    assert got == [("high", "exact", True), ("low", "unverified", False), ("high", "out_of_range", False), ("high", None, None), (None, None, None)]
    assert [tuple(r) for r in scoring.quote_counts(out, ["run"]).collect()] == [("r", 2, 1, 1)]
    cited = scoring.verified_citations(fields.filter(F.col("i") < 4), pages, "run")
    assert cited.count() == 3 and cited.filter("verification = 'out_of_range'").count() == 1
