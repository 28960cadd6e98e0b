"""The stages' operators on small tables of their own shapes."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from verisift.functions import parse
from verisift.functions.text import canonical
from verisift.jobs import stages
from verisift.operators import criteria, findings, gates, matching, memo, reconcile, runs, telemetry, unresolved, verify

EVIDENCE = "array<struct<page:int,quote:string>>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_one_reading_that_is_not_evaluable_keeps_its_verdict(spark):
    rules = spark.createDataFrame([("A", "VETO"), ("B", "RED_FLAG")], "code string, tier string")
    reading = spark.createDataFrame([("A", True, False, "high")], "code string, fired boolean, evaluable boolean, confidence string")
    got = {r["code"]: r for r in reconcile.reconcile(rules, reading, reading.filter("false"), ["code"]).collect()}
    assert (got["A"]["fired"], got["A"]["status"], got["A"]["contested"], got["A"]["confidence"]) == (True, "fired", True, "low")
    assert got["B"]["fired"] is None and got["B"]["status"] == "unevaluated"


def test_evidence_union_keeps_the_first_seen(spark):
    rows = [("r", 1, "Total  SIZE", 0, 0), ("r", 1, "total size ", 1, 0), ("r", 2, "total size", 1, 1), ("r", None, None, 0, 5)]
    out = findings.evidence_union(spark.createDataFrame(rows, "run string, page int, quote string, pass int, seq int"), ["run"], ["pass", "seq"]).collect()
    assert sorted((r["page"] or 0, r["quote"] or "", r["n"]) for r in out) == [(0, "", 1), (1, "Total  SIZE", 2), (2, "total size", 1)]
    pages = spark.createDataFrame([("d", 1)], "doc string, page int")
    kept = findings.within_pages(spark.createDataFrame([("d", 1, "x"), ("d", 9, "y")], "doc string, page int, quote string"), pages, "doc", "page")
    assert [r["quote"] for r in kept.collect()] == ["x"]


def test_absence_is_repaired_and_violations_found(spark):
    rows = [
        ("a", "VETO", True, "fired", [], None), ("b", "RED_FLAG", True, "fired", [], " looked at all pages"), ("c", "RED_FLAG", True, "fired", [(0, "q")], None),
        ("d", "RED_FLAG", True, "fired", [(1, " ")], None), ("e", "RED_FLAG", False, "not_fired", [], None), ("f", "RED_FLAG", None, "unevaluated", None, None),
    ]
    df = spark.createDataFrame(rows, f"code string, tier string, fired boolean, status string, evidence {EVIDENCE}, absence_evidence string")
    fixed = {r["code"]: (r["fired"], r["status"]) for r in findings.repair_absence(df).collect()}
    assert fixed["a"] == (None, "veto_unevaluated") and fixed["b"] == (True, "fired") and fixed["e"] == (False, "not_fired") and fixed["f"][0] is None
    broken = gates.violations(df, "code", findings.evidence_violations(F.col("evidence"), F.col("absence_evidence"), F.col("fired"))).collect()
    assert {(r["key"], r["gate"]) for r in broken} == {("a", "evidence_missing"), ("c", "page_invalid"), ("d", "quote_empty")}


def test_exclusive_pairs_causes_and_halt(spark):
    rows = [("r", "X", "VETO", True, False, "fired", "high"), ("r", "Y", "RED_FLAG", True, False, "fired", "low"), ("s", "X", "VETO", True, False, "fired", "medium"), ("s", "Y", "RED_FLAG", False, False, "not_fired", "high")]
    df = spark.createDataFrame(rows, "run string, code string, tier string, fired boolean, contested boolean, status string, confidence string")
    marked, notes = findings.exclusive_pairs(df, spark.createDataFrame([("X", "Y")], "a string, b string"), ["run"], "code")
    assert {(r["run"], r["code"], r["status"]) for r in marked.collect() if r["contested"]} == {("r", "X", "contested"), ("r", "Y", "contested")}
    assert marked.filter("fired").count() == 3 and [tuple(r) for r in notes.collect()] == [("r", "X", "Y")]
    assert {r["run"]: r["halted"] for r in findings.veto_halt(df, ["run"]).collect()} == {"r": True, "s": False}
    checks = [("r", "c2", 2, "UNAVAILABLE", "captcha", "infrastructure"), ("r", "c1", 1, "UNAVAILABLE", None, "procurement"), ("r", "c3", 0, "CLEAR", None, None)]
    causes = findings.blocked_causes(
        spark.createDataFrame(checks, "run string, check string, seq int, outcome string, blocker string, owner string"),
        spark.createDataFrame([("c1", "X"), ("c2", "X"), ("c3", "X")], "check string, code string"), ["run"],
    )
    assert [tuple(r) for r in causes.collect()] == [("r", "X", 2, "c1", None, "procurement")]


ENTRY = "run string, seq int, field_path string, kind string, stage_origin string, account string, typical_source string, blocker_class string, unblock_owner string"


def test_entries_are_coerced_and_only_moved_towards_blocked(spark):
    rows = [
        ("r", 1, None, "DOCUMENT_ANSWERABLE", None, "[team.size] of it — nothing on page 3", "ppm", "captcha", "procurement"),
        ("r", 2, "a.b", "ANALYST_ANSWERABLE", "x", "The site was UNREACHABLE", "ppm", None, None),
        ("r", 3, "c", "WHATEVER", "x", "y", "ppm", "rain", "nobody"), ("r", 4, None, None, None, None, None, None, None),
    ]
    out = {r["seq"]: r for r in unresolved.kind_safety(unresolved.coerced(spark.createDataFrame(rows, ENTRY), "scoring")).collect()}
    assert (out[1]["field_path"], out[1]["kind"], out[1]["stage_origin"], out[1]["typical_source"], out[1]["blocker_class"]) == ("team.size", "DOCUMENT_ANSWERABLE", "scoring", "ppm", None)
    assert (out[2]["kind"], out[2]["forced"], out[2]["unblock_owner"], out[2]["typical_source"]) == ("EXTERNALLY_BLOCKED", "check not performed", "manual_analyst_check", None)
    assert (out[3]["kind"], out[3]["forced"], out[3]["blocker_class"]) == ("EXTERNALLY_BLOCKED", "unrecognised kind", None)
    assert (out[4]["field_path"], out[4]["kind"], out[4]["account"], out[4]["forced"]) == ("unspecified", "EXTERNALLY_BLOCKED", "", None)
    raw = gates.violations(spark.createDataFrame(rows, ENTRY), "seq", unresolved.entry_gates()).collect()
    assert {(r["key"], r["gate"]) for r in raw} >= {(1, "field_missing"), (1, "answerable_names_blocker"), (3, "kind_unknown"), (4, "field_missing")}
    assert "forced" not in {r["gate"] for r in raw} and not [r for r in raw if r["key"] == 2]


def test_entries_are_assembled_grouped_and_carried(spark):
    a = spark.createDataFrame([("r", 1, "f", "ANALYST_ANSWERABLE", "s", "Same  account", None, None, None), ("r", 3, "g", "EXTERNALLY_BLOCKED", "s", "y" * 100, None, None, "procurement")], ENTRY)
    b = spark.createDataFrame([("r", 2, "f", "DOCUMENT_ANSWERABLE", "s", "same account", None, None, None), ("r", 4, "h", "NEW", "s", "z", None, None, None)], ENTRY)
    every = unresolved.assembled({"one": a, "two": b}, ["run"], "seq")
    assert {(r["field_path"], r["stage"], r["kind"]) for r in every.collect()} == {("f", "one", "ANALYST_ANSWERABLE"), ("g", "one", "EXTERNALLY_BLOCKED"), ("f", "two", "DOCUMENT_ANSWERABLE"), ("h", "two", "NEW")}
    scored = unresolved.assembled({"one": a, "scoring": b.union(b.withColumn("seq", F.lit(0)))}, ["run"], "seq")
    assert sorted((r["stage"], r["field_path"], r["seq"]) for r in scored.collect()) == [("one", "f", 1), ("one", "g", 3), ("scoring", "f", 0), ("scoring", "h", 0)]
    every = every.filter("kind <> 'DOCUMENT_ANSWERABLE'")
    assert {(r["kind"], r["place"]) for r in unresolved.by_kind(every, ["run"]).collect()} == {("ANALYST_ANSWERABLE", 2), ("EXTERNALLY_BLOCKED", 3), ("NEW", 4)}
    assert [tuple(r) for r in unresolved.by_owner(every, ["run"], "seq").collect()] == [("r", "procurement", 1, 3)]
    section = spark.createDataFrame([("r", "We ask about F and  G: yyyy")], "run string, section string")
    assert {(r["field_path"], r["missing"]) for r in unresolved.not_carried(every, section, ["run"]).collect()} == {("g", "account"), ("h", "field_path")}
    assert unresolved.not_carried(every, section.filter("false"), ["run"]).count() == 3


def test_every_entry_is_of_a_stage_and_only_scoring_merges(spark, tmp_path):
    """Numbers below zero are odd ones too; accounts that differ behind 160 characters are one within scoring, and all kept beside it."""
    long = "t" * 170
    rows = [(-105, 1, "click"), (-315, 3, "click"), (-210, 1, "click"), (105, 4, "click"), (211, 2, long), (213, 2, long), (210, 2, long), (212, 2, long)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = stages.unresolved_assembled(spark, str(tmp_path))
    assert sorted((r["stage"], r["seq"]) for r in found.collect()) == [("classification", n) for n in (-210, 210, 212)] + [("scoring", n) for n in (-315, -105, 105, 211)]
    assert_same(found, con, stages.ORACLES["unresolved_assembled"])


def test_memo_sections_and_gates(spark):
    text = "# Memo\n## 1. Summary\nshort\n## 11. Open Questions\nfirst\n### Deeper\nsecond\n## 12. End\nlast"
    assert one(spark, memo.section(F.lit(text), "open questions")) == "first\n### Deeper\nsecond"
    assert one(spark, memo.section(F.lit(text), "end")) == "last" and one(spark, memo.section(F.lit(text), "none such")) is None
    assert one(spark, memo.bare_body(F.lit("# Title\n---\n[Back](./a.md)\n_Written for: all_\n Body \n"))) == "Body"
    rows = [("fine", "HOLD ", "hold", True, True, "Our verdict is Hold, all told"), ("bad", None, "pass", False, True, "Hold"), ("other", "hold", "pass", False, False, "Pass on it, for many reasons")]
    df = spark.createDataFrame(rows, "run string, stated string, computed string, memo_veto boolean, veto boolean, body string")
    rules = memo.memo_gates(F.col("stated"), F.col("computed"), F.col("memo_veto"), F.col("veto"), F.col("body"), {"hold": "Hold", "pass": "Pass on it"})
    got = {(r["key"], r["gate"]) for r in gates.violations(df, "run", rules).collect()}
    assert got == {("bad", "recommendation_missing"), ("bad", "veto_differs"), ("bad", "label_missing"), ("bad", "label_of_another"), ("bad", "body_empty"), ("other", "recommendation_differs")}


def test_rules(spark):
    good = ("A", "Fee rule", "VETO", "fees", "HIGH", 1.0, "The management fee is above two per cent of commitments", "page", "why", "ask", True, 1)
    rows = [good, ("B", " ", "BLUE", "x", "NONE", 0.0, "vague", "e", None, None, False, 2)]
    names = "criterion_code string, name string, tier string, category string, severity string, weight double, detection_guidance string, evidence_requirement string, rationale string, remediation_prompt string, is_active boolean, seq int"
    df = spark.createDataFrame(rows, names)
    assert {(r["key"], r["gate"]) for r in gates.violations(df, "criterion_code", criteria.gates()).collect()} == {
        ("B", g) for g in ("tier_unknown", "severity_unknown", "weight_not_positive", "guidance_short", "text_missing", "guidance_vague")
    }
    assert criteria.active(df).count() == 1 and criteria.by_code(df, "B").count() == 1 and criteria.by_code(df, "C").count() == 0
    assert "rationale" not in criteria.payload(df).columns and criteria.repeated_codes(df.union(df)).count() == 2


def test_telemetry(spark):
    rows = [("r", "s", 1, 1, "a", 0.5, 10, 5, None, 30, 2.0, False), ("r", "s", 1, 2, "b", 0.25, 10, None, 10, 0, 1.0, True), ("r", "t", 2, 3, "a", 1.0, 0, 0, 0, 0, 0.0, False), ("q", "s", 1, 4, None, 0.0, 0, 0, 0, 0, 0.0, False)]
    df = spark.createDataFrame(rows, "run string, stage string, call_no int, seq int, model string, cost_usd double, tok_in long, tok_out long, tok_cache_new long, tok_cache_read long, billable_s double, fallback boolean")
    got = {r["run"]: r for r in telemetry.totals(df, ["run"]).collect()}
    r = got["r"]
    assert (r["calls"], r["attempts"], r["retries"], r["cost"], r["tokens"], r["models"], r["fallback"], r["cache_share"]) == (2, 3, 1, 1.75, 65, "a+b", True, 50.0)
    assert got["q"]["cache_share"] is None and got["q"]["models"] is None
    cites = spark.createDataFrame([("r", 1, True, i) for i in range(8)] + [("r", 2, False, 9), ("r", 2, None, 10)], "run string, page int, quote_verified boolean, claim int")
    assert [tuple(x) for x in telemetry.citation_tallies(cites, ["run"]).collect()] == [("r", 10, 2, 8, 1)]
    assert {(x["page"], x["n"], x["claims"]) for x in telemetry.by_page(cites, ["run"], ["claim"], "claim").collect()} == {(1, 8, "0,1,2,3,4,5"), (2, 2, "9,10")}


def test_run_rules(spark):
    say = lambda m: one(spark, runs.reason_bucket(F.lit(m)))
    assert [say(m) for m in ("Request TIMED OUT", "HTTP 429", "process exited 1", "odd", None)] == ["timeout", "rate_limit", "nonzero_exit", "unknown", "unknown"]
    rows = spark.createDataFrame([("r", i, 4.0) for i in range(5)], "run string, seq int, cost double")
    assert [r["spent"] for r in runs.within_budget(rows, ["run"], ["seq"], F.col("cost"), 13, F.col("seq") % 1).orderBy("seq").collect()] == [4.0, 8.0, 12.0]
    assert [(r["wait_minutes"], r["outcome"]) for r in runs.retried(rows, ["run"], ["seq"]).orderBy("seq").collect()] == [(2, "retry"), (8, "retry"), (32, "retry"), (None, "failed"), (None, "failed")]
    assert [one(spark, runs.extraction_method(F.lit(b), F.lit(4))) for b in (0, 4, 1)] == ["text_layer", "ocr", "mixed"]


def test_parsers(spark):
    assert one(spark, parse.parse_state(F.lit("1 to 25 of 120 records"))) == ("results", 120)
    assert one(spark, parse.parse_state(F.lit("No record(s) available")))["state"] == "empty" and one(spark, parse.parse_state(F.lit("")))["state"] == "unparseable"
    assert one(spark, parse.salvaged_json(F.lit("x ```json\n{\"a\": {\"b\": 1}}\n``` y"))) == '{"a": {"b": 1}}'
    assert one(spark, parse.salvaged_json(F.lit("[1]"))) is None and one(spark, parse.salvaged_json(F.lit("{broken"))) is None
    assert one(spark, parse.identifiers(F.lit("U12345MH2010PTC123456, L1MH, U12345MH2010PTC123456"))) == ["U12345MH2010PTC123456"]
    late = 'Sure: ```json {"k":1} ``` Done {not json}'
    assert one(spark, parse.salvaged_json(F.lit(late))) is None and one(spark, parse.salvaged_json(F.lit(late[6:]))) == '{"k":1}'
    counts = [999, 1000, 1250, 1500, 999_950, 999_949, 1_005_000, 2_340_000, *range(1050, 60_000, 100), *range(1_005_000, 40_000_000, 170_000)]
    plain = lambda n: f"{n / 1e6:.2f}M" if n >= 10**6 else f"{n / 1e3:.1f}k" if n >= 1000 else str(n)
    shown = spark.createDataFrame([(n,) for n in counts], "n long").select("n", parse.token_count(F.col("n")).alias("t")).collect()
    assert [(r.n, r.t) for r in shown if r.t != plain(r.n)] == []
    assert one(spark, parse.plain(F.lit("<td> R&amp;amp;D&rsquo;s &#8377;5 &#x20b9; &nope; &nbsp;</td>"))) == "R&amp;D’s ₹5 ₹ &nope;"
    assert one(spark, memo.section(F.lit("# A\r\n## 1. Open Questions\r\nx\r\n## B"), "open questions")) == "x"
    tree = '{"fund": {"size": {"value": "5", "page": 2, "quote": "five"}, "name": {"value": "N"}}}'
    assert one(spark, parse.dig(F.lit(tree), "fund.none.value")) is None


def test_overlap_against_all_pairs(spark):
    draw = random.Random(4)
    names = sorted({" ".join(sorted({f"w{min(draw.randrange(9), draw.randrange(9))}" for _ in range(draw.randrange(1, 6))})) for _ in range(80)})
    share = lambda a, b: len(set(a.split()) & set(b.split())) / max(1, min(len(a.split()), len(b.split())))
    expected = {(a, b) for a in names for b in names if a < b and share(a, b) >= 0.6}
    out = matching.overlapping(spark.createDataFrame([("k", n) for n in names], "k string, name string"), ["k"], "name", 0.6).collect()
    assert {(r["name"], r["other"]) for r in out} == expected and len(out) == len(expected) > 0


PAGE = "Total team Fund of size the 33 year members across offices in two cities and the ﬁrm has ﬁve oﬃces"


@pytest.mark.parametrize("quote, tier", [("The firm has five offices", "exact"), ("total team size 33 members across", "layout"), ("members team total 33 size across", "unverified"), ("", "unverified")])
def test_quotes_on_their_page(spark, quote, tier):
    pages = spark.createDataFrame([("d", 1, PAGE.replace("the ﬁrm", "The ﬁrm"))], "doc string, page int, text string")
    cited = spark.createDataFrame([("d", 1, quote), ("d", 7, quote)], "doc string, page int, quote string")
    got = {r["page"]: r["verification"] for r in verify.verify_cited(cited, pages, "doc", "page", "quote", "text").collect()}
    assert got == {1: tier, 7: "out_of_range"}


def test_search_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS page_id", "text")
    draw = random.Random(2)
    rows = []
    for r in docs.limit(25).collect():
        w = (r["text"] or "").split()[:60]
        for i in range(2):
            at, n = draw.randrange(max(1, len(w) - 12)), draw.choice([2, 3, 7, 12])
            part = w[at : at + n]
            cut = draw.randrange(1, max(2, len(part)))
            rows.append((10 * r["page_id"] + i, " ".join(part[:cut] + part[cut + i :])))
    quotes = spark.createDataFrame(rows, "quote_id long, quote string")
    found = {tuple(r) for r in verify.search_quotes(quotes, docs).collect()}
    both = quotes.select("quote_id", canonical(F.col("quote")).alias("q")).crossJoin(docs.select("page_id", canonical(F.col("text")).alias("p")))
    expected = both.select("quote_id", "page_id", verify.tier(F.col("q"), F.col("p")).alias("v")).filter("v <> 'unverified'").collect()
    assert found == {tuple(r) for r in expected} and found
