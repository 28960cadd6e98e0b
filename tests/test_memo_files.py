"""A memo's files: gates in sequence, numbers that a memo declares, and what may be written."""

from pyspark.sql import functions as F

from verisift.jobs import versions
from verisift.operators import memo_files

ACCOUNT = "looked through every page of the deck, the register and both annexes and found it on none of the many pages"


def made(spark, files=(), entries=(), declared=(), scored=(("a", "hold", False), ("b", "pass", False))):
    """Two runs; run a's files are whole but for those given."""
    whole = {name: f"# Title\n_Written for: IC_\nIt says 2,500.00 and p. 777 here, nothing else" for name in memo_files.FILES}
    whole[memo_files.RECOMMENDATION] = f"# Verdict\n{memo_files.LABELS['hold']}"
    whole |= dict(files)
    rows = [("a", name, body) for name, body in whole.items() if body != "gone"]
    return memo_files.violations(
        spark.createDataFrame(rows, "run string, name string, body string"),
        spark.createDataFrame([("a", " HOLD ", None), ("b", "", True)], "run string, recommendation string, vetoed boolean"),
        spark.createDataFrame(list(scored), "run string, recommendation string, vetoed boolean"),
        spark.createDataFrame([("a", "see p. 2500 of it"), ("b", None)], "run string, text string"),
        spark.createDataFrame(list(declared), "run string, number string"),
        spark.createDataFrame(list(entries), "run string, field_path string, account string"),
        "run",
    )


def of(broken, run="a"):
    return [(r["gate"], r["name"], r["detail"]) for r in broken.filter(F.col("run") == run).orderBy("step", "name", "detail").collect()]


def test_a_whole_memo_passes_and_one_without_files_does_not(spark):
    broken = made(spark)
    assert of(broken) == []
    assert of(broken, "b") == [("file_missing", name, "") for name in memo_files.FILES] + [("recommendation_missing", "", ""), ("veto_differs", "", "")]
    files = spark.createDataFrame([("a", "00-index.md"), ("a", "notes.md"), ("b", "00-index.md")], "run string, name string")
    assert [tuple(r) for r in memo_files.passed(files, broken, "run").collect()] == [("a", "00-index.md")]


def test_every_file_is_swept_and_the_first_gate_is_the_first(spark):
    files = {"07-team.md": "gone", "10-asks.md": "# Asks\n---\n", "12-sources.md": "It cites 431 pages, 99 of them twice", "extra.md": None}
    broken = made(spark, files)
    assert of(broken) == [("file_missing", "07-team.md", ""), ("file_empty", "10-asks.md", ""), ("number_untraceable", "12-sources.md", "431")]
    assert [(r["run"], r["gate"], r["name"]) for r in memo_files.first_violations(broken, "run").orderBy("run").collect()] == [
        ("a", "file_missing", "07-team.md"),
        ("b", "file_missing", "00-index.md"),
    ]
    assert of(made(spark, {"12-sources.md": "It cites 431 pages, 99 of them twice"}, declared=[("a", "431"), ("b", None)])) == []


def test_open_entries_and_a_missing_scorecard(spark):
    entries = [("a", "Fee.Rate", ACCOUNT), ("a", "fee.hurdle", None), ("a", "fee.rate", ACCOUNT)]
    carried = f"# 11\n## Open Questions\n- fee.rate: {ACCOUNT}\n- fee.hurdle\n## Other\n"
    assert of(made(spark, {memo_files.OPEN_QUESTIONS: carried}, entries)) == []
    outside = f"# 11 is a file\n## Open Questions\nfee.rate\n## Other\nfee.hurdle {ACCOUNT}"
    at = memo_files.OPEN_QUESTIONS
    assert of(made(spark, {at: outside}, entries)) == [("entry_missing", at, "fee.hurdle"), ("account_missing", at, "Fee.Rate"), ("account_missing", at, "fee.rate")]
    blank = "Something of some length stands before\n## Open Questions\n \n"
    assert of(made(spark, {at: blank}, entries)) == [("open_questions_empty", at, "")]
    assert of(made(spark, scored=[("b", "pass", False)])) == [("scorecard_missing", "", "")]


def test_two_labels_are_none(spark):
    both = f"# Verdict\n{memo_files.LABELS['hold']}, or {memo_files.LABELS['pass']}"
    assert of(made(spark, {memo_files.RECOMMENDATION: both})) == [("label_of_another", memo_files.RECOMMENDATION, "")]


def test_declared_numbers(spark):
    entries = [("a", "EXTERNALLY_BLOCKED", None)] * 3 + [("a", "EXTERNALLY_BLOCKED", "procurement"), ("a", "ANALYST_ANSWERABLE", None)]
    cited = [("a", 1, True), ("a", 1, False), ("a", 2, None), ("a", None, False)]
    numbers = memo_files.declared_numbers(
        spark.createDataFrame(entries, "run string, kind string, unblock_owner string"),
        spark.createDataFrame(cited, "run string, page int, quote_verified boolean"),
        spark.createDataFrame([("a", False), ("a", None), ("a", True)], "run string, disclosed boolean"),
        spark.createDataFrame([("a", 0.6667, 12, None, 1234.5), ("b", None, None, None, 0.0)], "run string, agreement_rate double, red_flag_weight int, green_flag_weight int, cost_usd double"),
        "run",
    )
    assert {r["number"] for r in numbers.filter("run = 'a'").collect()} == {"5", "4", "1", "3", "2", "66.7", "12", "1,234.50"}
    assert numbers.filter("run = 'b'").count() == 0


def test_memos_are_dealt_over_tasks_before_they_become_files(spark, monkeypatch):
    monkeypatch.setattr(versions, "MEMOS", 20)
    files, _ = versions._memo(spark, "/root/testdata/sf0.001")
    assert files.count() > 2000 and files.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 13 * 60


def test_outcomes_are_first_violations_and_whole_memos(spark):
    files = spark.createDataFrame([("a", "00-index.md"), ("a", "01-recommendation.md"), ("a", "notes.md"), ("b", "00-index.md")], "run string, name string")
    broken = spark.createDataFrame([("b", 2, "file_empty", "x", ""), ("b", 1, "file_missing", "y", ""), ("c", 3, "scorecard_missing", "", "")], "run string, step int, gate string, name string, detail string")
    assert {tuple(r) for r in memo_files.outcomes(files, broken, "run").collect()} == {("a", "passed", "files: 2"), ("b", "file_missing", "y"), ("c", "scorecard_missing", "")}
