"""Histories in blocks, differences of versions and registrations, on small tables and against plain Python."""

import random

from pyspark.sql import functions as F

from verisift.operators import histories, registrations, versions


def test_running_sum_of_one_hot_key_is_that_of_all_its_blocks(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["hot", "hot", "hot", "a", None]), i, draw.choice([1, 2, 3, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {r["i"]: r["total"] for r in histories.running_sum(df, ["k"], ["i"], F.col("v"), F.expr("i div 25"), "total").collect()}
    sums, expected = {}, {}
    for k, i, v in rows:
        sums[k] = sums.get(k) if v is None else (sums.get(k) or 0) + v
        expected[i] = sums[k]
    assert got == expected
    plan = histories.running_sum(df, ["k"], ["i"], F.col("v"), F.expr("i div 25"), "total")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_block" in plan.split("hashpartitioning(k", 1)[1].split(")")[0]


def test_running_sum_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k string, i long, v long")
    assert histories.running_sum(empty, ["k"], ["i"], F.col("v"), F.expr("i div 25"), "total").collect() == []


def plain_replay(moves, events):
    legal, state, bad, first = {(a, e): b for a, e, b in moves}, None, 0, None
    for at, e in events:
        if (state, e) in legal:
            state = legal[state, e]
        else:
            bad, first = bad + 1, at if first is None else first
    return state, len(events), bad, first


def test_every_machine_replayed_in_blocks_is_as_step_by_step(spark):
    for name, moves in histories.MACHINES.items():
        draw = random.Random(name)
        known = [e for _, e, _ in moves] + ["nonsense", None]
        rows = [(draw.choice(["hot", "hot", "b", None]), i, draw.choice(known)) for i in range(240)]
        expected = {k: plain_replay(moves, [(i, e) for key, i, e in rows if key == k]) for k in ("hot", "b", None)}
        df = spark.createDataFrame(rows, "k string, i long, e string").repartition(5)
        for block in (F.expr("i div 30"), F.lit(0)):
            out = histories.replayed(df, ["k"], ["i"], "e", moves, block).collect()
            assert {r["k"]: (r["state"], r["events"], r["illegal"], r["first_illegal"] and r["first_illegal"]["i"]) for r in out} == expected


def test_a_first_step_that_nothing_allows(spark):
    df = spark.createDataFrame([("r", 1, "ANALYSIS_RUN_STARTED"), ("r", 2, "DEAL_SUBMITTED")], "k string, i long, e string")
    r = histories.replayed(df, ["k"], ["i"], "e", histories.RUN_MOVES, F.lit(0)).first()
    assert (r["state"], r["illegal"], r["first_illegal"]["i"]) == ("QUEUED", 1, 1)
    lone = histories.replayed(df.filter("i = 1"), ["k"], ["i"], "e", histories.RUN_MOVES, F.lit(0)).first()
    assert (lone["state"], lone["illegal"]) == (None, 1)


def test_queue_depth_is_what_waits_at_the_end_of_a_day(spark):
    rows = [("q", "2024-01-01", "2024-01-03"), ("q", "2024-01-01", None), ("q", "2024-01-02", "2024-01-02"), ("q", None, "2024-01-02"), (None, "2024-01-05", None)]
    df = spark.createDataFrame(rows, "k string, a string, b string").select("k", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    got = [(r["k"], str(r["day"]), r["entered"], r["left"], r["depth"], r["waited"]) for r in histories.queue_daily(df, ["k"], "a", "b").orderBy(F.desc("k"), "day").collect()]
    assert got == [
        ("q", "2024-01-01", 2, 0, 2, None), ("q", "2024-01-02", 1, 1, 2, 0.0), ("q", "2024-01-03", 0, 1, 1, 2.0), (None, "2024-01-05", 1, 0, 1, None),
    ]


def test_the_version_valid_at_a_time(spark):
    rules = spark.createDataFrame([("A", 10, "a1"), ("A", 20, "a2"), ("B", 15, "b1")], "code string, since int, rule string")
    rows = spark.createDataFrame([("A", 9), ("A", 10), ("A", 19), ("A", 20), ("A", 99), ("B", 14), ("C", 50), (None, 50)], "code string, at int")
    got = [(r["code"], r["at"], r["rule"]) for r in versions.as_of(rows, rules, ["code"], "at", "since").orderBy("code", "at").collect()]
    assert got == [(None, 50, None), ("A", 9, None), ("A", 10, "a1"), ("A", 19, "a1"), ("A", 20, "a2"), ("A", 99, "a2"), ("B", 14, None), ("C", 50, None)]


def test_nine_types_of_deltas(spark):
    pairs = [
        ("NOT_FIRED", "FIRED", 1, 1, "FLIPPED_TO_FIRED"), ("FIRED", "NOT_FIRED", 1, 1, "FLIPPED_TO_NOT_FIRED"), ("FIRED", "CONTESTED", 1, 1, "BECAME_CONTESTED"),
        ("NOT_FIRED", "CONTESTED", 1, 1, "BECAME_CONTESTED"), ("CONTESTED", "FIRED", 1, 1, "CONTEST_RESOLVED"), ("VETO_UNEVALUATED", "FIRED", 1, 1, "BECAME_EVALUABLE"),
        ("FIRED", "VETO_UNEVALUATED", 1, 1, "BECAME_UNEVALUABLE"), (None, "FIRED", 1, 1, "CRITERION_ADDED"), ("FIRED", None, 1, 1, "CRITERION_REMOVED"),
        ("FIRED", "FIRED", 1, 2, "EVIDENCE_STRENGTHENED"), ("FIRED", "FIRED", 1, 1, "UNCHANGED"), ("CONTESTED", "VETO_UNEVALUATED", 1, 2, "OTHER"),
    ]
    schema = "code int, state string, evidence array<int>"
    old = spark.createDataFrame([(i, p[0], [p[2]]) for i, p in enumerate(pairs) if p[0]], schema)
    new = spark.createDataFrame([(i, p[1], [p[3]]) for i, p in enumerate(pairs) if p[1]], schema)
    assert [r["delta"] for r in versions.finding_deltas(old, new, ["code"]).orderBy("code").collect()] == [p[4] for p in pairs]


def test_six_outcomes_of_questions(spark):
    cases = [
        (("D", "OPEN"), ("D", "RESOLVED"), "CLOSED"), (("D", "OPEN"), ("D", "OPEN"), "PERSISTED"), (None, ("D", "OPEN"), "OPENED"), (("D", "OPEN"), ("D", "DISMISSED"), "DISMISSED"),
        (("D", "OPEN"), ("EXTERNALLY_BLOCKED", "BLOCKED"), "BECAME_BLOCKED"), (("EXTERNALLY_BLOCKED", "BLOCKED"), ("D", "RESOLVED"), "BECAME_UNBLOCKED"),
        (("D", "OPEN"), None, "CLOSED"), (("EXTERNALLY_BLOCKED", "BLOCKED"), ("EXTERNALLY_BLOCKED", "BLOCKED"), "PERSISTED"),
    ]
    schema = "path int, kind string, status string"
    old = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases) if c[0]], schema)
    new = spark.createDataFrame([(i, *c[1]) for i, c in enumerate(cases) if c[1]], schema)
    assert [r["outcome"] for r in versions.question_deltas(old, new, ["path"]).orderBy("path").collect()] == [c[2] for c in cases]


def test_a_changed_rule_wins_over_evidence_and_nothing_is_hidden(spark):
    rows = [(0, "FLIPPED_TO_FIRED", True, True, False), (1, "FLIPPED_TO_FIRED", False, True, False), (2, "FLIPPED_TO_FIRED", None, None, True), (3, "BECAME_EVALUABLE", False, False, True)]
    df = spark.createDataFrame(rows, "i int, delta string, rule boolean, doc boolean, chk boolean")
    signs = {"rule_changed": F.col("rule"), "new_document": F.col("doc"), "check_changed": F.col("chk")}
    got = [(r["attribution"], r["attribution_confidence"]) for r in versions.attributed(df, signs).orderBy("i").collect()]
    assert got == [("CRITERIA_SET_CHANGE", "CERTAIN"), ("EVIDENCE_DOCUMENT", "CERTAIN"), ("UNATTRIBUTED", None), ("EXTERNAL_SOURCE_REACHABLE", "CERTAIN")]


def test_a_number_broken_over_pages_is_found_as_in_the_joined_text(spark):
    draw = random.Random(5)
    pages = [(d, p, draw.choice(["", None, " a b", "ab", "b\na", "aab ab", "IN/F 12"])) for d in range(6) for p in range(8)]
    values = [(d, i, "".join(draw.choice(["a", "B", " ", "/", "1"]) for _ in range(draw.randint(0, 7)))) for d in range(7) for i in range(25)] + [(0, 99, None), (1, 98, "in/f1 2")]
    joined = {d: "".join((t or "") for e, _, t in pages if e == d).replace(" ", "").replace("\n", "").upper() for d in range(7)}
    bare = lambda v: (v or "").replace(" ", "").upper()
    expected = {(d, i): bool(bare(v)) and bare(v) in joined[d] for d, i, v in values}
    found = registrations.present(
        spark.createDataFrame(values, "doc long, i long, v string"), spark.createDataFrame(pages, "doc long, page long, t string").repartition(3), "doc", "page", "t", "v", 8
    )
    assert {(r["doc"], r["i"]): r["present"] for r in found.collect()} == expected
    kept = {(r["doc"], r["i"]): (r["v"], r["discarded"]) for r in registrations.backstop(found, "v").collect()}
    assert kept[0, 99] == (None, None) and all((v is None) != (x is None) for k, (v, x) in kept.items() if k != (0, 99))
