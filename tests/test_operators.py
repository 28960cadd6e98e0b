"""Operators on inline rows: the cases that the test tables don't hold."""

import json

from pyspark.sql import functions as F

from verisift.functions import dates, numbers, text
from verisift.operators import events, gates, reconcile, verify
from verisift.sources import tables
from verisift.streaming import jobs

READING = "code string, fired boolean, evaluable boolean, confidence string"


def found(spark, lenient, strict, tier="VETO"):
    criteria = spark.createDataFrame([("a", tier, "HIGH", 1.0)], "code string, tier string, severity string, weight double")
    l, s = (spark.createDataFrame(r, READING) for r in (lenient, strict))
    row = reconcile.reconcile(criteria, l, s, ["code"]).first()
    return row["fired"], row["status"], row["contested"], row["confidence"]


def test_reconcile_covers_every_branch(spark):
    yes, no, unread = ("a", True, True, "high"), ("a", False, True, "medium"), ("a", None, False, "high")
    assert found(spark, [], []) == (None, "veto_unevaluated", False, "low")
    assert found(spark, [yes], [], "RED_FLAG") == (True, "fired", True, "low")
    assert found(spark, [], [no]) == (False, "not_fired", True, "low")
    assert found(spark, [yes], [unread], "RED_FLAG") == (None, "unevaluated", False, "low")
    assert found(spark, [yes], [yes]) == (True, "fired", False, "high")
    assert found(spark, [no], [("a", False, True, "odd")]) == (False, "not_fired", False, "medium")
    assert found(spark, [yes], [no]) == (False, "contested", True, "low")
    assert found(spark, [("b", True, True, "high")], []) == (None, "veto_unevaluated", False, "low")


def test_recommendation_order(spark):
    def advice(rows):
        schema = "g int, tier string, severity string, weight double, fired boolean, contested boolean, confidence string"
        return reconcile.recommend(spark.createDataFrame([(1, *r) for r in rows], schema), ["g"]).first()["recommendation"]

    veto, red, green = "VETO", "RED_FLAG", "GREEN_FLAG"
    assert advice([(veto, "LOW", 1.0, True, False, "high"), (red, "CRITICAL", 9.0, True, False, "high")]) == "pass"
    assert advice([(veto, "LOW", 1.0, True, True, "low")]) == "hold"
    assert advice([(red, "HIGH", 3.0, True, False, "high")]) == "hold"
    assert advice([(red, "HIGH", 3.0, True, False, "high"), (green, "CRITICAL", 1.0, True, False, "high")]) == "pursue_with_questions"
    assert advice([(red, "HIGH", 3.0, None, False, "low"), (green, "LOW", 1.0, True, False, "high")]) == "pursue"


def test_quote_tiers(spark):
    page = "Total team size\nof the firm (see chart) counts 33 members across two cities"
    rows = [
        ("Total  team size", "exact"),
        ("total team size counts 33 members", "layout"),
        ("size counts 33", "unverified"),
        ("members counts 33 total team size", "unverified"),
        ("", "unverified"),
    ]
    df = spark.createDataFrame([(1, 1, q) for q, _ in rows] + [(1, 9, "x")], "doc int, page int, quote string")
    pages = spark.createDataFrame([(1, 1, page)], "doc int, page int, text string")
    out = {(r["page"], r["quote"]): r["verification"] for r in verify.verify_cited(df, pages, "doc", "page", "quote", "text").collect()}
    assert out == {**{(1, q): t for q, t in rows}, (9, "x"): "out_of_range"}


def test_quote_search_is_complete(spark):
    pages = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "c d e f"), (3, None), (4, "")], "page_id int, text string")
    quotes = spark.createDataFrame([(1, "B c d e f g"), (2, "x c d e f g")], "quote_id int, quote string")
    assert [tuple(r) for r in verify.search_quotes(quotes, pages).collect()] == [(1, 1, "exact")]


def test_quote_search_against_brute_force(spark):
    words = [f"{w}{i}" for i, w in enumerate("alpha bravo charlie delta echo foxtrot golf hotel india juliet".split())]
    pages = [(i, " ".join([*words[:i], *"other text stands here".split(), *words[i:]])) for i in range(11)]
    pages += [(20 + i, " ".join(words[:i] + [f"({words[i]}x", "x"] + words[i + 1 :])) for i in range(10)] + [(40, "a b c d e f g"), (41, None), (42, "été à la"), (43, "unlike")]
    quotes = [(1, " ".join(words)), (2, " ".join(words[:6])), (3, "bravo1 charlie2"), (4, "a c d e f g"), (5, "été à"), (6, "b c"), (7, ""), (8, " ".join(words[:3] + words[6:])), (9, None)]
    p, q = spark.createDataFrame(pages, "page_id int, text string"), spark.createDataFrame(quotes, "quote_id int, quote string")
    found = verify.tier(F.col("q"), F.col("p"))
    every = q.select("quote_id", text.canonical(F.col("quote")).alias("q")).crossJoin(p.select("page_id", text.canonical(F.col("text")).alias("p")))
    expected = {tuple(r) for r in every.select("quote_id", "page_id", found).collect() if r[2] != "unverified"}
    got = [tuple(r) for r in verify.search_quotes(q, p).collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert {(1, i, "layout") for i in range(1, 10)} <= expected and {r[0] for r in expected} == {1, 2, 3, 4, 5, 6, 8}


def test_quote_search_reads_each_page_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pages = spark.range(60).selectExpr("id AS page_id", "concat('opening phrase number ', id, ' and a closing phrase') AS text")
    quotes = spark.createDataFrame([(1, "opening phrase number 7 and a closing"), (2, "phrase of nobody")], "quote_id int, quote string")
    got = verify.search_quotes(quotes, pages.mapInArrow(counted, "page_id long, text string")).collect()
    assert {tuple(r) for r in got} == {(1, 7, "exact"), *[(1, i, "layout") for i in (17, 27, 37, 47, 57)]}
    assert read.value == 60


def test_quote_search_by_pages_and_by_words(spark, monkeypatch):
    """Probes across page ends and stretches, of other scripts, and of quotes that no or every page must meet."""
    words = ["ångström", "überfluß", "naïveté", "русский", "漢字仮名交じり文", "plainword", "another"]
    pages = [(i, " ".join(words[i % 7 :] + words[: i % 7]) * (1 + i % 3)) for i in range(40)]
    pages += [(50, "ends with plain"), (51, "word begins"), (52, None), (53, ""), (54, "x" * 300 + "plainword"), (None, "plainword another")]
    quotes = [(i, " ".join(words[i : i + n])) for i in range(7) for n in (1, 2)] + [(20, "plainw"), (21, "x"), (22, "nowhere"), (23, None), (None, "another"), (24, "русский漢")]
    p, q = spark.createDataFrame(pages, "page_id int, text string"), spark.createDataFrame(quotes, "quote_id int, quote string")
    monkeypatch.setattr(verify, "STRETCH", 50)
    by_pages = sorted(tuple(r) for r in verify.search_quotes(q, p).collect())
    monkeypatch.setattr(verify, "BROADCAST_PROBES", 0)
    assert by_pages == sorted(tuple(r) for r in verify.search_quotes(q, p).collect())
    assert {(20, 54, "exact"), (21, 54, "exact")} <= set(by_pages) and not {22, 23, None} & {r[0] for r in by_pages}
    assert len(by_pages) > 300 and not [r for r in by_pages if r[0] == 20 and r[1] in (50, 51)]


def test_canonical_forms(spark):
    df = spark.createDataFrame([("“Ｆull”—width ﬁ •  x",)], "t string").select(text.canonical(F.col("t"), compose=True))
    assert df.first()[0] == '"full"-width fi x'
    df = spark.createDataFrame([("5,000",), ("2.00",), ("007",), ("0.50",), ("10",)], "n string")
    assert [r[0] for r in df.select(numbers.canonical_number(F.col("n"))).collect()] == ["5000", "2", "7", "0.5", "10"]
    df = spark.createDataFrame([("Feb 3, 2026",), ("February 2026",), ("03/02/2026",), ("2026",), ("soon",), (None,)], "d string")
    assert [str(r[0]) for r in df.select(dates.stated_date(F.col("d"))).collect()] == ["2026-02-03", "2026-02-01", "2026-02-03", "2026-01-01", "None", "None"]
    df = spark.createDataFrame([("12 M.G. Rd, Fl 2", "12 m g road floor 2")], "a string, b string")
    assert df.select(text.token_overlap(text.address(F.col("a")), F.col("b"))).first()[0] == 1.0
    df = spark.createDataFrame([("Acme & Co. Pvt Ltd",), ("Private Limited",)], "n string")
    assert [r[0] for r in df.select(text.company_slug(F.col("n"))).collect()] == ["ACME-CO", "PRIVATE-LIMITED"]


def test_untraceable_numbers(spark):
    memo = spark.createDataFrame([(1, "## 3. Facts\n5,000 and 2.00, 77, p. 912, 12345 and 12345")], "id int, t string")
    corpus = spark.createDataFrame([("5000 is stated; 2 too",)], "t string")
    out = gates.untraceable_numbers(memo, corpus.withColumn("id", F.lit(0)), "id", "t").collect()
    assert [tuple(r) for r in out] == [(1, "12345")]


def test_delta_and_fold(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "k string, s string")
    new = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "x")], "k string, s string")
    out = {r["k"]: r["change"] for r in events.delta(old, new, "k", "s").collect()}
    assert out == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    log = spark.createDataFrame([(1, 1, "p", None), (1, 2, None, 5), (1, 3, None, None)], "id int, at int, name string, n int")
    assert tuple(events.latest_known(log, ["id"], ["at"], ["name", "n"]).first()) == (1, "p", 5)


def test_files(spark, tmp_path):
    for n in (2, 1000, 999):
        (tmp_path / f"page-{n}.txt").write_text(f"text {n}\nmore")
    assert sorted(r["page_no"] for r in tables.page_files(spark, str(tmp_path)).collect()) == [2, 999, 1000]
    pdf = tmp_path / "pdf"
    pdf.mkdir()
    (pdf / "a.pdf").write_bytes(b"%PDF-1.7 ...")
    (pdf / "b.pdf").write_bytes(b"hello")
    (pdf / "c.pdf").write_bytes(b"")
    assert {r["path"][-5:]: r["readable"] for r in tables.readable_pdfs(spark, str(pdf)).collect()} == {"a.pdf": True, "b.pdf": False}


def run_to_table(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}"))
    q.trigger(availableNow=True).start().awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = lambda run, ts, stage, event: json.dumps({"run_id": run, "ts": ts, "stage": stage, "event": event, "cost_usd": 1.0})
    day = "2026-01-0{}T10:00:00Z".format
    (log / "1.json").write_text(
        "\n".join([line("r", day(1), "extraction", "stage_completed"), line("r", day(1), "classification", "stage_progress"), '{"run_id": "r", "ts'])
    )
    (log / "2.json").write_text(
        "\n".join([line("r", day(1), "classification", "stage_completed"), line("r", day(1), "classification", "stage_completed"), line("q", day(5), "memo", "stage_completed")])
    )
    stream = lambda: jobs.without_progress(jobs.status_stream(spark, str(log), 1))
    ordered = run_to_table(jobs.in_stage_order(stream()), "ordered", tmp_path)
    assert [tuple(r) for r in ordered] == [("r", 0, "classification"), ("r", 1, "extraction")]
    once = run_to_table(jobs.idempotent(stream(), ["run_id", "stage"]), "once", tmp_path)
    assert sorted((r["run_id"], r["stage"]) for r in once) == [("q", "memo"), ("r", "classification"), ("r", "extraction")]
    days = run_to_table(jobs.daily(stream()), "days", tmp_path)
    assert sorted((r["stage"], r["n"]) for r in days) == [("classification", 2), ("extraction", 1)]
