"""Manifests, rules evaluated anew, and names within names, on small tables."""

import random

from pyspark.sql import functions as F

from verisift.operators import criteria, manifest, matching


def test_the_same_files_add_nothing_and_versions_carry_forward(spark):
    files = manifest.files(spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y"), ("d", None), ("e", "")], "path string, content string"))
    empty = spark.createDataFrame([], manifest.SCHEMA)
    first = manifest.additions(empty, files, 1)
    assert sorted((r["name"], r["bytes"], r["version"]) for r in first.collect()) == [("a", 1, 1), ("c", 1, 1), ("e", 0, 1)]
    assert manifest.additions(first, files, 2).collect() == []
    more = manifest.files(spark.createDataFrame([("c", "z"), ("f", "y")], "path string, content string"))
    both = first.unionByName(manifest.additions(first, more, 2))
    assert manifest.bundle(both, 1).count() == 3 and manifest.bundle(both, 2).count() == 4
    assert [r["name"] for r in manifest.changed(first, more).collect()] == ["c"]


def test_only_changed_rules_are_evaluated_and_all_is_as_in_a_full_run(spark):
    before = spark.createDataFrame([("A", 1, None), ("B", 2, "x"), ("C", 3, "x")], "code string, floor int, note string")
    after = spark.createDataFrame([("x", 1, "A"), ("x", 5, "B"), ("x", 4, "D"), (None, 9, "E")], "note string, floor int, code string").select("floor", "code", "note")
    seen = []

    def evaluate(rules):
        seen.append(sorted(r["code"] for r in rules.collect()))
        return rules.crossJoin(spark.range(6)).select("code", "id", (F.col("id") > F.col("floor")).alias("fired"))

    same = after.withColumn("note", F.when(F.col("code") != "A", F.col("note")))
    out = criteria.reevaluated(evaluate(before), before, same, "code", evaluate)
    assert seen[1] == ["B", "D", "E"]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, evaluate(same).collect()))
    one = spark.createDataFrame([(3,), (None,)], "v int")
    assert [r[0] for r in one.select(criteria.set_status(F.col("v"))).collect()] == ["ACTIVE", "DRAFT"]


def test_contained_names_are_those_of_all_pairs(spark):
    draw = random.Random(11)
    word = lambda n: "".join(draw.choice("AB ") for _ in range(draw.randint(0, n)))
    names, texts = [word(9) for _ in range(80)] + [None], [word(30) for _ in range(60)] + [None, "", "AB"]
    found = matching.contained(spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(t,) for t in texts], "t string"), "n", "t")
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted({(n, t) for n in names if n for t in texts if t and n in t})


def test_a_roster_over_two_hops(spark):
    filings = spark.createDataFrame([("F", "Blue Lake Fund II, LLC"), ("F", None), ("G", "LP Partners")], "firm string, fund string")
    held = spark.createDataFrame([("i", "The BLUE-LAKE fund ii Capital LP"), ("j", "Blue Lake"), ("k", None)], "investor string, fund string")
    assert [tuple(r) for r in matching.roster(filings, held).collect()] == [("F", "i")]


def test_one_names_firms_and_investors_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(matching, "ROWS", 100)
    held = spark.createDataFrame([(i, "LAKE" if i < 400 else f"POND {i}") for i in range(500)], "investor int, _held string")
    links = spark.createDataFrame([(f"F{i}", "LAKE") for i in range(20)] + [("F1", "POND 450")], "firm string, _held string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    made = matching.dealt(held, links)
    assert sorted(map(tuple, made.collect())) == sorted([(f"F{f}", i) for f in range(20) for i in range(400)] + [("F1", 450)])
    assert made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert matching.dealt(held, links.filter("false")).count() == 0
