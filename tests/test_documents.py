"""Documents of any depth, canonical text, envelopes, and publishing only what is valid."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from verisift.operators import documents, gates, publish


def leaf(value, page=1, quote="q"):
    return {"value": value, "page": page, "quote": quote}


def plain_fields(node, path=""):
    if isinstance(node, dict):
        if "value" in node and ("page" in node or "quote" in node):
            yield path, node
            return
        for k, v in node.items():
            yield from plain_fields(v, f"{path}.{k}" if path else k)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from plain_fields(v, f"{path}[{i}]")


DEEP = leaf("deep", 3)
for level in range(12):
    DEEP = {f"k{level}": [1, DEEP, {"note": "{[\"}"}] if level % 2 else {"in": DEEP}}
TREES = [
    {"fund": {"size": leaf("5"), "name": leaf("x", 0), "none": leaf(None, None, None), "bare": {"value": 3}}, "list": [leaf("a", 2, " "), [leaf("b", "2"), leaf("c", 2.5)], []]},
    DEEP,
    {},
    [leaf(7), {"x": None, "y": {"value": {"z": 1}, "quote": "obj", "page": 4}}],
    leaf("top"),
    "text",
    None,
]


def test_fields_at_any_depth(spark):
    rows = [(i, json.dumps(t)) for i, t in enumerate(TREES)] + [(50, "{broken"), (51, None), (52, "")]
    found = documents.fields(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()
    expected = {(i, p): n for i, t in enumerate(TREES) for p, n in plain_fields(t)}
    assert {(r.id, r.path) for r in found} == set(expected) and len(found) == len(expected)
    for r in found:
        n = expected[r.id, r.path]
        page_ok = isinstance(n.get("page"), int) and n["page"] >= 1
        ok = page_ok and bool((n.get("quote") or "").strip())
        assert (r.cited, r.unsupported) == ((n["value"] is not None) and ok, (n["value"] is not None) and not ok), (r, n)
    assert documents.fields(spark.createDataFrame([], "id int, text string"), "id", "text").count() == 0


def test_nodes_have_all_scalars(spark):
    text = json.dumps({"a": [1, {"b": None}], "c": {}, "d": "x"})
    found = documents.nodes(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    assert {r.path for r in found.collect()} == {"a[0]", "a[1].b", "c", "d"}


def test_canonical_json_and_hash(spark):
    def turned(node):
        return {k: turned(node[k]) for k in reversed(node)} if isinstance(node, dict) else [turned(x) for x in node] if isinstance(node, list) else node

    rows = [(i, json.dumps(t), json.dumps(turned(t), indent=3)) for i, t in enumerate(TREES)]
    df = spark.createDataFrame(rows, "id int, a string, b string").select("id", *[documents.canonical_json(F.col(c)).alias(c) for c in "ab"], documents.content_hash(F.col("a")).alias("h"))
    for r in df.collect():
        assert r.a == r.b and json.loads(r.a) == TREES[r.id] and len(r.h) == 64
        assert r.a == json.dumps(TREES[r.id], sort_keys=True, separators=(",", ":"))
    assert spark.range(1).select(documents.canonical_json(F.lit("{no"))).first()[0] is None


def test_facts_and_absences(spark):
    doc = {"fund_terms": {"fund_size": {"value": 100, "as_written": "INR 100"}, "fund_term": leaf("7 years")}, "economics": {"net_return_disclosed": leaf("No"), "gp_commitment": leaf("2%"), "carry": leaf(None)}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, None)], "id int, text string")
    assert {tuple(r) for r in documents.index_facts(df, "id", "text").collect()} == {(1, "Target size", "INR 100"), (1, "Fund term", "7 years")}
    said = {(r.id, r.label): r.stated for r in documents.index_absences(df, "id", "text").collect()}
    assert said[1, "Net return disclosed"] == "NO" and said[1, "GP / sponsor commitment"] == "2%" and said[1, "Valuation policy"] == "NOT DISCLOSED"
    assert len(said) == 10 and all(v == "NOT DISCLOSED" for (i, _), v in said.items() if i == 2)


def test_a_text_is_parsed_once_however_much_is_asked_of_it(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": leaf("x")}))], "id int, text string").repartition(1)
    for made in (documents.index_absences, documents.index_facts):
        times = [made(df, "id", "text", spec)._jdf.queryExecution().optimizedPlan().toString().count("parse_json") for spec in ((("A", "a"),), documents.ABSENCES)]
        assert times[0] == times[1] <= 3


GOOD = {"stage": "memo", "schema_version": 2, "result": {"ok": True}, "unresolved": [], "citations": []}
BAD = {
    "not_an_object": [1],
    "other_stage": GOOD | {"stage": "scoring"},
    "other_version": GOOD | {"schema_version": 1},
    "result_missing": {k: v for k, v in GOOD.items() if k != "result"},
    "result_null": GOOD | {"result": None},
    "unresolved_missing": {k: v for k, v in GOOD.items() if k != "unresolved"},
    "unresolved_no_list": GOOD | {"unresolved": {}},
    "citations_no_list": GOOD | {"citations": "none"},
}


def envelopes(spark, docs):
    return spark.createDataFrame([(str(k), json.dumps(d)) for k, d in docs.items()], "id string, text string")


def test_envelope_gates(spark):
    rules = documents.envelope_gates(F.col("text"), F.lit("memo"))
    df = envelopes(spark, BAD | {"good": GOOD, "no_citations": {k: v for k, v in GOOD.items() if k != "citations"}})
    assert {tuple(r) for r in gates.violations(df, "id", rules).collect()} == {(k, k) for k in BAD}
    broken = spark.createDataFrame([("x", "{no"), ("y", None), ("z", json.dumps(GOOD) + " and more"), ("w", json.dumps(GOOD) + "],[1")], "id string, text string")
    assert {tuple(r) for r in gates.violations(broken, "id", rules).collect()} == {("not_an_object", x) for x in "xyzw"}


def test_one_broken_row_publishes_nothing(spark, tmp_path):
    rules, place = documents.envelope_gates(F.col("text"), F.lit("memo")), f"{tmp_path}/out"
    many = {i: GOOD for i in range(50)}
    with pytest.raises(publish.Rejected) as told:
        publish.publish(envelopes(spark, many | {"x": BAD["result_null"], "y": BAD["result_null"]}).repartition(5), rules, place)
    assert told.value.counts == {"result_null": 2} and os.listdir(tmp_path) == []
    assert publish.publish(envelopes(spark, many).repartition(5), rules, place) == 50
    assert spark.read.parquet(place).count() == 50 and [x for x in os.listdir(tmp_path) if not x.startswith(".")] == ["out"]
    with pytest.raises(FileExistsError):
        publish.publish(envelopes(spark, many), rules, place)
    assert publish.publish(envelopes(spark, many).filter("false"), rules, f"{tmp_path}/empty") == 0


def test_a_repeated_batch_publishes_once(spark, tmp_path):
    rules = documents.envelope_gates(F.col("text"), F.lit("memo"))
    run = publish.publish_batches(rules, f"{tmp_path}/out", f"{tmp_path}/rejected")
    run(envelopes(spark, {1: GOOD}), 0)
    run(envelopes(spark, {1: GOOD, 2: GOOD}), 0)
    run(envelopes(spark, {3: GOOD, 4: BAD["other_stage"]}), 1)
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["1"]
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/rejected").collect()) == ["3", "4"]
    with pytest.raises(publish.Rejected):
        publish.publish_batches(rules, f"{tmp_path}/out")(envelopes(spark, {4: BAD["other_stage"]}), 2)


def test_a_stream_publishes_its_valid_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, docs in enumerate(({1: GOOD, 2: GOOD}, {3: BAD["other_version"]}, {4: GOOD})):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"id": str(k), "text": json.dumps(d)}) for k, d in docs.items()))
        os.utime(source / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    rules = documents.envelope_gates(F.col("text"), F.lit("memo"))
    stream = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", 1).json(str(source))
    query = stream.writeStream.foreachBatch(publish.publish_batches(rules, f"{tmp_path}/out", f"{tmp_path}/rejected")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1", "2", "4"]


def test_artifacts_are_read_whole_or_not(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOOD))
    assert publish.artifacts(spark, str(tmp_path), "memo").count() == 1 == len(publish.artifacts(spark, str(tmp_path), "memo").collect())
    (tmp_path / "b.json").write_text(json.dumps(BAD["unresolved_missing"]))
    with pytest.raises(PySparkException, match="b.json: unresolved_missing"):
        publish.artifacts(spark, str(tmp_path), "memo").collect()
