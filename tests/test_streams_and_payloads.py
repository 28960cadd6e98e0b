"""Projections as a stream, and payloads against the registry of event types."""

import json
import os

from pyspark.sql import functions as F

from verisift.operators import events, payloads
from verisift.streaming import jobs

EVENT = "id string, seq long, kind string, name string, size long"
KINDS = ("created", "changed")


def event(id_, seq, kind="changed", name=None, size=None):
    return {"id": id_, "seq": seq, "kind": kind, "name": name, "size": size}


def test_a_projection_as_a_stream_equals_the_fold(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()
    files = [
        [event("a", 1, "created", "first", 1), event("b", 2, "created", "b"), event("a", 3, "surprise", "never", 99)],
        [event("a", 5, size=5), event("c", 6, "other", "c"), event("a", 2, name="late, and older than none", size=2)],
        [event("b", 9, size=7), event("a", 4, name="fourth", size=4), event("b", 8, name="eighth", size=8), event("d", 1)],
    ]

    def put(i):
        (source / f"{i}.json").write_text("\n".join(map(json.dumps, files[i])))
        os.utime(source / f"{i}.json", (1_000_000 + i, 1_000_000 + i))

    def drain():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(source))
        updates = jobs.projection_updates(stream, ["id"], ["seq"], ["name", "size"], "kind", KINDS)
        query = updates.writeStream.outputMode("update").foreachBatch(jobs.upserts(out)).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(180)

    put(0)
    put(1)
    drain()
    put(2)
    drain()  # goes on from its state
    batch = events.latest_known(spark.read.schema(EVENT).json(str(source)).filter(F.col("kind").isin(*KINDS)), ["id"], ["seq"], ["name", "size"])
    expected = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, jobs.projection(spark, out, ["id"]).select(batch.columns).collect())) == expected
    assert ("a", "fourth", 5) in expected and ("b", "eighth", 7) in expected and {r[0] for r in expected} == {"a", "b", "d"}
    again = spark.read.parquet(f"{out}/batch=1")
    rows = [tuple(r) for r in again.collect()]
    jobs.upserts(out)(spark.createDataFrame(rows, again.schema), 1)  # delivered again
    assert sorted(map(tuple, jobs.projection(spark, out, ["id"]).select(batch.columns).collect())) == expected
    jobs.compacted(spark, out, ["id"], f"{tmp_path}/small")
    assert sorted(map(tuple, jobs.projection(spark, f"{tmp_path}/small", ["id"]).select(batch.columns).collect())) == expected


def test_payloads_against_two_versions(spark):
    rules = [("made", 1, "n", "integer", True), ("made", 2, "n", "number", True), ("made", 2, "who.name", "text", True), ("made", 2, "tags[]", "text", False), ("made", 2, "field.value", "text", False)]
    registry = spark.createDataFrame(rules, "event_type string, event_version int, path string, type string, required boolean")
    rows = [
        (1, "made", 1, '{"n": 3}'), (2, "made", 1, '{"n": 3.5}'), (3, "made", 2, '{"n": 3.5, "who": {"name": "x"}, "tags": ["a", "b"]}'),
        (4, "made", 2, '{"n": 3, "who": {"name": null}, "tags": ["a", 1]}'), (5, "made", 3, '{"n": 3}'), (6, "lost", 1, "{}"), (7, "made", 1, "{n"), (8, "made", 1, None),
        (9, "made", 1, '{"n": 1, "more": true}'), (10, "made", 2, '{"n": 2, "who": {"name": "y"}, "field": {"value": "v", "page": 1}}'), (11, None, None, "{}"),
    ]
    df = spark.createDataFrame(rows, "event_id long, event_type string, event_version int, payload string")
    found = {tuple(r) for r in payloads.violations(df, registry).collect()}
    assert found == {
        (2, "type", "n"), (4, "missing", "who.name"), (4, "type", "tags[]"), (5, "type_unknown", None), (6, "type_unknown", None), (7, "payload_invalid", None),
        (8, "payload_invalid", None), (9, "unexpected", "more"), (10, "unexpected", "field.page"), (11, "type_unknown", None),
    }
    kept, rejected = payloads.divided(df, registry)
    assert {r.event_id for r in kept.collect()} == {1, 3} and rejected.count() == 9
    assert {(v.gate, v.path) for v in rejected.filter("event_id = 4").first().violations} == {("missing", "who.name"), ("type", "tags[]")}
    assert payloads.violations(df.filter("false"), registry).count() == 0
