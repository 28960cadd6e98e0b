"""Queries of histories, versions, registrations and whole findings over the test tables, each beside its SQL.

As in registry.py, rows of the test tables stand for events, runs, findings and pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verisift.jobs import oracles
from verisift.operators import criteria, events, histories, manifest, matching, memo_files, registrations, scoring, versions
from verisift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def kept(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return kept


#: Events of a run, by the priority of the order that stands for one.
RUN_EVENTS = {
    "1-URGENT": "DEAL_SUBMITTED", "2-HIGH": "ANALYSIS_RUN_STARTED", "3-MEDIUM": "ANALYSIS_RUN_FAILED",
    "4-NOT SPECIFIED": "L1_MEMO_GENERATED", "5-LOW": "ANALYSIS_RUN_CANCELLED",
}
_EVENT = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RUN_EVENTS.items()) + " END"
_MOVES = ", ".join(f"({'NULL' if a is None else repr(a)}, '{e}', '{b}')" for a, e, b in histories.RUN_MOVES)


@query(f"""WITH RECURSIVE m AS (SELECT * FROM (VALUES {_MOVES}) t(a, e, b)),
    h AS (SELECT o_custkey, o_orderkey, {_EVENT} AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    r AS (SELECT o_custkey, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS state, CAST(0 AS BIGINT) AS illegal, CAST(NULL AS BIGINT) AS first_illegal FROM h WHERE i = 1
        UNION ALL SELECT r.o_custkey, h.i, coalesce(m.b, r.state), r.illegal + CASE WHEN m.b IS NULL THEN 1 ELSE 0 END,
            coalesce(r.first_illegal, CASE WHEN m.b IS NULL THEN h.o_orderkey END)
        FROM r JOIN h ON h.o_custkey = r.o_custkey AND h.i = r.i + 1 LEFT JOIN m ON m.e = h.e AND m.a IS NOT DISTINCT FROM r.state)
    SELECT o_custkey, arg_max(coalesce(state, ''), i) AS state, max(i) AS events, max(illegal) AS illegal, max(first_illegal) AS first_illegal FROM r GROUP BY o_custkey""")
def run_histories(spark, d):
    """A customer's orders as the events of one run, replayed under the legal moves; years are blocks."""
    event = F.element_at(F.create_map(*[F.lit(x) for kv in RUN_EVENTS.items() for x in kv]), F.col("o_orderpriority"))
    log = table(spark, d, "orders").withColumn("event", event)
    done = histories.replayed(log, ["o_custkey"], ["o_orderdate", "o_orderkey"], "event", histories.RUN_MOVES, F.year("o_orderdate"))
    return done.select("o_custkey", F.coalesce("state", F.lit("")).alias("state"), "events", "illegal", F.col("first_illegal.o_orderkey").alias("first_illegal"))


@query("""WITH s AS (SELECT l_orderkey, min(l_shipdate) AS t FROM lineitem GROUP BY l_orderkey),
    q AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS a, CAST(t AS DATE) AS b FROM orders LEFT JOIN s ON o_orderkey = l_orderkey),
    e AS (SELECT o_orderpriority, a AS day, 1 AS n, NULL AS waited FROM q UNION ALL SELECT o_orderpriority, b, -1, b - a FROM q WHERE b IS NOT NULL),
    g AS (SELECT o_orderpriority, day, count(*) FILTER (n > 0) AS entered, count(*) FILTER (n < 0) AS "left", sum(n) AS net, round(avg(waited), 6) AS waited FROM e GROUP BY ALL)
    SELECT o_orderpriority, CAST(day AS VARCHAR) AS day, entered, "left", CAST(sum(net) OVER (PARTITION BY o_orderpriority ORDER BY day) AS BIGINT) AS depth, waited FROM g""")
def queue_depth(spark, d):
    """Orders as runs that wait from their date to their first shipment, by priority and day."""
    started = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("started"))
    runs = table(spark, d, "orders").join(started, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    daily = histories.queue_daily(runs, ["o_orderpriority"], "o_orderdate", "started")
    return daily.select("o_orderpriority", F.col("day").cast("string").alias("day"), "entered", "left", "depth", F.round("waited", 6).alias("waited"))


#: States of a finding by the event that it was last seen in, and the two runs' times.
STATES = {"signup": "NOT_FIRED", "view": "CONTESTED", "purchase": "FIRED", "error": "VETO_UNEVALUATED", "click": "FIRED"}
FIRST, SECOND = "2024-01-16 00:00:00", "2024-02-01 00:00:00"
_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"
_VERSIONS = f"""x AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 20 AS code FROM events),
    v1 AS (SELECT user_id, code, last({_STATE} ORDER BY ts, event_id) AS state, last(event_id ORDER BY ts, event_id) AS ev FROM x WHERE ts < '{FIRST}' GROUP BY ALL),
    v2 AS (SELECT user_id, code, last({_STATE} ORDER BY ts, event_id) AS state, last(event_id ORDER BY ts, event_id) AS ev, last(value ORDER BY ts, event_id) AS value
        FROM x WHERE ts >= '2024-01-08' GROUP BY ALL),
    d AS (SELECT coalesce(v1.user_id, v2.user_id) AS user_id, coalesce(v1.code, v2.code) AS code, coalesce(v1.state, 'ABSENT') AS old_state, coalesce(v2.state, 'ABSENT') AS new_state,
        v1.ev AS old_ev, v2.ev AS new_ev, value FROM v1 FULL JOIN v2 ON v1.user_id = v2.user_id AND v1.code = v2.code),
    t AS (SELECT *, CASE WHEN old_state = 'ABSENT' THEN 'CRITERION_ADDED' WHEN new_state = 'ABSENT' THEN 'CRITERION_REMOVED'
        WHEN old_state = 'NOT_FIRED' AND new_state = 'FIRED' THEN 'FLIPPED_TO_FIRED' WHEN old_state = 'FIRED' AND new_state = 'NOT_FIRED' THEN 'FLIPPED_TO_NOT_FIRED'
        WHEN old_state IN ('FIRED', 'NOT_FIRED') AND new_state = 'CONTESTED' THEN 'BECAME_CONTESTED' WHEN old_state = 'CONTESTED' AND new_state IN ('FIRED', 'NOT_FIRED') THEN 'CONTEST_RESOLVED'
        WHEN old_state = 'VETO_UNEVALUATED' AND new_state IN ('FIRED', 'NOT_FIRED') THEN 'BECAME_EVALUABLE' WHEN old_state IN ('FIRED', 'NOT_FIRED') AND new_state = 'VETO_UNEVALUATED' THEN 'BECAME_UNEVALUABLE'
        WHEN old_state = new_state AND old_ev <> new_ev THEN 'EVIDENCE_STRENGTHENED' WHEN old_state = new_state THEN 'UNCHANGED' ELSE 'OTHER' END AS delta FROM d)"""


def _deltas(spark, d):
    """Findings by user and code at two times, the second without the first week; evidence is the last event."""
    code = F.get_json_object("props", "$.k").cast("int") % 20
    seen = table(spark, d, "events").select(
        "user_id", code.alias("code"), "ts", "event_id", "value",
        F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col("event_type")).alias("state"),
    )
    last = lambda when: events.first_by(seen.filter(when), ["user_id", "code"], ["ts", "event_id"], last=True).withColumn("evidence", F.array("event_id"))
    new = last("ts >= '2024-01-08'")
    found = versions.finding_deltas(last(F.col("ts") < FIRST), new, ["user_id", "code"])
    return found.join(new.select("user_id", "code", "value"), ["user_id", "code"], "left")


@query(f"WITH {_VERSIONS} SELECT user_id, code, old_state, new_state, delta FROM t")
def finding_deltas(spark, d):
    return _deltas(spark, d).select("user_id", "code", "old_state", "new_state", "delta")


@query(f"""WITH {_VERSIONS}, r AS (SELECT code, ts AS since, min(event_id) AS rule FROM x WHERE event_type = 'click' AND value > 150 AND user_id % 5 = 0 GROUP BY code, ts),
    o AS (SELECT t.*, CAST('{FIRST}' AS TIMESTAMP) AS t1, CAST('{SECOND}' AS TIMESTAMP) AS t2 FROM t),
    a AS (SELECT o.*, r.rule AS r1 FROM o ASOF LEFT JOIN r ON o.code = r.code AND o.t1 >= r.since),
    b AS (SELECT a.*, r.rule AS r2 FROM a ASOF LEFT JOIN r ON a.code = r.code AND a.t2 >= r.since),
    c AS (SELECT *, CASE WHEN r1 IS DISTINCT FROM r2 THEN 1 WHEN old_ev IS DISTINCT FROM new_ev AND value > 100 THEN 2 WHEN old_ev IS DISTINCT FROM new_ev AND value < 20 THEN 3
        WHEN new_ev % 2 = 0 AND delta IN ('BECAME_EVALUABLE', 'BECAME_UNEVALUABLE') THEN 4 WHEN user_id % 2 = 0 THEN 7 ELSE 8 END AS i FROM b WHERE delta <> 'UNCHANGED')
    SELECT user_id, code, delta, CASE i WHEN 1 THEN 'CRITERIA_SET_CHANGE' WHEN 2 THEN 'EVIDENCE_DOCUMENT' WHEN 3 THEN 'EVIDENCE_ATTESTATION' WHEN 4 THEN 'EXTERNAL_SOURCE_REACHABLE'
        WHEN 7 THEN 'ENGINE_VERSION_CHANGE' ELSE 'UNATTRIBUTED' END AS attribution, CASE WHEN i <= 4 THEN 'CERTAIN' WHEN i = 7 THEN 'INFERRED' END AS attribution_confidence FROM c""")
def flip_attribution(spark, d):
    """Why findings differ: a rule's version valid at each run, new evidence of two kinds, checks, or the engine alone."""
    code = F.get_json_object("props", "$.k").cast("int") % 20
    changed = table(spark, d, "events").filter("event_type = 'click' AND value > 150 AND user_id % 5 = 0")
    rules = changed.groupBy(code.alias("code"), F.col("ts").alias("since")).agg(F.min("event_id").alias("rule"))
    dated = _deltas(spark, d).withColumns({"_t1": F.lit(FIRST).cast("timestamp"), "_t2": F.lit(SECOND).cast("timestamp")})
    for at, name in (("_t1", "_r1"), ("_t2", "_r2")):
        dated = versions.as_of(dated, rules, ["code"], at, "since").withColumnRenamed("rule", name).drop("since")
    other = ~F.col("old_evidence").eqNullSafe(F.col("new_evidence"))
    signs = {
        "rule_changed": ~F.col("_r1").eqNullSafe(F.col("_r2")),
        "new_document": other & (F.col("value") > 100),
        "new_attestation": other & (F.col("value") < 20),
        "check_changed": F.col("new_evidence")[0] % 2 == 0,
        "engine_changed": F.col("user_id") % 2 == 0,
    }
    found = versions.attributed(dated.filter("delta <> 'UNCHANGED'"), signs)
    return found.select("user_id", "code", "delta", "attribution", "attribution_confidence")


_QUESTION = "CASE WHEN o_orderkey % 3 = 0 THEN 'EXTERNALLY_BLOCKED' ELSE 'DOCUMENT_ANSWERABLE' END"
_STATUS = "CASE WHEN o_orderkey % 5 < 2 THEN 'OPEN' WHEN o_orderkey % 5 < 4 THEN 'RESOLVED' ELSE 'DISMISSED' END"
_SPLIT = "1997-01-01"


@query(f"""WITH q AS (SELECT o_custkey, o_orderpriority, o_orderdate >= '{_SPLIT}' AS late, last({_QUESTION} ORDER BY o_orderdate, o_orderkey) AS kind,
        last({_STATUS} ORDER BY o_orderdate, o_orderkey) AS status FROM orders GROUP BY ALL)
    SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority,
        CASE WHEN b.kind IS NULL THEN 'CLOSED' WHEN a.kind IS NULL THEN 'OPENED' WHEN b.status = 'DISMISSED' THEN 'DISMISSED'
            WHEN b.status = 'RESOLVED' AND a.kind = 'EXTERNALLY_BLOCKED' THEN 'BECAME_UNBLOCKED' WHEN b.status = 'RESOLVED' THEN 'CLOSED'
            WHEN b.kind = 'EXTERNALLY_BLOCKED' AND a.kind <> 'EXTERNALLY_BLOCKED' THEN 'BECAME_BLOCKED' ELSE 'PERSISTED' END AS outcome
    FROM (SELECT * FROM q WHERE NOT late) a FULL JOIN (SELECT * FROM q WHERE late) b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority""")
def question_deltas(spark, d):
    """A customer's orders of a priority as one question: the last before a date, and the last from then on."""
    rows = table(spark, d, "orders").withColumns({"kind": F.expr(_QUESTION), "status": F.expr(_STATUS)})
    last = lambda when: events.first_by(rows.filter(when), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], last=True)
    return versions.question_deltas(last(F.col("o_orderdate") < _SPLIT), last(F.col("o_orderdate") >= _SPLIT), ["o_custkey", "o_orderpriority"])


@query(r"""WITH t AS (SELECT *, regexp_replace(text, '[\s\x0B]+', '', 'g') AS p FROM conversations),
    v AS (SELECT conv_id, turn, right(p, 9) || left(lead(p) OVER (PARTITION BY conv_id ORDER BY turn), 9) AS value FROM t),
    w AS (SELECT conv_id, turn, 0 AS apart, value FROM v UNION ALL SELECT conv_id + 1, turn, 1, value FROM v),
    j AS (SELECT conv_id, upper(string_agg(p, '' ORDER BY turn)) AS whole FROM t GROUP BY conv_id)
    SELECT w.conv_id, turn, apart, CASE WHEN contains(whole, upper(value)) THEN value END AS value, CASE WHEN NOT coalesce(contains(whole, upper(value)), false) THEN value END AS discarded
    FROM w LEFT JOIN j ON w.conv_id = j.conv_id""")
def registration_backstop(spark, d):
    """Turns as pages: what stands over the end of each is looked for in its own conversation and in the next one."""
    said = table(spark, d, "conversations")
    bare = F.regexp_replace("text", r"\s+", "")
    after = F.lead(bare).over(Window.partitionBy("conv_id").orderBy("turn"))
    claimed = said.select("conv_id", "turn", F.concat(F.expr(r"right(regexp_replace(text, '\\s+', ''), 9)"), F.substring(after, 1, 9)).alias("value"))
    values = claimed.withColumn("apart", F.lit(0)).unionByName(claimed.withColumns({"conv_id": F.col("conv_id") + 1, "apart": F.lit(1)}))
    found = registrations.present(values, said, "conv_id", "turn", "text", "value", longest=18)
    return registrations.backstop(found, "value").select("conv_id", "turn", "apart", "value", "discarded")


# Turns of a conversation are the pages of a run; rule j is read from turn j, by its length.
_RULES = ("C0", "C1", "C2", "C3", "C4")
_NEEDS = (("K0", "C0"), ("K1", "C1"), ("K1", "C2"), ("K2", "C2"))
_INVERSE = (("C0", "C3"), ("C1", "C4"))
_TIER = "CASE WHEN code IN ('C0', 'C1') THEN 'VETO' WHEN code = 'C4' THEN 'GREEN_FLAG' ELSE 'RED_FLAG' END"


def _scored(spark, d):
    said = table(spark, d, "conversations").filter("text IS NOT NULL").withColumn("n", F.length("text"))
    run, code = F.col("conv_id"), F.concat(F.lit("C"), F.col("turn").cast("string"))
    criteria = said.select("conv_id").distinct().select("conv_id", F.explode(F.array(*map(F.lit, _RULES))).alias("code")).withColumns({"name": F.concat(F.lit("Rule "), F.col("code")), "tier": F.expr(_TIER)})
    read = said.filter(F.col("turn") < len(_RULES)).select("conv_id", code.alias("code"), "n", "turn", "text")
    absence = F.when(F.col("n") % 4 == 0, "looked on all pages")

    def reading(fired, evaluable, there):
        return read.filter(there).select("conv_id", "code", fired.alias("fired"), evaluable.alias("evaluable"), F.lit("high").alias("confidence"), F.concat(F.lit("read "), F.col("n").cast("string")).alias("reasoning"), absence.alias("absence_evidence"))

    lenient = reading(F.col("n") % 3 != 0, F.lit(True), F.col("n") % 5 != 0)
    strict = reading(F.col("n") % 3 == 1, F.col("n") % 11 != 0, F.col("n") % 7 != 0)
    quote = F.substring("text", 1, 12)
    cited = [read.select("conv_id", "code", F.lit(p).alias("pass"), F.lit(0).alias("seq"), (F.col("turn") + i).alias("page"), quote.alias("quote")) for i, p in ((1, "lenient"), (2, "strict"))]
    pages = said.select("conv_id", (F.col("turn") + 1).alias("page"), "text")
    checks = said.select("conv_id", F.concat(F.lit("K"), (F.col("turn") % 3).cast("string")).alias("check"), F.col("turn").alias("seq"),
        F.when(F.col("n") % 13 == 0, "UNAVAILABLE").otherwise("CLEAR").alias("outcome"), F.lit("captcha").alias("blocker"), F.lit("procurement").alias("owner"), F.lit("down").alias("reason"))
    needs, pairs = spark.createDataFrame(_NEEDS, "check string, code string"), spark.createDataFrame(_INVERSE, "a string, b string")
    model = read.filter("n % 6 = 0").select("conv_id", F.col("turn").alias("seq"), F.lit("field").alias("field_path"), F.lit(None).cast("string").alias("kind"), F.concat(F.lit("n "), (F.col("n") % 12).cast("string")).alias("account"),
        *[F.lit(None).cast("string").alias(c) for c in ("stage_origin", "typical_source", "blocker_class", "unblock_owner")])
    found = scoring.findings(criteria, lenient, strict, cited[0].unionByName(cited[1]), pages, checks, needs, pairs, "conv_id")
    return found, scoring.entries(found, model, pairs, "conv_id")


_CANON = oracles._CANON
_SCORED = f"""s AS (SELECT *, length(text) AS n FROM conversations WHERE text IS NOT NULL),
    r AS (SELECT conv_id, 'C' || turn AS code, n, turn, text FROM s WHERE turn < 5),
    c AS (SELECT conv_id, code, {_TIER} AS tier FROM (SELECT DISTINCT conv_id, unnest(['C0', 'C1', 'C2', 'C3', 'C4']) AS code FROM s)),
    p AS (SELECT conv_id, turn + 1 AS page, {_CANON.format("text")} AS p FROM s),
    e AS (SELECT x.*, CASE WHEN q <> '' AND contains(p.p, q) THEN 'exact' ELSE 'unverified' END AS v FROM (SELECT conv_id, code, i AS strict, turn + 1 + i AS page, {_CANON.format("left(text, 12)")} AS q FROM r, (VALUES (0), (1)) t(i)) x
        JOIN p ON x.conv_id = p.conv_id AND x.page = p.page),
    b AS (SELECT c.*, n, n % 5 <> 0 AS has_l, n % 7 <> 0 AS has_s, n % 3 <> 0 AS lf, n % 3 = 1 AS sf, n % 11 <> 0 AS ev FROM c LEFT JOIN r ON c.conv_id = r.conv_id AND c.code = r.code),
    m AS (SELECT *, CASE WHEN n IS NULL OR NOT (has_l OR has_s) THEN 'unread' WHEN has_l AND NOT has_s THEN 'lenient' WHEN has_s AND NOT has_l THEN 'strict'
        WHEN NOT ev THEN 'failed' WHEN lf = sf THEN 'agreed' ELSE 'differ' END AS how FROM b),
    k AS (SELECT *, CASE how WHEN 'lenient' THEN lf WHEN 'strict' THEN sf WHEN 'agreed' THEN sf WHEN 'differ' THEN sf END AS fired0, how IN ('lenient', 'strict', 'differ') AS cont0 FROM m),
    w AS (SELECT k.conv_id, k.code, coalesce(string_agg(page || ':' || v, ',' ORDER BY strict), '') AS evidence FROM k JOIN e ON k.conv_id = e.conv_id AND k.code = e.code
        AND (how = 'differ' OR (how IN ('strict', 'agreed') AND strict = 1) OR (how = 'lenient' AND strict = 0)) GROUP BY ALL),
    a AS (SELECT k.*, coalesce(evidence, '') AS evidence, fired0 AND evidence IS NULL AND n % 4 <> 0 AS repaired FROM k LEFT JOIN w ON k.conv_id = w.conv_id AND k.code = w.code),
    u AS (SELECT DISTINCT conv_id, code FROM s JOIN (VALUES ('K0', 'C0'), ('K1', 'C1'), ('K1', 'C2'), ('K2', 'C2')) t(chk, code) ON 'K' || turn % 3 = chk WHERE n % 13 = 0),
    z AS (SELECT a.*, u.code IS NOT NULL AS blocked, CASE WHEN repaired THEN NULL ELSE fired0 END AS before FROM a LEFT JOIN u ON a.conv_id = u.conv_id AND a.code = u.code),
    y AS (SELECT *, CASE WHEN blocked THEN NULL ELSE before END AS fired, cont0 AND NOT blocked AS cont1 FROM z),
    x AS (SELECT f.conv_id, f.code AS a, g.code AS b FROM y f JOIN y g ON f.conv_id = g.conv_id AND f.fired AND g.fired JOIN (VALUES ('C0', 'C3'), ('C1', 'C4')) t(a, b) ON f.code = t.a AND g.code = t.b),
    h AS (SELECT conv_id, a AS code FROM x UNION SELECT conv_id, b FROM x),
    f AS (SELECT y.*, cont1 OR h.code IS NOT NULL AS contested, h.code IS NOT NULL AS hit FROM y LEFT JOIN h ON y.conv_id = h.conv_id AND y.code = h.code)"""


@query(f"""WITH {_SCORED} SELECT conv_id, code, CAST(fired AS VARCHAR) AS fired, contested, CASE WHEN NOT blocked AND how = 'agreed' THEN 'high' ELSE 'low' END AS confidence, evidence,
    CASE WHEN blocked THEN CAST(before AS VARCHAR) END AS before, CASE WHEN hit THEN 'contested' WHEN fired IS NULL THEN CASE WHEN tier = 'VETO' THEN 'veto_unevaluated' ELSE 'unevaluated' END
        WHEN how = 'differ' THEN 'contested' WHEN fired THEN 'fired' ELSE 'not_fired' END AS status FROM f""")
def whole_findings(spark, d):
    """Two readings of each rule, reconciled, with evidence verified on its pages, repaired, blocked and held against inverse rules."""
    found, _ = _scored(spark, d)
    evidence = F.array_join(F.transform(F.coalesce("evidence", F.expr("filter(evidence, x -> false)")), lambda e: F.concat_ws(":", e["page"].cast("string"), e["verification"])), ",")
    return found.select("conv_id", "code", F.col("fired").cast("string").alias("fired"), "contested", "confidence", F.coalesce(evidence, F.lit("")).alias("evidence"), F.col("before_policy.fired").cast("string").alias("before"), "status")


@query(f"""WITH {_SCORED}, n AS (SELECT DISTINCT conv_id, 'field' AS field_path, 'EXTERNALLY_BLOCKED' AS kind, n % 12 AS v, 'manual_analyst_check' AS unblock_owner, 'reading' AS origin FROM r WHERE n % 6 = 0)
    SELECT conv_id, field_path, kind, unblock_owner, origin FROM n
    UNION ALL SELECT conv_id, code, 'EXTERNALLY_BLOCKED', 'procurement', 'blocked' FROM f WHERE blocked AND before
    UNION ALL SELECT conv_id, a || '+' || b, 'ANALYST_ANSWERABLE', NULL, 'pair' FROM x
    UNION ALL SELECT conv_id, code, 'EXTERNALLY_BLOCKED', CASE WHEN blocked THEN 'procurement' ELSE 'manual_analyst_check' END, 'unevaluated' FROM f WHERE fired IS NULL
    UNION ALL SELECT conv_id, code, 'ANALYST_ANSWERABLE', NULL, 'contested' FROM f WHERE contested""")
def scored_entries(spark, d):
    """What those findings leave open, from all five sources."""
    return _scored(spark, d)[1].select("conv_id", "field_path", "kind", "unblock_owner", "origin")


@query("""WITH a AS (SELECT sha256(text) AS sha256, min(CAST(doc_id AS VARCHAR)) AS name, max(strlen(text)) AS bytes FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY 1),
    b AS (SELECT sha256(text) AS sha256, min(CAST(doc_id AS VARCHAR)) AS name, max(strlen(text)) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1)
    SELECT sha256, name, bytes, 1 AS version FROM a UNION ALL SELECT sha256, name, bytes, 2 FROM b WHERE sha256 NOT IN (SELECT sha256 FROM a)""")
def evidence_manifest(spark, d):
    """Documents of a known language as a first version's files, all documents as a second's."""
    docs = table(spark, d, "documents")
    first = manifest.additions(spark.createDataFrame([], manifest.SCHEMA), manifest.files(docs.filter("lang IS NOT NULL"), "doc_id", "text"), 1)
    return first.unionByName(manifest.additions(first, manifest.files(docs, "doc_id", "text"), 2))


@query("""WITH r AS (SELECT n_nationkey AS code, 500 * n_nationkey + CASE WHEN n_regionkey = 1 THEN 1000 ELSE 0 END AS floor FROM nation WHERE n_regionkey <> 4)
    SELECT code, c_custkey, c_acctbal > floor AS fired FROM r JOIN customer ON c_nationkey = code""")
def rules_reevaluated(spark, d):
    """A nation's rule on its customers' balances: one region's rules changed, another's are gone; only the changed are evaluated."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), "n_regionkey", (F.col("n_nationkey") * 500).alias("floor"))
    raised = F.col("floor") + F.when(F.col("n_regionkey") == 1, 1000).otherwise(0)
    before = nations.select("code", "floor")
    after = nations.filter("n_regionkey <> 4").select("code", raised.alias("floor"))
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")

    def evaluate(rules):
        return customers.join(rules, F.col("c_nationkey") == F.col("code")).select("code", "c_custkey", (F.col("c_acctbal") > F.col("floor")).alias("fired"))

    return criteria.reevaluated(evaluate(before), before, after, "code", evaluate)


_BARE = r"trim(regexp_replace(regexp_replace(' ' || regexp_replace(upper({}), '[^A-Z0-9]+', '  ', 'g') || ' ', ' (LLC|LP|CAPITAL|PARTNERS) ', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH f AS (SELECT DISTINCT p_brand AS firm, {_BARE.format("p_name || ' ' || p_type || ' Partners LP'")} AS fund FROM part),
    h AS (SELECT DISTINCT p_partkey AS investor, {_BARE.format("'The ' || p_name || ' Capital ' || p_type || ' LLC'")} AS held FROM part)
    SELECT DISTINCT firm, investor FROM f JOIN h ON fund <> '' AND contains(held, fund)""")
def roster_chain(spark, d):
    """Brands as firms, their parts' names as funds, and parts as investors that hold a fund of a longer name."""
    part = table(spark, d, "part")
    filings = part.select(F.col("p_brand").alias("firm"), F.concat_ws(" ", "p_name", "p_type", F.lit("Partners LP")).alias("fund"))
    holdings = part.select(F.col("p_partkey").alias("investor"), F.concat_ws(" ", F.lit("The"), "p_name", F.lit("Capital"), "p_type", F.lit("LLC")).alias("fund"))
    return matching.roster(filings, holdings)


#: Memos of a task: a part of few bytes becomes 13 files, so that its bytes don't tell the work.
MEMOS = 5_000


def _memo(spark, d):
    """A memo of each part: 13 files, some missing, empty, at odds with the scorecard, with a strange number or without an entry."""
    key, name = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_type")
    part = table(spark, d, "part").select(key.alias("run"), name.alias("said"), F.col("p_retailprice").cast("string").alias("price"))
    part = part.repartition(table(spark, d, "part").count() // MEMOS + 1, "run")
    every = lambda n, rest: F.col("run") % n == rest
    verdicts = list(memo_files.LABELS)
    verdict = F.get(F.array(*map(F.lit, verdicts)), (F.col("run") % 4).cast("int"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in memo_files.LABELS.items() for x in kv]), verdict)
    account = F.concat(F.lit("Searched every page and table of the documents for it, and the register as well, without any result: "), "said")
    path = F.concat(F.lit("terms.of_"), F.col("run").cast("string"))
    rate = F.round(F.col("run") % 997 / 997 * 100, 1).cast("string")
    said = {
        "01-recommendation.md": F.when(every(11, 3), F.lit("No verdict is given in this file")).otherwise(F.concat_ws(" ", F.lit("The verdict:"), label, F.when(every(11, 2), F.lit("or HOLD — defer pending answers")))),
        "05-supporting-factors.md": F.when(~every(5, 1), F.lit("No green-flag criterion fired.")).otherwise(""),
        "08-track-record.md": F.concat_ws(" ", F.lit("Priced at"), "price", F.when(every(13, 4), F.concat(F.lit("of"), (F.col("run") + 5_000_000).cast("string"))), F.lit("in page 12345")),
        "11-open-questions.md": F.concat(F.lit("## Open Questions\n"), F.when(every(17, 5), F.lit("Nothing is open here at all.")).when(every(17, 6), F.concat(F.lit("Still open is "), path)).otherwise(F.concat_ws(" ", path, account))),
        "12-sources.md": F.concat(F.lit("Readings agreed in "), rate, F.lit("% of rules.")),
    }
    body = F.concat("said", F.lit(" is what this section is about"))
    files = part.select("run", "said", "price", F.explode(F.array(*map(F.lit, memo_files.FILES))).alias("name")).filter(~((F.col("name") == "07-team.md") & every(7, 0)))
    for file, text in said.items():
        body = F.when(F.col("name") == file, text).otherwise(body)
    files = files.select("run", "name", F.concat(F.lit("# "), "name", F.lit("\n_Written for: IC_\n"), body, F.lit("\n---\n[next](./00-index.md)")).alias("body"))
    memos = part.select("run", F.when(~every(23, 7), F.when(every(19, 6), "else").otherwise(F.upper(verdict))).alias("recommendation"), every(29, 8).alias("vetoed"))
    scored = part.select("run", F.when(~every(31, 9), verdict).alias("recommendation"), F.lit(False).alias("vetoed"))
    entries = part.select("run", path.alias("field_path"), account.alias("account"), F.lit("EXTERNALLY_BLOCKED").alias("kind"), F.lit(None).cast("string").alias("unblock_owner"))
    numbers = part.select("run", (F.col("run") % 997 / 997).alias("agreement_rate"), *[F.lit(None).cast("double").alias(c) for c in ("red_flag_weight", "green_flag_weight", "cost_usd")])
    citations = table(spark, d, "lineitem").select(F.col("l_partkey").alias("run"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") > 10).alias("quote_verified"))
    absences = part.select("run", every(2, 0).alias("disclosed"))
    sources = part.select("run", F.concat_ws(" ", "said", "price", path).alias("text"))
    declared = memo_files.declared_numbers(entries, citations, absences, numbers, "run")
    return files, memo_files.violations(files, memos, scored, sources, declared, entries, "run")


_GATES = """WITH p AS (SELECT p_partkey AS k, p_partkey % 31 <> 9 AS known, p_partkey % 4 AS v FROM part), b AS (
    SELECT k AS run, 1 AS step, 'file_missing' AS gate, '07-team.md' AS name, '' AS detail FROM p WHERE k % 7 = 0
    UNION ALL SELECT k, 2, 'file_empty', '05-supporting-factors.md', '' FROM p WHERE k % 5 = 1
    UNION ALL SELECT k, 3, 'scorecard_missing', '', '' FROM p WHERE NOT known
    UNION ALL SELECT k, 4, 'recommendation_missing', '', '' FROM p WHERE known AND k % 23 = 7
    UNION ALL SELECT k, 5, 'recommendation_differs', '', '' FROM p WHERE known AND k % 23 <> 7 AND k % 19 = 6
    UNION ALL SELECT k, 6, 'veto_differs', '', '' FROM p WHERE known AND k % 29 = 8
    UNION ALL SELECT k, 7, 'label_missing', '01-recommendation.md', '' FROM p WHERE known AND k % 11 = 3
    UNION ALL SELECT k, 8, 'label_of_another', '01-recommendation.md', '' FROM p WHERE known AND k % 11 = 2 AND v <> 1
    UNION ALL SELECT k, 9, 'number_untraceable', '08-track-record.md', CAST(k + 5000000 AS VARCHAR) FROM p WHERE k % 13 = 4
    UNION ALL SELECT k, 11, 'entry_missing', '11-open-questions.md', 'terms.of_' || k FROM p WHERE k % 17 = 5
    UNION ALL SELECT k, 12, 'account_missing', '11-open-questions.md', 'terms.of_' || k FROM p WHERE k % 17 = 6)"""


@query(f"{_GATES} SELECT * FROM b")
def memo_gate_sequence(spark, d):
    """All that keeps each memo from being published, gates in sequence over all its files."""
    return _memo(spark, d)[1]


@query(f"""{_GATES} SELECT arg_min(gate, (step, name, detail)) AS gate, arg_min(name, (step, name, detail)) AS name, run FROM b GROUP BY run
    UNION ALL SELECT 'passed', 'files: ' || 13, k FROM p WHERE k NOT IN (SELECT run FROM b)""")
def memo_outcomes(spark, d):
    """What each memo stops at, or that all of its files go to the sink."""
    files, broken = _memo(spark, d)
    return memo_files.outcomes(files, broken, "run").select("gate", "name", "run")
