"""Queries of the engine's stages over the test tables, each beside its SQL.

As in registry.py, rows of the test tables stand for rules, readings, checks, entries and
attempts; the operators themselves are tested on their own shapes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.functions import parse
from verisift.functions.text import one_spaced
from verisift.jobs import oracles
from verisift.operators import criteria, documents, events, findings, gates, memo, payloads, reconcile, telemetry, unresolved
from verisift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def kept(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return kept


def _findings(spark: SparkSession, d: str) -> DataFrame:
    from verisift.jobs.registry import findings as made

    return made(spark, d)


_F = oracles._FINDINGS


@query("""WITH e AS (SELECT l_suppkey, l_linenumber AS page, 'part ' || l_partkey % 5 AS norm, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS pass, l_orderkey
        FROM lineitem WHERE l_returnflag <> 'N')
    SELECT l_suppkey, page, norm AS quote, min(pass) AS pass, arg_min(l_orderkey, (pass, l_orderkey)) AS first_order, count(*) AS n FROM e GROUP BY l_suppkey, page, norm""")
def evidence_union(spark, d):
    """Evidence of two readings, one row per page and quote: the first seen, the lenient reading before the strict one."""
    quote = F.concat(F.lit(" Part  "), (F.col("l_partkey") % 5).cast("string"))
    rows = table(spark, d, "lineitem").filter("l_returnflag <> 'N'").select(
        "l_suppkey", F.col("l_linenumber").alias("page"), quote.alias("quote"),
        F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("pass"), F.col("l_orderkey").alias("first_order"),
    )
    union = findings.evidence_union(rows, ["l_suppkey"], ["pass", "first_order"])
    return union.withColumn("quote", one_spaced(F.col("quote")))


def _supported(spark, d):
    """Findings with evidence, the figures that their documents begin with, and German texts as absence statements."""
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("text").rlike("[0-9]{2}"), F.array(F.struct((F.col("doc_id") % 4).cast("int").alias("page"), F.regexp_extract("text", "[0-9]{2}", 0).alias("quote"))))
        .otherwise(F.expr("cast(array() as array<struct<page:int,quote:string>>)")).alias("evidence"),
        F.when(F.col("lang") == "de", F.lit("looked through all pages")).alias("absence_evidence"),
    )
    return _findings(spark, d).join(docs, "doc_id")


_SUPPORT = "regexp_matches(text, '[0-9]{2}') OR coalesce(lang = 'de', false)"


@query(f"""WITH {_F}, g AS (SELECT f.doc_id, tier, status, coalesce(fired, false) AND NOT ({_SUPPORT}) AS repaired, fired FROM f JOIN documents d ON f.doc_id = d.doc_id)
    SELECT doc_id, repaired, CASE WHEN repaired THEN NULL ELSE CAST(fired AS VARCHAR) END AS fired,
        CASE WHEN repaired THEN CASE WHEN tier = 'VETO' THEN 'veto_unevaluated' ELSE 'unevaluated' END ELSE status END AS status FROM g""")
def absence_repair(spark, d):
    fixed = findings.repair_absence(_supported(spark, d))
    return fixed.select("doc_id", "repaired", F.col("fired").cast("string").alias("fired"), "status")


@query(f"""WITH {_F}, g AS (SELECT f.doc_id, regexp_matches(text, '[0-9]{{2}}') AS has, {_SUPPORT} AS support FROM f JOIN documents d ON f.doc_id = d.doc_id WHERE fired)
    SELECT 'evidence_missing' AS gate, doc_id AS key FROM g WHERE NOT support UNION ALL SELECT 'page_invalid', doc_id FROM g WHERE has AND doc_id % 4 < 1""")
def evidence_violations(spark, d):
    return gates.violations(_supported(spark, d), "doc_id", findings.evidence_violations(F.col("evidence"), F.col("absence_evidence"), F.col("fired")))


@query(f"""WITH {_F}, p AS (SELECT a.source, a.doc_id % 8 AS a, b.doc_id % 8 AS b FROM f a JOIN f b ON a.source = b.source AND a.fired AND b.fired
        AND ((a.doc_id % 8 = 1 AND b.doc_id % 8 = 2) OR (a.doc_id % 8 = 4 AND b.doc_id % 8 = 7)) GROUP BY ALL)
    SELECT f.doc_id, (status = 'contested' OR h.c IS NOT NULL) AS contested, CASE WHEN h.c IS NOT NULL THEN 'contested' ELSE status END AS status
    FROM f LEFT JOIN (SELECT source, a AS c FROM p UNION SELECT source, b FROM p) h ON f.source = h.source AND f.doc_id % 8 = h.c""")
def exclusive_pairs(spark, d):
    """Codes are ids modulo 8, runs are sources; two pairs of codes exclude each other."""
    coded = _findings(spark, d).withColumn("code", F.col("doc_id") % 8)
    pairs = spark.createDataFrame([(1, 2), (4, 7)], "a long, b long")
    marked, _ = findings.exclusive_pairs(coded, pairs, ["source"], "code")
    return marked.select("doc_id", "contested", "status")


_CHECKS = """c AS (SELECT o_custkey % 100 AS run, o_orderpriority AS chk, o_orderkey AS seq, ['captcha', 'login_required', 'geo_fence'][o_orderkey % 3 + 1] AS blocker,
    ['infrastructure', 'procurement'][o_orderkey % 2 + 1] AS owner FROM orders WHERE o_orderstatus = 'P')"""


@query(f"""WITH {_CHECKS}, m AS (SELECT * FROM (VALUES ('1-URGENT', 'CR-1'), ('1-URGENT', 'CR-2'), ('2-HIGH', 'CR-2'), ('5-LOW', 'CR-3')) t(chk, code))
    SELECT run, code, count(DISTINCT chk) AS causes, arg_min(chk, seq) AS first_check, arg_min(blocker, seq) AS blocker, arg_min(owner, seq) AS owner
    FROM c JOIN m USING (chk) GROUP BY run, code""")
def blocked_causes(spark, d):
    """Unavailable checks, mapped to the rules that need them."""
    o = F.col("o_orderkey")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (o % len(xs)).cast("int"))
    checks = table(spark, d, "orders").select(
        (F.col("o_custkey") % 100).alias("run"), F.col("o_orderpriority").alias("check"), o.alias("seq"),
        F.when(F.col("o_orderstatus") == "P", "UNAVAILABLE").otherwise("CLEAR").alias("outcome"),
        pick(("captcha", "login_required", "geo_fence")).alias("blocker"), pick(("infrastructure", "procurement")).alias("owner"),
    )
    rules = [("1-URGENT", "CR-1"), ("1-URGENT", "CR-2"), ("2-HIGH", "CR-2"), ("5-LOW", "CR-3")]
    return findings.blocked_causes(checks, spark.createDataFrame(rules, "check string, code string"), ["run"])


@query(f"""WITH {_F} SELECT source, bool_or(tier = 'VETO' AND coalesce(fired, false) AND confidence = 'high') AS halted,
    count(*) FILTER (tier = 'VETO' AND fired AND confidence = 'high') AS vetoes FROM f GROUP BY source""")
def veto_halt(spark, d):
    return findings.veto_halt(_findings(spark, d), ["source"])


@query(f"""WITH {_F} SELECT source, status, string_agg(DISTINCT CAST(doc_id % 40 AS VARCHAR), ',' ORDER BY CAST(doc_id % 40 AS VARCHAR)) AS codes, count(*) AS n
    FROM f GROUP BY source, status""")
def scorecard_lists(spark, d):
    """Sorted codes of each status; codes are ids modulo 40."""
    return findings.code_lists(_findings(spark, d).withColumn("code", F.col("doc_id") % 40), ["source"], "status", "code")


def _entries(spark, d):
    """Events as open questions: kinds, owners and accounts by their numbers, some missing or unknown."""
    e, k = F.col("event_id"), F.col("event_id") % 7
    pick = lambda xs, n: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (n % len(xs)).cast("int"))
    account = F.concat(F.col("event_type"), F.lit(" - "), pick(("The register was unreachable today", "Nothing on page nine", "Behind a CAPTCHA"), k))
    return table(spark, d, "events").select(
        (F.col("user_id") % 50).alias("run"), e.alias("seq"), F.when(k < 5, F.concat(F.lit("field."), F.col("event_type"))).alias("field_path"),
        pick(("DOCUMENT_ANSWERABLE", "ANALYST_ANSWERABLE", "EXTERNALLY_BLOCKED", "OTHER", None), e).alias("kind"),
        F.lit(None).cast("string").alias("stage_origin"), account.alias("account"), pick(("ppm", "memory"), e).alias("typical_source"),
        pick(("captcha", "rain"), e).alias("blocker_class"), pick(("procurement", "nobody", None), e).alias("unblock_owner"),
    )


_SAFE = """e0 AS (SELECT user_id % 50 AS run, event_id AS seq, CASE WHEN event_id % 7 < 5 THEN 'field.' || event_type ELSE event_type END AS field_path,
        ['DOCUMENT_ANSWERABLE', 'ANALYST_ANSWERABLE', 'EXTERNALLY_BLOCKED', 'OTHER', 'EXTERNALLY_BLOCKED'][event_id % 5 + 1] AS k0,
        event_type || ' - ' || ['The register was unreachable today', 'Nothing on page nine', 'Behind a CAPTCHA'][event_id % 7 % 3 + 1] AS account,
        event_id % 7 % 3 <> 1 AS unperformed FROM events),
    e AS (SELECT *, CASE WHEN k0 = 'OTHER' OR unperformed THEN 'EXTERNALLY_BLOCKED' ELSE k0 END AS kind,
        CASE WHEN k0 = 'OTHER' THEN 'unrecognised kind' WHEN k0 <> 'EXTERNALLY_BLOCKED' AND unperformed THEN 'check not performed' END AS forced FROM e0),
    s AS (SELECT *, CASE WHEN kind = 'DOCUMENT_ANSWERABLE' AND seq % 2 = 0 THEN 'ppm' END AS typical_source,
        CASE WHEN kind = 'EXTERNALLY_BLOCKED' AND seq % 2 = 0 THEN 'captcha' END AS blocker_class,
        CASE WHEN kind = 'EXTERNALLY_BLOCKED' THEN CASE WHEN seq % 3 = 0 THEN 'procurement' ELSE 'manual_analyst_check' END END AS unblock_owner FROM e)"""


def _safe(spark, d):
    return unresolved.kind_safety(unresolved.coerced(_entries(spark, d), "scoring"))


@query(f"WITH {_SAFE} SELECT seq, field_path, kind, forced, typical_source, blocker_class, unblock_owner FROM s")
def kind_safety(spark, d):
    return _safe(spark, d).select("seq", "field_path", "kind", "forced", "typical_source", "blocker_class", "unblock_owner")


@query(f"""WITH {_SAFE} SELECT run, kind, count(*) AS n,
    coalesce(list_position(['DOCUMENT_ANSWERABLE', 'ANALYST_ANSWERABLE', 'EXTERNALLY_BLOCKED'], kind), 4) AS place FROM s GROUP BY run, kind""")
def unresolved_by_kind(spark, d):
    return unresolved.by_kind(_safe(spark, d), ["run"])


@query(f"WITH {_SAFE} SELECT run, unblock_owner AS owner, count(*) AS n, min(seq) AS first_seen FROM s WHERE kind = 'EXTERNALLY_BLOCKED' GROUP BY run, owner")
def blocked_by_owner(spark, d):
    return unresolved.by_owner(_safe(spark, d), ["run"], "seq")


@query("""WITH r AS (SELECT event_id AS key, event_id % 5 AS k, event_id % 7 >= 5 AS bare, event_id % 3 AS o FROM events)
    SELECT 'field_missing' AS gate, key FROM r UNION ALL SELECT 'kind_unknown', key FROM r WHERE k = 3
    UNION ALL SELECT 'blocked_names_source', key FROM r WHERE k = 2 UNION ALL SELECT 'blocked_without_owner', key FROM r WHERE k = 2 AND o = 2
    UNION ALL SELECT 'answerable_names_blocker', key FROM r WHERE k < 2""")
def entry_violations(spark, d):
    """The entries as they came, before they were coerced: none names its stage."""
    return gates.violations(_entries(spark, d), "seq", unresolved.entry_gates())


@query(f"""WITH {_SAFE}, x AS (SELECT run, field_path, substr(account, 1, 160) AS head, CASE WHEN seq % 2 = 0 THEN 'classification' ELSE 'scoring' END AS stage, seq, kind FROM s)
    SELECT run, field_path, min(seq) AS seq, 'scoring' AS stage, arg_min(kind, seq) AS kind FROM x WHERE stage = 'scoring' GROUP BY run, field_path, head
    UNION ALL SELECT run, field_path, seq, stage, kind FROM x WHERE stage = 'classification'""")
def unresolved_assembled(spark, d):
    """Two stages' entries, those of scoring once for each field and account."""
    safe = _safe(spark, d)
    parts = {"classification": safe.filter("seq % 2 = 0"), "scoring": safe.filter("NOT (seq % 2 <=> 0)")}
    return unresolved.assembled(parts, ["run"], "seq").select("run", "field_path", "seq", "stage", "kind")


@query(r"""WITH n AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, string_split(t, ' ')[1] AS p, substr(t, 1, 120) AS account, substr(t, CASE WHEN doc_id % 3 = 0 THEN 40 ELSE 1 END, CASE WHEN doc_id % 5 = 0 THEN 70 ELSE 100000 END) AS section FROM n),
        m AS (SELECT doc_id, p AS field_path, CASE WHEN p <> '' AND NOT contains(trim(section), p) THEN 'field_path'
            WHEN length(trim(account)) > 80 AND NOT contains(trim(section), right(trim(account), 80)) THEN 'account' END AS missing FROM e)
    SELECT * FROM m WHERE missing IS NOT NULL""")
def unresolved_carried(spark, d):
    """Entries made of each document's beginning, against a section that some documents cut short."""
    text = one_spaced(F.col("text"))
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", text.alias("t"))
    entries = docs.select("doc_id", F.get(F.split("t", " "), 0).alias("field_path"), F.substring("t", 1, 120).alias("account"))
    begin, size = F.when(F.col("doc_id") % 3 == 0, 40).otherwise(1), F.when(F.col("doc_id") % 5 == 0, 70).otherwise(100_000)
    return unresolved.not_carried(entries, docs.select("doc_id", F.substr("t", begin, size).alias("section")), ["doc_id"])


@query("""SELECT conv_id, turn, CASE WHEN role <> 'system' THEN coalesce(replace(text, '#', ''), 'none') || chr(10) || '### Sub' || chr(10) || 'x' ELSE 'z' END AS body,
    CASE WHEN role <> 'system' THEN length(trim(coalesce(replace(text, '#', ''), 'none'))) + 2 >= 20 ELSE false END AS filled FROM conversations""")
def memo_sections(spark, d):
    """A section of a memo made of each turn, with a deeper heading inside and others around; memos without it have one that names it too."""
    turn = F.coalesce(F.replace("text", F.lit("#"), F.lit("")), F.lit("none"))
    title = F.when(F.col("role") != "system", "## 11. Open Questions").otherwise("## Annex")
    body = F.array_join(F.array(F.lit("# Memo\n## Before\ny"), title, turn, F.lit("### Sub\nx\n## After\n### Open Questions again\nz")), "\n")
    found = table(spark, d, "conversations").select("conv_id", "turn", memo.section(body, "open questions").alias("body"))
    return found.select("conv_id", "turn", "body", (F.length(F.regexp_replace(memo.bare_body(F.col("body")), r"\s*x$", "")) + 2 >= 20).alias("filled"))


_LABELS = {"pass": "Pass on it", "hold": "Hold", "pursue_with_questions": "Pursue, with questions", "pursue": "Pursue it"}


@query(f"""WITH {_F}, r AS ({oracles._RECOMMEND}),
        m AS (SELECT source, recommendation AS c, length(source) % 2 = 0 AS even, vetoes_decisive > 0 AS v FROM r)
    SELECT 'recommendation_differs' AS gate, source AS key FROM m WHERE even AND c <> 'hold' UNION ALL SELECT 'veto_differs', source FROM m WHERE v
    UNION ALL SELECT 'label_missing', source FROM m WHERE c NOT IN ('hold', 'pass') UNION ALL SELECT 'label_of_another', source FROM m WHERE c <> 'hold'
    UNION ALL SELECT 'label_of_another', source FROM m WHERE c = 'hold'""")
def recommendation_agreement(spark, d):
    """Memos that all show two labels and declare no veto; every second one says hold."""
    scored = reconcile.recommend(_findings(spark, d), ["source"])
    stated = F.when(F.length("source") % 2 == 0, " HOLD ").otherwise(F.col("recommendation"))
    rules = memo.memo_gates(stated, F.col("recommendation"), F.lit(False), F.col("vetoes_decisive") > 0, F.lit("# Verdict\nHold, or Pass on it after all"), _LABELS)
    return gates.violations(scored, "source", rules)


@query("""WITH c AS (SELECT p_partkey AS key, p_brand, p_size, p_retailprice - 1000 AS weight, p_name || ' ' || p_type AS g,
        ['GREEN_FLAG', 'RED_FLAG', 'VETO', 'BLUE'][p_partkey % 4 + 1] AS tier FROM part)
    SELECT 'tier_unknown' AS gate, key FROM c WHERE tier = 'BLUE' UNION ALL SELECT 'severity_unknown', key FROM c WHERE p_size % 5 = 4
    UNION ALL SELECT 'weight_not_positive', key FROM c WHERE weight <= 0 UNION ALL SELECT 'guidance_short', key FROM c WHERE length(g) < 40
    UNION ALL SELECT 'text_missing', key FROM c WHERE key % 9 = 0
    UNION ALL SELECT 'guidance_vague', key FROM c WHERE NOT regexp_matches(lower(g), '""" + "|".join(criteria.NOUNS) + """')""")
def criteria_violations(spark, d):
    """Parts as rules."""
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (n % len(xs)).cast("int"))
    rules = table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("criterion_code"), pick((*criteria.TIERS, "BLUE"), F.col("p_partkey")).alias("tier"),
        pick((*criteria.SEVERITIES, "NONE"), F.col("p_size")).alias("severity"), (F.col("p_retailprice") - 1000).alias("weight"),
        F.concat_ws(" ", "p_name", "p_type").alias("detection_guidance"), F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 9 != 0, F.col("p_type")).alias("category"), F.col("p_type").alias("evidence_requirement"),
    )
    return gates.violations(rules, "p_partkey", criteria.gates())


@query("SELECT p_brand AS criterion_code, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 1")
def repeated_codes(spark, d):
    return criteria.repeated_codes(table(spark, d, "part").select(F.col("p_brand").alias("criterion_code")))


def _trees(spark, d):
    """Orders as extraction results of uneven depth: a size whose page is sometimes 0, a name without a quote, a head that is sometimes null, and lists of up to three records with a field far down."""
    leaf = lambda v, p, q: F.struct(v.cast("string").alias("value"), p.cast("int").alias("page"), q.cast("string").alias("quote"))
    none = F.lit(None)
    fund = F.struct(leaf(F.col("o_custkey"), F.col("o_orderkey") % 4, F.col("o_orderpriority")).alias("size"), leaf(F.col("o_orderstatus"), F.lit(1), none).alias("name"))
    team = F.struct(leaf(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")), none, none).alias("head"), F.lit("five of them").alias("note"))
    deep = lambda i: F.struct(F.array(F.struct(F.struct(leaf(i, i + 1, F.lit(" q ")).alias("c")).alias("b"))).alias("a"))
    rows = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("o_orderkey") % 4), deep)
    whole = F.to_json(F.struct(team.alias("team"), rows.alias("rows"), fund.alias("fund")), {"ignoreNullFields": "false"})
    return table(spark, d, "orders").select("o_orderkey", whole.alias("result"))


@query("""SELECT o_orderkey, 'fund.size' AS path, CAST(o_custkey AS VARCHAR) AS value, o_orderkey % 4 AS page, o_orderpriority AS quote, o_orderkey % 4 > 0 AS cited, o_orderkey % 4 = 0 AS unsupported FROM orders
    UNION ALL SELECT o_orderkey, 'fund.name', o_orderstatus, 1, NULL, false, true FROM orders
    UNION ALL SELECT o_orderkey, 'team.head', CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, NULL, NULL, false, o_orderkey % 2 = 0 FROM orders
    UNION ALL SELECT o_orderkey, 'rows[' || i || '].a[0].b.c', CAST(i AS VARCHAR), i + 1, ' q ', true, false FROM orders, (SELECT unnest([0, 1, 2]) AS i) WHERE i < o_orderkey % 4""")
def extraction_leaves(spark, d):
    """Fields of extraction trees at any depth, which of them are citations, and values without a page or quote."""
    return documents.fields(_trees(spark, d), "o_orderkey", "result")


@query("""SELECT o_orderkey, t AS canonical, sha256(t) AS hash FROM (SELECT o_orderkey, '{"fund":{"name":{"page":1,"quote":null,"value":"' || o_orderstatus || '"},"size":{"page":' || o_orderkey % 4 || ',"quote":"' || o_orderpriority || '","value":"' || o_custkey || '"}},"rows":['
        || array_to_string(list_transform(range(o_orderkey % 4)[1:3], lambda i: '{"a":[{"b":{"c":{"page":' || i + 1 || ',"quote":" q ","value":"' || i || '"}}}]}'), ',')
        || '],"team":{"head":{"page":null,"quote":null,"value":' || CASE WHEN o_orderkey % 2 = 0 THEN '"' || o_orderpriority || '"' ELSE 'null' END || '},"note":"five of them"}}' AS t FROM orders)""")
def canonical_json(spark, d):
    """Extraction trees with their keys in order, and the hash of that."""
    text = F.col("result")
    return _trees(spark, d).select("o_orderkey", documents.canonical_json(text).alias("canonical"), documents.content_hash(text).alias("hash"))


@query("""SELECT o_orderkey, p AS label, CASE WHEN p = 'note' OR (p = 'head' AND o_orderkey % 2 = 1) THEN 'NOT DISCLOSED'
        WHEN p = 'size' THEN CAST(o_custkey AS VARCHAR) WHEN p = 'name' THEN CASE WHEN o_orderstatus = 'O' THEN 'NO' ELSE o_orderstatus END ELSE o_orderpriority END AS stated
    FROM orders, (SELECT unnest(['size', 'note', 'head', 'name']) AS p)""")
def index_absences(spark, d):
    """Fixed paths of each tree, null or missing ones as not disclosed, and a plain no as NO."""
    said_no = F.replace("result", F.lit('"value":"O"'), F.lit('"value":"No "'))
    spec = (("size", "fund.size"), ("note", "fund.note"), ("head", "team.head"), ("name", "fund.name"))
    return documents.index_absences(_trees(spark, d).withColumn("result", said_no), "o_orderkey", "result", spec)


@query("""SELECT o_orderkey, 'size' AS label, CAST(o_custkey AS VARCHAR) AS stated FROM orders
    UNION ALL SELECT o_orderkey, 'head', o_orderpriority FROM orders WHERE o_orderkey % 2 = 0""")
def index_facts(spark, d):
    """What each tree states at fixed paths; what it doesn't state has no row."""
    return documents.index_facts(_trees(spark, d), "o_orderkey", "result", (("size", "fund.size"), ("head", "team.head"), ("note", "fund.note")))


@query("""WITH e AS (SELECT event_id AS key, event_id % 9 AS k FROM events)
    SELECT ['other_stage', 'other_version', 'result_missing', 'result_null', 'unresolved_missing', 'unresolved_no_list', 'citations_no_list', 'not_an_object'][k] AS gate, key FROM e WHERE k > 0""")
def envelope_violations(spark, d):
    """Events as envelopes of their stage, each kind of breach in turn."""
    head = lambda stage, version, rest: F.concat(F.lit('{"stage":"'), stage, F.lit(f'","schema_version":{version}{rest}}}'))
    kind, lists = F.col("event_type"), ',"unresolved":[],"citations":[]'
    ways = F.array(
        head(kind, 2, f',"result":{{"k":[]}}{lists}'), head(F.lit("none"), 2, f',"result":1{lists}'), head(kind, 1, f',"result":1{lists}'), head(kind, 2, lists),
        head(kind, 2, f',"result":null{lists}'), head(kind, 2, ',"result":1,"citations":[]'), head(kind, 2, ',"result":1,"unresolved":{}'),
        head(kind, 2, ',"result":1,"unresolved":[],"citations":"x"'), F.col("event_id").cast("string"),
    )
    made = table(spark, d, "events").select("event_id", "event_type", F.get(ways, (F.col("event_id") % 9).cast("int")).alias("text"))
    return gates.violations(made, "event_id", documents.envelope_gates(F.col("text"), F.col("event_type")))


def _attempts(spark, d):
    """Lines as attempts of calls: a part is a call, its supplier the model, a return flag the stage."""
    whole = lambda c: F.col(c).cast("long")
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("run"), F.col("l_returnflag").alias("stage"), F.col("l_partkey").alias("call_no"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("m"), (F.col("l_orderkey") % 4).cast("string")).alias("model"),
        F.col("l_extendedprice").alias("cost_usd"), whole("l_quantity").alias("tok_in"), F.when(F.col("l_linenumber") > 2, whole("l_quantity")).alias("tok_out"),
        F.col("l_linenumber").cast("long").alias("tok_cache_new"), (F.col("l_orderkey") % 5).alias("tok_cache_read"),
        F.col("l_quantity").alias("billable_s"), (F.col("l_discount") > 0.09).alias("fallback"),
    )


@query("""WITH a AS (SELECT l_suppkey % 20 AS run, l_returnflag AS stage, l_partkey AS call_no, l_orderkey * 10 + l_linenumber AS seq, 'm' || l_orderkey % 4 AS model,
        CAST(l_extendedprice AS DECIMAL(18, 4)) AS cost, CAST(l_quantity AS BIGINT) AS ti, CASE WHEN l_linenumber > 2 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS to_,
        l_linenumber AS tn, l_orderkey % 5 AS tr, l_discount > 0.09 AS fb FROM lineitem),
      s AS (SELECT run, stage, count(DISTINCT call_no) AS calls, count(*) AS attempts FROM a GROUP BY ALL),
      r AS (SELECT run, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(greatest(0, attempts - calls)) AS BIGINT) AS retries FROM s GROUP BY run),
      m AS (SELECT run, string_agg(model, '+' ORDER BY seen) AS models FROM (SELECT run, model, min(seq) AS seen FROM a GROUP BY ALL) GROUP BY run)
    SELECT r.*, models, cost, tok_in, tok_out, tok_cache_new, tok_cache_read, billable, fallback, tok_in + tok_out + tok_cache_new + tok_cache_read AS tokens,
        round(100.0 * tok_cache_read / (tok_cache_read + tok_cache_new + tok_in), 4) AS cache_share
    FROM (SELECT run, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(ti) AS BIGINT) AS tok_in, CAST(sum(to_) AS BIGINT) AS tok_out, CAST(sum(tn) AS BIGINT) AS tok_cache_new,
        CAST(sum(tr) AS BIGINT) AS tok_cache_read, CAST(sum(ti) AS DOUBLE) AS billable, bool_or(fb) AS fallback FROM a GROUP BY run) JOIN r USING (run) JOIN m USING (run)""")
def run_telemetry(spark, d):
    """Nine measures of each run, its models in the order in which they came, tokens and cache share."""
    return telemetry.totals(_attempts(spark, d), ["run"])


def _citations(spark, d):
    verified = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 300).alias("run"), F.col("l_linenumber").alias("page"), verified.alias("quote_verified"), "l_orderkey", "l_partkey"
    )


@query("""SELECT l_orderkey % 300 AS run, count(*) AS citations, count(DISTINCT l_linenumber) AS pages, count(*) FILTER (l_returnflag = 'R') AS verified,
    count(*) FILTER (l_returnflag = 'A') AS unverified FROM lineitem GROUP BY run""")
def citation_counts(spark, d):
    return telemetry.citation_tallies(_citations(spark, d), ["run"])


@query("""WITH c AS (SELECT l_orderkey % 300 AS run, l_linenumber AS page, l_partkey, row_number() OVER (PARTITION BY l_orderkey % 300, l_linenumber ORDER BY l_orderkey, l_partkey) AS r FROM lineitem)
    SELECT run, page, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY r) FILTER (r <= 6) AS claims FROM c GROUP BY run, page""")
def citations_by_page(spark, d):
    return telemetry.by_page(_citations(spark, d), ["run"], ["l_orderkey", "l_partkey"], "l_partkey")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'results' WHEN 1 THEN 'empty' ELSE 'unparseable' END AS state,
    CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END AS INT) AS n FROM orders""")
def parse_states(spark, d):
    """Result pages of three kinds, made of orders; a page that lacks its marker is not empty."""
    pages = F.array(F.concat(F.lit("<b>1 to 25 of "), F.col("o_custkey").cast("string"), F.lit(" Records</b>")), F.lit("No  record(s) available"), F.lit("<p>session expired</p>"))
    state = parse.parse_state(F.get(pages, (F.col("o_orderkey") % 3).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", state.alias("s")).select("o_orderkey", "s.*")


@query("""SELECT s_nationkey, 'N & ' || s_name AS name, CAST(s_suppkey AS VARCHAR) AS number FROM supplier WHERE s_suppkey % 4 <> 0""")
def html_cards(spark, d):
    """Cards of a register made of suppliers; one in four has no name."""
    field = lambda k, v: F.concat(F.lit(f'<div class="title"><span>{k}</span></div><div class="value x"><span>'), v, F.lit("</span></div>"))
    title = F.when(F.col("s_suppkey") % 4 != 0, field("<i>Name</i>", F.concat(F.lit("N &amp; "), "s_name"))).otherwise(F.lit(""))
    card = F.concat(F.lit('<div class="card-table-left a"><div>'), title, field("No.", F.col("s_suppkey").cast("string")), F.lit("</div> </div></div>"))
    rows = table(spark, d, "supplier").select("s_nationkey", F.explode(parse.cards(card)).alias("r"))
    return rows.select("s_nationkey", F.col("r")["Name"].alias("name"), F.try_element_at("r", F.lit("No.")).alias("number"))


@query("SELECT o_orderkey, o_orderpriority AS title, o_orderstatus AS state FROM orders WHERE o_orderkey % 3 <> 0")
def html_table_rows(spark, d):
    """Rows of a result table made of orders; a row with one filled cell isn't a record."""
    second = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).otherwise(F.lit("&nbsp;"))
    page = F.concat(F.lit("<table><tr><th>Title</th></tr><TR class=x><td><a href='#'>"), F.col("o_orderpriority"), F.lit("</a></td><td> "), second, F.lit("</td></TR></table>"))
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(parse.table_rows(page)).alias("r"))
    return rows.select("o_orderkey", F.col("r")[0].alias("title"), F.col("r")[1].alias("state"))


@query("""SELECT event_id, CASE WHEN event_id % 6 IN (1, 2, 4) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 6 IN (1, 2, 4) AS salvaged FROM events""")
def salvaged_json(spark, d):
    """Replies around events' JSON: fenced late and with another brace behind, in prose, bare, a list, fenced at the beginning, and a fenced list."""
    ways = F.array(
        F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone {not json}")), F.concat(F.lit("Result is "), "props", F.lit(" as asked")),
        F.col("props"), F.lit("[1, 2]"), F.concat(F.lit(" ```json\n"), "props", F.lit("\n```\nDone {not json}")),
        F.concat(F.lit("```\n[1]\n``` for "), "props"),
    )
    reply = parse.salvaged_json(F.get(ways, (F.col("event_id") % 6).cast("int")))
    return table(spark, d, "events").select("event_id", F.get_json_object(reply, "$.k").cast("long").alias("k"), reply.isNotNull().alias("salvaged"))


@query("""SELECT p_partkey, 'L' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') || 'MH2010PLC123456' AS number FROM part WHERE p_partkey % 2 = 0""")
def register_numbers(spark, d):
    """Company numbers in texts; one with a letter too many is none."""
    number = F.concat(F.lit("L"), F.lpad((F.col("p_partkey") % 100_000).cast("string"), 5, "0"), F.lit("MH2010PLC123456"))
    said = F.concat(F.lit("No. "), number, F.when(F.col("p_partkey") % 2 == 0, ", see ").otherwise("Q, see "), number, F.when(F.col("p_partkey") % 2 == 0, ".").otherwise("Q."))
    return table(spark, d, "part").select("p_partkey", F.explode(parse.identifiers(said)).alias("number"))


@query("""SELECT c_custkey, CASE WHEN n >= 1000000 THEN printf('%.2fM', n / 1000000.0) WHEN n >= 1000 THEN printf('%.1fk', n / 1000.0) ELSE CAST(n AS VARCHAR) END AS label
    FROM (SELECT c_custkey, c_custkey * c_custkey * 13 AS n FROM customer)""")
def token_labels(spark, d):
    n = F.col("c_custkey") * F.col("c_custkey") * 13
    return table(spark, d, "customer").select("c_custkey", parse.token_count(n).alias("label"))


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE lower(replace(c_name, 'Customer#', 'x')) = lower(replace(s_name, 'Supplier#', 'x')))")
def key_persons(spark, d):
    """Suppliers whose name, normalised, a customer bears: a semi join."""
    norm = lambda c: F.lower(F.regexp_replace(c, "(?i)(customer|supplier)#", "x"))
    others = table(spark, d, "customer").select(norm("c_name").alias("name"))
    return table(spark, d, "supplier").withColumn("name", norm("s_name")).join(others, "name", "left_semi").select("s_suppkey")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_filled FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def first_passed(spark, d):
    """The first record of each customer that fits, by one aggregation."""
    passed = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return passed.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_filled"))


@query("""SELECT o_orderkey, o_custkey, prev FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL""")
def re_ups(spark, d):
    """Orders with their customer's order before: predecessors are looked up by an equi-join on their id."""
    w = events.moves(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderkey", "o_orderdate").select("o_orderkey", F.col("from_state").alias("prev"))
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("prev"), "o_custkey")
    return w.filter("prev IS NOT NULL").join(known, "prev").select("o_orderkey", "o_custkey", "prev")


@query(f"WITH {_F} SELECT source, count(*) AS contested, min(doc_id) AS first_doc FROM f WHERE contested GROUP BY source")
def contested_memos(spark, d):
    return _findings(spark, d).filter("contested").groupBy("source").agg(F.count(F.lit(1)).alias("contested"), F.min("doc_id").alias("first_doc"))


@query("SELECT user_id, count(DISTINCT event_type) FILTER (event_type IN ('click', 'view', 'purchase')) = 3 AS complete FROM events GROUP BY user_id")
def stages_complete(spark, d):
    """Whether a user has all of three kinds of events: a subset test by counting what it has of them."""
    needed = ("click", "view", "purchase")
    have = F.countDistinct(F.when(F.col("event_type").isin(*needed), F.col("event_type")))
    return table(spark, d, "events").groupBy("user_id").agg((have == len(needed)).alias("complete"))


@query("""SELECT p_brand, l_shipdate_year, count(*) FILTER (l_returnflag = 'R') AS fired, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F' AND l_tax > 0.06) AS overridden,
    round(count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F' AND l_tax > 0.06) / nullif(count(*) FILTER (l_returnflag = 'R'), 0), 4) AS rate
    FROM (SELECT *, year(l_shipdate) AS l_shipdate_year FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def override_stats(spark, d):
    """Overrides over fires, by rule and year; no fire has no rate."""
    fired = F.col("l_returnflag") == "R"
    over = F.count_if(fired & (F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06))
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand", F.year("l_shipdate").alias("l_shipdate_year")).agg(
        F.count_if(fired).alias("fired"), over.alias("overridden"), F.round(F.try_divide(over, F.count_if(fired)), 4).alias("rate")
    )


@query("""SELECT c_mktsegment, count(*) AS decisions, count(*) FILTER (o_orderstatus = 'F') AS agreed, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 4) AS rate,
    max(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')) AS oldest_days FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def review_stats(spark, d):
    """Decisions of each segment, how many agree with the memo, and the age of the oldest."""
    agreed = F.col("o_orderstatus") == "F"
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(agreed).alias("agreed"), F.round(F.avg(agreed.cast("double")), 4).alias("rate"),
        F.max(F.datediff(F.lit("2002-01-01").cast("date"), "o_orderdate")).alias("oldest_days"),
    )


@query("""SELECT event_type, count(DISTINCT user_id) AS runs, count(*) AS questions, CAST(min(ts) AS VARCHAR) AS first_seen, CAST(max(ts) AS VARCHAR) AS last_seen
    FROM (SELECT event_type, user_id, date_trunc('second', ts) AS ts FROM events WHERE event_id % 3 = 0) GROUP BY event_type""")
def blocker_stats(spark, d):
    """Distinct runs and questions of each blocker, first and last seen."""
    e = table(spark, d, "events").filter("event_id % 3 = 0").withColumn("ts", F.date_trunc("second", "ts"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return e.groupBy("event_type").agg(
        F.countDistinct("user_id").alias("runs"), F.count(F.lit(1)).alias("questions"), at(F.min("ts")).alias("first_seen"), at(F.max("ts")).alias("last_seen")
    )


@query("""WITH q AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS closed, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS cost FROM lineitem GROUP BY 1)
    SELECT s_nationkey, round(avg(closed), 4) AS closed_avg, round(CAST(sum(cost) AS DOUBLE) / nullif(sum(closed), 0), 2) AS cost_per_closed
    FROM supplier JOIN q ON s_suppkey = l_suppkey GROUP BY s_nationkey""")
def evidence_effectiveness(spark, d):
    """Questions closed on average, and cost per closed question."""
    q = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("closed"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("cost")
    )
    joined = table(spark, d, "supplier").join(q, F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.groupBy("s_nationkey").agg(
        F.round(F.avg("closed"), 4).alias("closed_avg"), F.round(F.try_divide(F.sum("cost").cast("double"), F.sum("closed")), 2).alias("cost_per_closed")
    )


@query("""WITH e AS (SELECT event_id, user_id % 3 + 1 AS v, event_id % 5 AS k FROM events)
    SELECT event_id, 'type_unknown' AS gate, NULL AS path FROM e WHERE v = 3
    UNION ALL SELECT event_id, 'type', 'k' FROM e WHERE v < 3 AND k = 0 UNION ALL SELECT event_id, 'missing', 'k' FROM e WHERE v = 1 AND k = 1
    UNION ALL SELECT event_id, 'unexpected', 'z[].y' FROM e WHERE v = 1 AND k = 2 UNION ALL SELECT event_id, 'type', 'z[].y' FROM e WHERE v = 2 AND k = 2""")
def payload_violations(spark, d):
    """Events' JSON, some of it changed, against two versions of each type; a third isn't known."""
    e = table(spark, d, "events")
    types = e.select("event_type").distinct()
    rules = [(1, "k", "integer", True), (2, "k", "number", False), (2, "z[].y", "boolean", False), (2, "note", "text", False)]
    registry = types.join(spark.createDataFrame(rules, "event_version long, path string, type string, required boolean"))
    ways = F.array(F.lit('{"k":"x"}'), F.lit('{"k":null}'), F.lit('{"k":1,"z":[{"y":true},{"y":2}]}'), F.col("props"), F.col("props"))
    made = e.select("event_id", "event_type", (F.col("user_id") % 3 + 1).alias("event_version"), F.get(ways, (F.col("event_id") % 5).cast("int")).alias("payload"))
    return payloads.violations(made, registry)
