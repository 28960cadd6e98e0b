"""DuckDB SQL of the queries in registry.py."""

_FINDINGS = """
f AS (
  SELECT d.doc_id, source, ['VETO', 'RED_FLAG', 'GREEN_FLAG'][d.doc_id % 3 + 1] AS tier,
         CASE WHEN n_chars < 200 THEN 'LOW' WHEN n_chars < 1000 THEN 'MEDIUM' WHEN n_chars < 4000 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
         CASE WHEN quality IS NULL THEN NULL ELSE toxic = 1 END AS fired,
         CASE WHEN quality IS NULL THEN CASE WHEN d.doc_id % 3 = 0 THEN 'veto_unevaluated' ELSE 'unevaluated' END
              WHEN (quality = 1) <> (toxic = 1) THEN 'contested' WHEN toxic = 1 THEN 'fired' ELSE 'not_fired' END AS status,
         quality IS NOT NULL AND (quality = 1) <> (toxic = 1) AS contested,
         CASE WHEN quality IS NOT NULL AND (quality = 1) = (toxic = 1) THEN 'high' ELSE 'low' END AS confidence
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
w AS (SELECT *, CAST(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 5 END AS DOUBLE) AS effective_weight FROM f)"""
_RECOMMEND = """
SELECT *, CASE WHEN vetoes_decisive > 0 THEN 'pass'
               WHEN vetoes_downgraded > 0 OR (red_weight >= 9 AND red_weight > 2 * green_weight) THEN 'hold'
               WHEN red_fired > 0 THEN 'pursue_with_questions' ELSE 'pursue' END AS recommendation
FROM (
  SELECT source, sum(CASE WHEN tier = 'RED_FLAG' AND fired THEN effective_weight ELSE 0 END) AS red_weight,
         sum(CASE WHEN tier = 'GREEN_FLAG' AND fired THEN effective_weight ELSE 0 END) AS green_weight,
         count(*) FILTER (tier = 'VETO' AND fired AND NOT contested AND confidence <> 'low') AS vetoes_decisive,
         count(*) FILTER (tier = 'VETO' AND fired AND (contested OR confidence = 'low')) AS vetoes_downgraded,
         count(*) FILTER (tier = 'RED_FLAG' AND fired) AS red_fired, count(*) FILTER (contested) AS contested_n,
         count(*) FILTER (fired IS NULL) AS unevaluated_n
  FROM w GROUP BY source)"""
_CANON = "lower(trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"
_NUMBERS = (
    "list_distinct(regexp_extract_all(regexp_replace(coalesce(text, ''), "
    "'(?im)^#{1,6}\\s*[0-9]+\\.?\\s|^\\s*[0-9]+\\.\\s|\\bp\\.\\s*[0-9]+|\\bpage\\s+[0-9]+|\\bpp\\.\\s*[0-9]+|\\bCR-[0-9]+|\\bsection\\s+[0-9]+|\\[[0-9]+\\]', ' ', 'g'), "
    "'[0-9][0-9,]*(?:\\.[0-9]+)?'))"
)
_BARE = (
    "trim(regexp_replace(replace(replace(regexp_replace(regexp_replace({}, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), "
    "'(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
)
_PLAIN_URL = "regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://(www\\.)?', ''), '/+$', '')"
_MOVES = """
m AS (
  SELECT *, lag(o_orderstatus) OVER w AS from_state, o_orderstatus AS to_state,
         date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS days
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
_DELTA = """
l AS (
  SELECT event_id % 2 AS half, user_id || '/' || event_type AS finding,
         CASE WHEN count(*) >= 4 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS state
  FROM events GROUP BY event_id % 2, user_id, event_type HAVING count(*) >= 2),
dl AS (
  SELECT coalesce(o.finding, n.finding) AS finding, coalesce(o.state, 'ABSENT') AS old_state, coalesce(n.state, 'ABSENT') AS new_state
  FROM (SELECT * FROM l WHERE half = 0) o FULL JOIN (SELECT * FROM l WHERE half = 1) n ON o.finding = n.finding),
dc AS (
  SELECT *, CASE WHEN old_state = new_state THEN 'unchanged' WHEN old_state = 'ABSENT' THEN 'added'
                 WHEN new_state = 'ABSENT' THEN 'removed' ELSE 'changed' END AS change FROM dl)"""

ORACLES = {
    "scorecard_status": f"WITH {_FINDINGS} SELECT * REPLACE (CAST(fired AS VARCHAR) AS fired), CASE WHEN fired THEN effective_weight ELSE 0.0 END AS score_contribution FROM w",
    "source_recommendation": f"WITH {_FINDINGS} {_RECOMMEND}",
    "blocked_recommendation": f"""WITH {_FINDINGS.replace("FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND lang <> 'de'")} {_RECOMMEND}""",
    "agreement_rate": f"""WITH {_FINDINGS} SELECT count(*) AS n, count(*) FILTER (NOT contested AND fired IS NOT NULL) AS agreed,
        round(count(*) FILTER (NOT contested AND fired IS NOT NULL) / greatest(1, count(*)), 3) AS rate FROM f""",
    "status_tally": f"""WITH {_FINDINGS} SELECT t AS tier, s AS status, count(f.doc_id) AS n
        FROM (SELECT unnest(['VETO', 'RED_FLAG', 'GREEN_FLAG']) AS t) CROSS JOIN
             (SELECT unnest(['fired', 'not_fired', 'contested', 'unevaluated', 'veto_unevaluated']) AS s)
        LEFT JOIN f ON f.tier = t AND f.status = s GROUP BY t, s""",
    "quote_exact": f"""SELECT item_id AS quote_id, doc_id AS page_id FROM documents d JOIN benchmark b
        ON contains({_CANON.format("d.text")}, {_CANON.format("b.text")})""",
    "numeric_untraceable": f"""WITH n AS (SELECT doc_id, unnest({_NUMBERS}) AS number FROM documents),
        c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(number, ',', ''), '^0+([0-9])', '\\1'), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS canonical FROM n)
        SELECT doc_id, number FROM c WHERE doc_id % 2 = 1 AND NOT (regexp_full_match(canonical, '[0-9]{{1,3}}') AND coalesce(TRY_CAST(canonical AS INT), 999) <= 100)
        AND canonical NOT IN (SELECT canonical FROM c WHERE doc_id % 2 = 0)""",
    "content_duplicates": """WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents)
        SELECT doc_id, original, hash FROM (SELECT *, min(doc_id) OVER (PARTITION BY hash) AS original FROM h) WHERE doc_id <> original""",
    "unlabelled_docs": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "gate_violations": """SELECT 'text_missing' AS gate, doc_id AS key FROM documents WHERE text IS NULL OR trim(text) = ''
        UNION ALL SELECT 'length_wrong', doc_id FROM documents WHERE n_chars <> length(text)
        UNION ALL SELECT 'lang_unknown', doc_id FROM documents WHERE lang NOT IN ('en', 'de', 'fr', 'es')
        UNION ALL SELECT 'too_short', doc_id FROM documents WHERE length(trim(text)) < 20
        UNION ALL SELECT 'shouting', doc_id FROM documents WHERE length(regexp_replace(text, '[^A-Z]', '', 'g')) * 2 > n_chars""",
    "tag_strip": f"SELECT page_id, length({_BARE.format('html')}) AS n_chars, md5({_BARE.format('html')}) AS text_md5 FROM pages",
    "link_rows": f"""WITH i AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>.*?</li>') AS x FROM pages),
        r AS (SELECT page_id, p - 1 AS pos, x[p] AS item FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS p FROM i))
        SELECT * FROM (SELECT page_id, pos, regexp_extract(item, 'href="([^"]*)"', 1) AS href, {_BARE.format("item")} AS label FROM r)
        WHERE href <> '' AND label <> ''""",
    "domain_normalise": f"""SELECT regexp_extract(regexp_replace(lower(trim(url)), '^[a-z]+://(www\\.)?', ''), '^([^/?#:]*)', 1) AS domain,
        count(*) AS pages, count(DISTINCT {_PLAIN_URL}) AS urls FROM pages GROUP BY 1""",
    "first_verdict": """SELECT event_id, user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) = 1""",
    "idempotent_log": """SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_min(event_id, (ts, event_id)) AS event_id, count(*) - 1 AS dropped
        FROM events GROUP BY ALL""",
    "stage_fold": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
        SELECT event_type, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS cost, CAST(sum(k) AS BIGINT) AS tokens,
        count(DISTINCT user_id) AS users, first(k ORDER BY ts, event_id) AS first_k, last(k ORDER BY ts, event_id) AS last_k,
        bool_or(value > 99) AS fallback FROM e GROUP BY event_type""",
    "run_totals": """SELECT CAST(sum(a) AS BIGINT) AS attempts, CAST(sum(c) AS BIGINT) AS calls, CAST(sum(greatest(0, a - c)) AS BIGINT) AS retries
        FROM (SELECT count(*) AS a, count(DISTINCT user_id) AS c FROM events GROUP BY event_type)""",
    "retry_histogram": "SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, reason LIMIT 20",
    "outcome_counts": "SELECT o AS outcome, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS o) LEFT JOIN orders ON o_orderstatus = o GROUP BY o",
    "transition_matrix": f"WITH {_MOVES} SELECT from_state, to_state, count(*) AS n FROM m GROUP BY ALL",
    "illegal_transitions": f"""WITH {_MOVES} SELECT o_orderkey, o_custkey, from_state, to_state FROM m
        WHERE from_state IS NOT NULL AND from_state || to_state NOT IN ('OO', 'OP', 'PP', 'PF', 'FF')""",
    "cycle_time": f"""WITH {_MOVES} SELECT from_state, count(*) AS n, CAST(sum(days) AS BIGINT) AS days_total, quantile_cont(days, 0.5) AS median,
        quantile_cont(days, 0.9) AS p90 FROM m WHERE days IS NOT NULL GROUP BY from_state""",
    "current_version": """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "cumulative_cost": """SELECT o_orderkey, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER
        (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent FROM orders""",
    "projection_fold": """SELECT user_id, last(value ORDER BY ts, event_id) FILTER (event_id % 2 = 0) AS value,
        last(CAST(json_extract_string(props, '$.k') AS BIGINT) ORDER BY ts, event_id) FILTER (event_id % 2 = 1) AS k FROM events GROUP BY user_id""",
    "version_delta": f"WITH {_DELTA} SELECT * FROM dc",
    "delta_summary": f"WITH {_DELTA} SELECT change, old_state, new_state, count(*) AS n FROM dc GROUP BY ALL",
    "queue_head": "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1",
    "board_top_n": """SELECT o_orderpriority, row_number() OVER w AS rank, o_orderkey FROM orders
        WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) QUALIFY row_number() OVER w <= 5""",
    "pass_reason_share": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share
        FROM lineitem GROUP BY ALL""",
    "intake_daily": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS taken, count(*) FILTER (event_type = 'error') AS failed,
        count(DISTINCT user_id) AS users FROM events GROUP BY 1""",
    "throughput_daily": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS cost,
        max(value) AS most FROM events GROUP BY ALL""",
    "triage_funnel": """SELECT n_name, count(*) AS entered, count(*) FILTER (years >= 3) AS advanced, round(count(*) FILTER (years >= 3) / count(*), 4) AS rate
        FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY 1) ON c_custkey = o_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "name_overlap": """WITH n AS (SELECT DISTINCT p_brand, lower(p_name || ' ' || p_type) AS name, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part)
        SELECT a.p_brand, a.name, b.name AS other, round(len(list_intersect(a.w, b.w)) / greatest(1, least(len(a.w), len(b.w))), 3) AS overlap
        FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.name < b.name
        WHERE len(list_intersect(a.w, b.w)) / greatest(1, least(len(a.w), len(b.w))) >= 0.6""",
    "company_names": "SELECT s_suppkey, upper(replace(s_name, '#', '-')) AS slug FROM supplier",
    "range_match": """SELECT c_custkey, CASE WHEN filed IS NULL THEN 'not_filed' WHEN c_acctbal * 100 < 0.4 * filed THEN 'below'
        WHEN c_acctbal * 100 > 2.5 * filed THEN 'above' ELSE 'match' END AS band
        FROM customer LEFT JOIN (SELECT o_custkey, round(avg(o_totalprice), 2) AS filed FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "date_parse": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 3 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS parsed
        FROM orders""",
    "elapsed_months": "SELECT o_orderkey, date_diff('month', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS months FROM orders",
    "rank_fusion": """WITH d AS (SELECT doc_id, source, n_chars, len(string_split(text, chr(10))) AS lines FROM documents),
        r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM d
              UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY lines DESC, doc_id) FROM d)
        SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM r WHERE rank <= 50 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""",
    "inputs_hash": """WITH b AS (SELECT source, doc_id // 10000 AS block, sha256(string_agg(x, '|' ORDER BY x)) AS x
            FROM (SELECT source, doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') || ':' || sha256(text) AS x FROM documents) GROUP BY ALL),
        c AS (SELECT source, lpad(CAST(block AS VARCHAR), 12, '0') || ':' || x AS x FROM b)
        SELECT source, sha256(string_agg(x, '|' ORDER BY x)) AS digest FROM c GROUP BY source""",
    "quote_layout": rf"""WITH RECURSIVE q AS (SELECT item_id, c, regexp_extract_all(c, '[a-z0-9]+(?:[.,%/''-][a-z0-9]+)*|[%₹$]') AS t
            FROM (SELECT item_id, {_CANON.format("array_to_string(list_concat(string_split(text, ' ')[1:4], string_split(text, ' ')[8:]), ' ')")} AS c FROM benchmark)),
        p AS (SELECT doc_id, {_CANON.format("text")} AS c FROM documents),
        r AS (SELECT item_id, doc_id, 0 AS i, CAST(1 AS BIGINT) AS pos FROM q, p WHERE len(t) >= 6
              UNION ALL
              SELECT item_id, doc_id, i + 1, pos + g - 1 + length(w)
              FROM (SELECT r.item_id, r.doc_id, i, pos, t[i + 1] AS w, instr(substr(p.c, pos), t[i + 1]) AS g
                    FROM r JOIN q ON r.item_id = q.item_id JOIN p ON r.doc_id = p.doc_id WHERE i < len(t))
              WHERE g > 0 AND (i = 0 OR g - 1 <= 1200))
        SELECT r.item_id AS quote_id, r.doc_id AS page_id, CASE WHEN contains(p.c, q.c) THEN 'exact' ELSE 'layout' END AS verification
        FROM r JOIN q ON r.item_id = q.item_id JOIN p ON r.doc_id = p.doc_id WHERE i = len(t)
        UNION SELECT q.item_id, p.doc_id, 'exact' FROM q, p WHERE len(t) < 6 AND q.c <> '' AND contains(p.c, q.c)""",
    "returned_only": """SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'
        EXCEPT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45""",
    "citation_tallies": """SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles,
        count(*) FILTER (role <> 'system' AND regexp_matches(text, '[0-9]')) AS with_figure,
        count(*) FILTER (role <> 'system' AND NOT regexp_matches(text, '[0-9]')) AS without FROM conversations GROUP BY conv_id""",
    "manager_book": """SELECT r_name, count(*) AS suppliers, CAST(sum(CAST(s_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS balance,
        CAST(round(sum(revenue), 2) AS DOUBLE) AS revenue
        FROM supplier LEFT JOIN (SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS revenue
                                 FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "kind_status_counts": """WITH x AS (SELECT lang, CASE WHEN quality IS NULL THEN 'open' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS status
        FROM documents LEFT JOIN labels USING (doc_id))
        SELECT coalesce(lang, 'all') AS lang, coalesce(status, 'all') AS status, count(*) AS n FROM x GROUP BY CUBE (lang, status)""",
    "open_items": "SELECT event_type, dayofweek(ts) + 1 AS stage, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY ALL",
    "budget_spend": """SELECT * FROM (SELECT o_orderkey, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER
        (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent FROM orders) WHERE spent <= 1000000""",
    "retry_policy": """SELECT event_id, user_id, attempt, CASE WHEN attempt <= 3 THEN [2, 8, 32][attempt] ELSE 0 END AS wait_minutes,
        CASE WHEN attempt <= 3 THEN 'retry' ELSE 'failed' END AS outcome
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')""",
    "retry_reasons": """SELECT ['timeout', 'timeout', 'invalid_json_output', 'missing_structured_output', 'unparseable_tool_call', 'overloaded', 'rate_limit',
        'rate_limit', 'connection_reset', 'nonzero_exit', 'unknown'][CAST(json_extract_string(props, '$.k') AS BIGINT) % 11 + 1] AS reason, count(*) AS n
        FROM events GROUP BY 1""",
    "extraction_methods": """SELECT conv_id, blank, pages, CASE WHEN blank = 0 THEN 'text_layer' WHEN blank = pages THEN 'ocr' ELSE 'mixed' END AS method
        FROM (SELECT conv_id, count(*) FILTER (NOT regexp_matches(text, '[0-9]')) AS blank, count(*) AS pages FROM conversations GROUP BY conv_id)""",
    "evidence_equality": """WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
        a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'),
        b AS (SELECT coalesce(r.l_suppkey, a.l_suppkey) AS l_suppkey, a.l_partkey IS NULL AS x, r.l_partkey IS NULL AS y
              FROM r FULL JOIN a ON r.l_suppkey = a.l_suppkey AND r.l_partkey = a.l_partkey)
        SELECT l_suppkey, count(*) FILTER (x) AS only_a, count(*) FILTER (y) AS only_b, count(*) FILTER (x OR y) = 0 AS equal FROM b GROUP BY l_suppkey""",
    "criterion_hits": """SELECT p_brand, count(l_orderkey) AS evaluated, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) AS fired,
        round(count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) / greatest(1, count(l_orderkey)), 4) AS rate,
        CAST(count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) = 0 AS INT) AS dead
        FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_brand""",
    "question_routing": """SELECT CASE WHEN c_acctbal < 0 THEN 'blocked' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent'
        WHEN o_totalprice > 300000 THEN 'analyst' ELSE 'document' END AS kind, count(*) AS n, count(DISTINCT o_custkey) AS customers
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1""",
}
