"""DuckDB SQL for the operators that SQL can express."""

from verisift.llm.url_filters import HOST_RULES, PATTERNS, regex_of

WORD = r"[^\x20\x09-\x0D]+"

#: The line limits are those of quality_rules: 20 documents, 0.2 % of the host, 30 % of the words left.
OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents),
win AS (
  SELECT row, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT row, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (
  SELECT row, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (row, g)) GROUP BY row),
raw AS (SELECT row, doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT row, doc_id, host, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS norm,
         len(regexp_extract_all(line, '{WORD}')) AS words
  FROM raw WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY row),
hosts AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY host),
frequent AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS c FROM lines GROUP BY ALL) JOIN hosts USING (host)
  WHERE c > 20 AND c > n * 0.002),
gone AS (SELECT row, sum(words) AS n_removed_words FROM lines JOIN frequent USING (host, norm) GROUP BY row),
base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN dup USING (row) LEFT JOIN rep USING (row) LEFT JOIN gone USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_removed_words,
       n_words - n_removed_words < 0.3 * n_words AS depleted,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - n_removed_words < 0.3 * n_words) AS kept
FROM base
"""

_FITS = "\n".join(
    f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{v}}}'"
    for v, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
)
_RULE = "\n".join(x.replace("{allow}", h + p).replace("{block}", h + p) for x, (_, h, p) in zip(_FITS.split("\n"), sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2])), strict=True))
_VERDICT = _FITS.replace("{allow}", "allow").replace("{block}", "block")
_MATCHES = ",\n".join(f"    CASE WHEN regexp_matches(u, '{regex_of(p)}') THEN '{i}' END" for i, _, p in PATTERNS)
_ALLOWED = " OR ".join(f"regexp_matches(u, '{regex_of(p)}')" for _, how, p in PATTERNS if how == "allow")

OP8 = f"""
WITH u AS (
  SELECT page_id, lower(coalesce(url, '')) AS u,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
m AS (
  SELECT *, list_sort(list_filter([
{_MATCHES}], lambda x: x IS NOT NULL)) AS hit, {_ALLOWED} AS allowed
  FROM u)
SELECT page_id, host, path, CASE
{_RULE}
    END AS rule,
  coalesce(CASE
{_VERDICT}
    END, CASE WHEN len(hit) > 0 AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict,
  array_to_string(hit, ',') AS patterns
FROM m
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = rf"""
WITH words AS (
  SELECT *, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
d AS (SELECT row, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM words WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d),
tfs AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY ALL),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
  FROM benchmark),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, total WHERE term IN (SELECT term FROM wanted) GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN d USING (row), total GROUP BY item_id, doc_id, row),
best AS (
  SELECT item_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 50
"""

#: Candidates of at least 100 occurrences and 2 to 5 words, and the first 2000 of a language.
OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m))),
f AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
inner_ AS (
  SELECT DISTINCT c.lang, array_to_string(c.w[i:i + k - 1], ' ') AS phrase, c.a
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM cand, (SELECT unnest([2, 3, 4]) AS k) WHERE k < m) c),
kept AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 100 * c.a)),
cuts AS (
  SELECT kept.lang, kept.phrase, a, k, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, kept.m)) AS k FROM kept) kept
  JOIN total USING (lang)
  JOIN f l ON l.lang = kept.lang AND l.phrase = array_to_string(kept.w[1:k], ' ')
  JOIN f r ON r.lang = kept.lang AND r.phrase = array_to_string(kept.w[k + 1:kept.m], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

ORACLES = {"op1_quality_rules": OP1, "op8_url_filters": OP8, "op11_lexical_search": OP11, "op13_collocations": OP13}
