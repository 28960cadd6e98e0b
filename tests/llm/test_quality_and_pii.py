"""Quality rules and personal data against plain Python, and their edge cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisift.llm import boosting, pii, quality_rules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, host string, words int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {g for g in windows if windows.count(g) > 1}
    covered = {p for i, g in enumerate(windows) if g in seen for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


EDGES = [None, "", " \n\t ", "one", "a b c d e a b c d e", "x\nx\n x\n\nx", "é# | <b> ü$", "w " * 500, "long" * 5000, "a b c d e f " * 3]


def test_base_counts(spark):
    texts = EDGES + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = [(i, t, None if i % 3 else "h", "x", 1) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in quality_rules.quality(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(t), t
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])


def test_frequent_lines_are_counted_per_host(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    rows = [(i, f"Share  this PAGE now\n{own(i)}", "a", "x", 1) for i in range(30)]
    rows += [(100 + i, f"share this page now\n{own(i)}", "b", "x", 1) for i in range(5)]
    rows += [(200, "share this page now\n" * 8, "a", "x", 1), (0, rows[0][1], "a", "x", 1), (300, None, None, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = quality_rules.quality(docs)
    got = {(r["doc_id"]): r for r in out.collect()}
    assert out.count() == len(rows)
    assert all(got[i]["n_removed_words"] == 4 and got[i]["kept"] for i in range(30))
    assert all(got[100 + i]["n_removed_words"] == 0 for i in range(5))
    assert got[200]["depleted"] and not got[200]["kept"] and not got[300]["kept"]
    cut = {r["doc_id"]: r["text"] for r in quality_rules.remove_frequent_lines(docs).collect()}
    assert cut[3] == own(3) and cut[101].startswith("share") and cut[300] is None


def test_repeated_rows_count_as_one_document(spark):
    own = "a line that only this document has and that twelve words make up"
    rows = [(1, own, "a", "x", 1)] * 25 + [(2, f"{own} too", "a", "x", 1)]
    out = quality_rules.quality(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 26 and all(r["kept"] and r["n_removed_words"] == 0 for r in out)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert quality_rules.quality(none).count() == 0
    assert pii.digest(none).count() == 0 and pii.redacted(none).columns == none.columns


RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in RULES for m in re.finditer(p, text or "") if ok(m.group())]


HARD = [
    None, "", "é a.b@c.de_f@g.hi x@y.z.. @@ q@", "a@b..c@d.e", "1.2.3.4.5 999.1.1.1 0001.02.003.255 1.2.3.256", "4111 1111-1111 1111 and 4111111111111112",
    "4111  1111 1111 1111", "+1 (222) 333-4444 +49.30.1234567. ++12 +1 2", "x" * 30000 + "@a.b", "1" * 30000, "1 2 " * 9000, "a@b" + ".c" * 20000, "+1 (736) 555-3296 452413226465",
]


def test_base_spans(spark):
    texts = HARD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text rlike '[0-9@]'").collect()]
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in enumerate(texts)], DOCS)
    for r in pii.digest(docs).collect():
        expected = spans(texts[r["doc_id"]])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in expected)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), (texts[r["doc_id"]] or "")[:80]
        assert [r[f"n_{k}"] for k, *_ in RULES] == [sum(s[0] == k for s in expected) for k, *_ in RULES]
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))


def test_model_adds_what_a_greedy_pattern_dropped(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = docs.unionByName(docs.limit(1).select(F.lit(-5).cast("long").alias("doc_id"), F.lit("call me +1 (736) 555-3296 452413226465 ok").alias("text"), "lang", "source", "n_chars"))
    assert pii.digest(more).filter("doc_id = -5").first()["spans"] == "phone:8:25"
    out = pii.redacted(more).filter("doc_id = -5").first()
    assert out["text"] == "call me [PHONE] 452413226465 ok"


def test_boosted_column_equals_score(spark):
    draw = np.random.default_rng(1)
    x = draw.integers(0, 6, (400, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    model = boosting.Boosted(rounds=8).fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    assert [r[0] for r in df.select(model.column(F.col("x"))).collect()] == pytest.approx(model.score(x).tolist())


def test_secrets_are_found_and_clean_texts_left(spark):
    """Documents that name a token lose it to a span, texts without personal data or secrets have none."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 20 = 0 OR text RLIKE '(?i)token = '").select("doc_id", "text")
    plain = "abcdef0123456789abcdef0123456789abcdef01"
    more = spark.createDataFrame([(10_000_000, f"the value {plain} stands here without a name"), (10_000_001, "no such thing, only long-hyphenated-compound-words here")], docs.schema)
    out = {r["doc_id"]: r for r in pii.digest(docs.unionByName(more)).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    named = [i for i, t in texts.items() if re.search(r'(?i)token = "[0-9a-f]{40}"', t)]
    assert len(named) > 5 and sum("secret:" in out[i]["spans"] for i in named) >= 0.8 * len(named)
    assert out[10_000_000]["spans"] == f"secret:10:{10 + len(plain)}" and out[10_000_001]["n_spans"] == 0
    clean = [i for i, t in texts.items() if not re.search(r"[0-9@]", t)]
    assert clean and all(out[i]["n_spans"] == 0 for i in clean)


def test_quality_and_its_sql_on_repeated_rows_and_null_ids(spark):
    import duckdb

    from tests.oracle import assert_same
    from verisift.llm.oracles import ORACLES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    lines = [(5000 + i % 40, f"the same line of words {i % 2}\nown words of number {i} and some more of them here", "host") for i in range(90)]
    odd = spark.createDataFrame([*lines, (None, "a line without an id", "host"), (None, None, None), (6000, "", "host")], docs.schema)
    rows = docs.unionByName(docs.limit(50)).unionByName(odd).cache()
    con = duckdb.connect()
    con.register("documents", rows.toArrow())
    assert_same(quality_rules.quality(rows), con, ORACLES["op1_quality_rules"])
    rows.unpersist()
