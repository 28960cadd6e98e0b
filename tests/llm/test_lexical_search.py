"""Ranked lexical search against brute force and its SQL."""

import math
import random
import re
from collections import Counter

import pytest

from tests.oracle import assert_same, connect
from verisift.llm import lexical_search, queries
from verisift.llm.common import table

SF = "/root/testdata/sf0.001"
LOW = {c: c + 32 for c in range(65, 91)}
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain_search(docs, items, k):
    read = [(i, Counter(t)) for i, t in ((i, plain_terms(x)) for i, x in docs) if t]
    n_docs, length = len(read), sum(c.total() for _, c in read)
    df = Counter(t for _, c in read for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(plain_terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, c in read:
            m = 50 + 50 * c.total() * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


@pytest.mark.parametrize("exact, block, cells", [(100_000, 256, 1 << 20), (1, 3, 4000)])
def test_against_brute_force(spark, monkeypatch, exact, block, cells):
    monkeypatch.setattr(lexical_search, "EXACT", exact)
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    monkeypatch.setattr(lexical_search, "SAMPLE", 4)
    draw = random.Random(2)
    word = lambda: draw.choice(["Ab", "ñé", "x9"]) + str(int(draw.paretovariate(0.6)) % 400)
    docs = [(i, "; ".join(word() for _ in range(draw.randrange(60)))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, " .,;"), (None, docs[5][1]), (5, docs[5][1]), docs[5], (903, docs[5][1].upper()), (904, "ab1 " * 50_000), (None, "Ab3")]
    items = [(i, " ".join(word() for _ in range(draw.randrange(1, 30)))) for i in range(20)]
    items += [(50, None), (51, ""), (52, "--"), (53, "nowhere"), (None, "ab1"), (7, "ab2 ab3"), (54, docs[5][1]), (54, docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS score", "'x' AS item")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "'y' AS terms")
    for k in (3, 50):
        assert rows(lexical_search.search(d, i, k)) == plain_search(docs, items, k)


def test_whole_tables(spark):
    out = queries.op11_lexical_search(spark, SF)
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert rows(out) == plain_search(docs, items, 50)
    assert_same(out, connect(SF), queries.oracle_sql()["op11_lexical_search"])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rows(lexical_search.search(docs, items)) == plain_search([(1, "a b")], [(1, "a")], 50) != []
    assert lexical_search.search(docs.filter("false"), items).count() == 0
    assert lexical_search.search(docs, items.filter("false")).count() == 0
