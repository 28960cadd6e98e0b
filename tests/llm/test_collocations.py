"""Phrase collocations against brute force and SQL, in few rounds and in many."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.oracle import assert_same, connect
from verisift.llm import collocations, queries

LOW = {c: c + 32 for c in range(65, 91)}


def plain(rows, often, longest, first):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= often}
        gone = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= own[p[i:j]]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                s, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:first], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus():
    draw = random.Random(4)
    word = lambda lang: f"{lang}{int(draw.paretovariate(0.7)) % 90}"
    rows = []
    for lang in ("En", "é", None):
        fixed = [[word(lang) for _ in range(draw.choice([2, 3, 5, 9]))] for _ in range(12)]
        for _ in range(90):
            w = []
            for _ in range(draw.randrange(25)):
                w += draw.choice(fixed) if draw.random() < 0.3 else [word(lang) + draw.choice(["", "", "", ".", ",\t", "\n"])]
            rows.append((draw.choice([" ", "  ", "\t"]).join(w), lang))
    return rows + [(None, "En"), ("", "En"), (" ,.; ", "x"), ("once only", "rare"), ("na na na na NA Na", "En"), *rows[:2], ("Ab cD " * 30_000, "long"), ("y" * 5000, "long")]


@pytest.mark.parametrize("first, nodes, least, sizes", [(2000, 1 << 18, 1 << 22, (1 << 21, 64)), (5, 300, 250, (300, 50))])
def test_against_brute_force(spark, monkeypatch, first, nodes, least, sizes):
    for name, value in (("OFTEN", 6), ("FIRST", first), ("NODES", nodes), ("LEAST", least), ("BYTES", sizes[0]), ("WORDS", sizes[1])):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS key", "'k' AS words", "2 AS n")
    assert found(collocations.collocations(df)) == plain(rows, 6, 5, first)


def test_keys_of_two_phrases_are_told_and_done_again(spark, monkeypatch):
    """What the last pass says of the first seed is taken as a clash."""
    monkeypatch.setattr(collocations, "OFTEN", 3)
    rows = [(f"{'a' * 10} b1 {'c' * 10} b2", "en")] * 4
    seeds, texts = [], collocations.phrase_texts

    def watched(read, named, seed):
        seeds.append(seed)
        out = texts(read, named, seed)
        return out.withColumn("several", out["several"] | (out["n"] > 0)) if seed == 0 else out

    monkeypatch.setattr(collocations, "phrase_texts", watched)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert found(collocations.collocations(df)) == plain(rows, 3, 5, 2000) and seeds == [0, 1]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(queries.op13_collocations(spark, sf), connect(sf), queries.oracle_sql()["op13_collocations"])


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
