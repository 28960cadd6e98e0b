"""SimHash against brute force: fingerprints, links of every kind of key, and whole documents."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from verisift.llm import simhash

LOW = {c: c + 32 for c in range(65, 91)}


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """The least of each print's component, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in prints:
        for y in prints:
            if x < y and (x ^ y).bit_count() <= 2:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {p: find(p) for p in prints}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def around(draw, centre, most, n):
    out = {centre}
    while len(out) < n:
        x = centre
        for _ in range(draw.randrange(1, most + 1)):
            x ^= 1 << draw.randrange(64)
        out.add(x)
    return out


@pytest.mark.parametrize("few", [512, 2])
def test_links_of_small_and_crowded_keys(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    draw = random.Random(5)
    prints = {0, (1 << 64) - 1, *around(draw, draw.getrandbits(64), 6, 300), *around(draw, draw.getrandbits(64), 3, 12)}
    half = draw.getrandbits(32) << 32  # equal upper halves, lower ones that differ in 1 to 8 bits
    prints |= {half | (p & 0xFFFFFFFF) for p in around(draw, half, 8, 80)}
    prints |= {draw.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    found = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {p: find(p) for p in prints} == components(prints)


def check(rows, out):
    prints = {t: plain_print(t) for _, t in rows}
    least = components(set(prints.values()))
    ids = {}
    for i, t in rows:
        if i is not None:
            ids[least[prints[t]]] = min(i, ids.get(least[prints[t]], i))
    expected = sorted(((i, f"{prints[t]:016x}", ids.get(least[prints[t]])) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()), key=str) == expected


def test_documents_and_odd_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(60_000))
    rows += [(10_001, None), (10_002, ""), (10_003, " \t\n"), (10_004, "One"), (10_005, "one"), (10_006, "ONE\x0btwo"), (10_007, "É é"), (None, "no id"), (None, "No Id")]
    rows += [(10_008, long), (10_009, long + " end"), rows[3], rows[3], (7, "another text of the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"print": F.lit("x"), "key": F.lit(1), "component_id": F.lit(2)})
    check(rows, simhash.near_duplicates(docs))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
