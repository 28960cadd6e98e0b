"""Near-duplicates, passages, nearest neighbours and components against brute force."""

import random
import re
import sys
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from verisift.llm import ann, near_dedup, pii, quality_rules, substring_dedup
from verisift.llm.components import connected_components
from verisift.llm.shingles import pieces, shingles, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keys string, rep long"
LOW = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "k", 0) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def sets(text, k):
    w = words(text)
    return frozenset([tuple(w)]) if 0 < len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(rows, k, percent=80):
    s = [(i, sets(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(s):
        for j, b in s[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def test_clashing_columns_pass_through(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(1, f"a b {passage}", "x", 1, "k"), (2, f"c {passage} d", "y", 2, "k"), (2, f"c {passage} d", "y", 2, "k"), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, spans int, _spans string").withColumns({"_t": F.lit(1), "base": F.lit(2), "component_id": F.lit(3)})
    for out in (substring_dedup.without_passages(docs), near_dedup.one_of_each(docs), pii.redacted(docs), quality_rules.remove_frequent_lines(docs, "_id")):
        assert out.columns == docs.columns
        assert {(r["_id"], r["spans"], r["component_id"]) for r in out.filter("doc_id <> 2").collect()} == {("x", 1, 3), (None, None, 3)}
    assert {r["text"] for r in substring_dedup.without_passages(docs).filter("doc_id = 2").collect()} == {"c  d"}


def near_copies(seed=3):
    draw = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  TWO"), (4, "one"), (5, " \n")]
    for g in range(12):
        base = [f"w{draw.randrange(4000)}" for _ in range(draw.choice([6, 12, 40, 300]))]
        for c in range(draw.choice([1, 2, 4, 15])):
            w = list(base)
            for _ in range(draw.randrange(1 + len(w) // 30)):
                w[draw.randrange(len(w))] = f"e{draw.randrange(9999)}"
            rows.append((100 + 40 * g + c, " ".join(w)))
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = near_copies()
    expected = components(rows, 4)
    out = near_dedup.near_duplicates(frame(spark, [*rows, rows[-1]]), k=4)
    assert out.count() == len(rows) + 1
    for r in out.collect():
        assert r["component_id"] == expected[r["doc_id"]], r
        assert r["n_shingles"] == len(sets(dict(rows)[r["doc_id"]], 4)) and r["kept"] == (r["doc_id"] == r["component_id"])


def test_copies_around_the_limit_are_linked_with_few_pairs(spark, monkeypatch):
    """Copies of one text, few of which are similar enough to each other: no link is lost, and few pairs are compared."""
    draw, compared = random.Random(3), []
    texts = []
    for i in range(150):
        words = [f"w{j}" for j in range(110)]
        for at in draw.sample(range(5, 105), draw.choice((2, 3, 3, 3))):
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in (t.split() for t in texts)]
    least = list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    measured = near_dedup.measured

    def counted(edges, *rest):
        compared.append(edges.count())
        return measured(edges, *rest)

    monkeypatch.setattr(near_dedup, "measured", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, k=4).collect()} == dict(enumerate(least))
    assert links and sum(compared) < 150 + 4 * len(links)


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = components([(r["doc_id"], r["text"]) for r in docs.collect()], 4)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, k=4).collect()} == expected
    kept = {r["doc_id"] for r in near_dedup.one_of_each(docs.union(docs)).collect()}
    assert near_dedup.one_of_each(docs.union(docs)).count() == len(kept)
    assert kept == {i for i, c in components([(r["doc_id"], r["text"]) for r in docs.collect()], 5).items() if i == c}
    assert near_dedup.near_duplicates(docs.filter("false")).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_do_not_depend_on_the_batch(monkeypatch):
    texts = ["A b\tc", "", None, "é x" * 50, "b", "long" * 40 + " end"]
    whole = [w.tolist() for w in word_hashes(texts)]
    assert whole[0][1] == whole[4][0] and len(whole[0]) == 3 and whole[1] == whole[2] == []
    assert [w.tolist() for t in texts for w in word_hashes([t])] == whole
    assert " ".join(pieces("ab cd ef gh", 3)) == "ab cd ef gh" and len(pieces("ab cd ef gh", 3)) > 1
    assert len(shingles(np.arange(3, dtype=np.uint64), 5, short=True)) == 1


def test_compact_windows_are_exact():
    draw = np.random.default_rng(5)
    g = draw.integers(0, 2**63, 300).astype(np.uint64)
    found = defaultdict(set)
    for t, f, _, l, r in zip(*substring_dedup.compact_windows([g[:19], g, g[40:200]], 20), strict=True):
        if t == 1:
            found[f].add((l, r))
        else:
            assert t == 2
    for f in range(substring_dedup.HASHES):
        h = substring_dedup.mixed(g ^ substring_dedup.SEEDS[f])
        expected = set()
        for c in range(len(h)):
            l, r = c, c
            while l > 0 and h[l - 1] > h[c]:
                l -= 1
            while r + 1 < len(h) and h[r + 1] > h[c]:
                r += 1
            if r - l + 1 >= 20:
                expected.add((l, r))
        assert found[f] == expected


def test_regions():
    assert substring_dedup.regions([(0, 0, 9), (1, 5, 20), (0, 15, 30)], 2) == [(5, 9), (15, 20)]
    assert substring_dedup.regions([(0, 0, 9), (0, 5, 20)], 2) == []


def test_passages_are_found_and_clean_texts_left(spark):
    draw = random.Random(8)
    text = lambda n: [f"v{draw.randrange(50_000)}" for _ in range(n)]
    passage, loose = text(60), text(120)
    edited = [w if i != 60 else "edit" for i, w in enumerate(loose)]
    rows = [(1, text(80) + passage + text(30)), (2, text(10) + passage), (3, text(200)), (4, loose + text(9)), (5, text(40) + edited), (6, text(30) + passage[:40])]
    rows = [(i, " ".join(w)) for i, w in rows] + [(7, None), (8, ""), (9, "short"), (None, rows and " ".join(passage))]
    docs = frame(spark, rows)
    out = substring_dedup.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["source_id"]) for r in out} == {(2, 1), (5, 4)}
    two = next(r for r in out if r["doc_id"] == 2)
    assert (two["start_word"], two["end_word"], two["source_start"], two["source_end"], two["similarity"]) == (10, 70, 80, 140, 1.0)
    five = next(r for r in out if r["doc_id"] == 5)
    assert (five["start_word"], five["end_word"]) == (40, 160) and five["similarity"] >= 0.8
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.without_passages(docs).collect()}
    assert cut[2] == " ".join(rows[1][1].split()[:10]) and cut[1] == rows[0][1] and cut[3] == rows[2][1] and 8 not in cut
    assert substring_dedup.repeated_passages(docs.filter("false")).count() == 0


def test_every_exact_passage_of_the_documents_is_covered(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found, seen = defaultdict(set), {}
    for r in substring_dedup.repeated_passages(docs).collect():
        found[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    missed = total = 0
    for r in docs.orderBy("doc_id").collect():
        w, own = words(r["text"]), set()
        for a in range(len(w) - 49):
            g = hash(tuple(w[a : a + 50]))
            if g in seen:
                total += 1
                missed += not found[r["doc_id"]].issuperset(range(a, a + 50))
            own.add(g)
        seen.update(dict.fromkeys(own))
    assert total > 500 and missed <= 0.005 * total


def test_passages_join_over_long_insertions():
    draw = np.random.default_rng(6)
    for head, tail in ((49, 49), (30, 60), (100, 20), (90, 90)):
        for n in range(7, 21):
            h, t, x = (draw.integers(0, 2**31, k).astype(np.uint64) for k in (head, tail, n))
            around = [draw.integers(0, 2**31, 30).astype(np.uint64) for _ in range(4)]
            a, b = shingles(np.concatenate([around[0], h, x, t, around[1]]), 5, short=False), shingles(np.concatenate([around[2], h, t, around[3]]), 5, short=False)
            score = (head + tail - 8) / (head + tail + n)  # of all shingles that are in one of both, those that are in both
            got = substring_dedup.passages(a, b)
            if score >= 0.8:
                assert [(s, e + 5) for s, e, *_ in got] == [(30, 30 + head + n + tail)], (head, tail, n)
                assert got[0][4] >= 0.8
            elif max(head, tail) >= 50:
                assert {i for s, e, *_ in got for i in range(s, e + 5)} >= {30 + i + (head + n) * (tail > head) for i in range(max(head, tail))}


def test_exact_passages_behind_crowded_hashes(spark):
    """The first documents of a passage's keys hold its phrases of the least hashes, but not the passage."""
    draw = random.Random(4)
    text = lambda n: [f"y{draw.randrange(50_000)}" for _ in range(n)]
    keys = lambda w: {(f, v) for _, f, v, *_ in zip(*substring_dedup.compact_windows([shingles(word_hashes([" ".join(w)])[0], 5, short=False)]), strict=True)}
    passage = text(50)

    def crowd():
        out = []
        for key in keys(passage):
            for i in range(46):
                near = [text(50) + passage[i : i + 5] + text(50) for _ in range(12)]
                if hit := [w for w in near if key in keys(w)]:
                    out += hit[0]
        return out

    rows = [(1, crowd()), (2, crowd()), (3, text(60) + passage + text(60)), (4, text(70) + passage + text(60)), (5, passage + text(60))]
    assert all(keys(passage) <= keys(w) for _, w in rows)
    out = substring_dedup.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    got = {(r["doc_id"], r["source_id"], r["start_word"], r["end_word"], r["similarity"]) for r in out}
    assert got == {(4, 3, 70, 120, 1.0), (5, 3, 0, 50, 1.0)}


def brute(rows, k=10):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 4]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            best = {}
            for i, y in good:
                if i != q:
                    best[i] = min(best.get(i, np.inf), float(np.sqrt(((x - y) ** 2).sum())))
            out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0, 0, 0]), (100, [1.0, 1, 0, 0]), (1, [1.0, 0, 0, 0]), (2, [1.0, 0, 0, 0]), (3, None), (4, [0.0] * 4), (5, [nan, 0, 0, 1]), (6, [inf, 0, 0, 1]), (7, [None, 1.0, 1, 1]), (8, [1.0]), (9, [0, 2.0, 0, 0]), (9, [0, 2.0, 0, 0])]
    rows = [(i, v and [None if c is None else float(c) for c in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'p' AS part", "1 AS id", "2 AS v")
    out = ann.search(df, F.col("id") % 100 == 0).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert dict(got) == brute(rows)
    assert ann.search(df.filter("false"), F.col("id") % 100 == 0).count() == 0


def test_neighbours_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in e.collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    hit = total = 0
    found = defaultdict(set)
    for r in ann.search(e, F.col("id") % 100 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        assert len(found[q]) == 10
        hit, total = hit + len(found[q].intersection(best)), total + 10
    assert hit / total >= 0.9


def test_parts_grow_with_the_vectors_and_recall_holds(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_PART", 200)
    draw = np.random.default_rng(5)
    centres = draw.normal(0, 1, (160, 24))
    assert [ann.parts_for(n) for n in (10, 4000, 12_000, 10**9)] == [16, 20, 60, 256]
    for n in (4000, 12_000):
        x = centres[draw.integers(0, len(centres), n)] + draw.normal(0, 0.25, (n, 24))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
        vectors, usable = ann.usable(df, "vec_id", "embedding")
        router, probes = ann.fit(vectors, 10, ann.parts_for(usable))
        assert usable == n and router.w[3].shape[0] == n // 200 and probes <= n // 200 // 3
        found = defaultdict(set)
        for r in ann.search(df, F.col("id") % 100 == 0).collect():
            found[r["query_id"]].add(r["vec_id"])
        hit = 0
        for q in range(0, n, 100):
            d = ((x - x[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            hit += len(found[q].intersection(np.argsort(d)[:10].tolist()))
        assert hit / (n // 10) >= 0.9


def test_members_of_stars_are_made_and_shuffled_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(900).selectExpr("id % 400 AS key", "id DIV 2 AS doc", "id AS w")
    out = substring_dedup.starred(rows.mapInArrow(counted, "key long, doc long, w long")).collect()
    assert {(r["key"], r["doc"], r["w"], r["source"], r["n"]) for r in out} == {
        (i % 400, i // 2, i, i % 400 // 2, 3 if i % 400 < 100 else 2) for i in range(400, 900)
    }
    assert made.value == 900


def test_similarity_is_that_of_the_sets_of_shingles():
    draw = np.random.default_rng(3)
    for names in (2**31, 40):  # without and with repeats
        for _ in range(60):
            a = draw.integers(0, names, 120)
            b = np.concatenate([draw.integers(0, names, 20), np.where(draw.random(120) < 0.05, -1, a), a[:30] if names == 40 else a[:0]])
            for s, e, c, d, score in substring_dedup.passages(a, b):
                mine, other = set(a[s : e + 1].tolist()), set(b[c : d + 1].tolist())
                assert score == len(mine & other) / len(mine | other)


def test_near_passages_behind_crowded_hashes(spark):
    """Pairs that share a passage of a similarity of 0.8 or more, most of it held by earlier documents too."""
    draw = random.Random(12)
    text = lambda n: [f"q{draw.randrange(90_000)}" for _ in range(n)]
    rows, pairs = [], []
    for p in range(60):
        size, at = draw.choice([(60, [30]), (60, [8]), (90, [40]), (120, [50, 80]), (200, [50, 100, 150])]), 1000 + 10 * p
        passage = text(size[0])
        edited = [w if i not in size[1] else f"e{p}" for i, w in enumerate(passage)]
        held = size[0] * 3 // 4
        for i, part in enumerate([passage[:held], passage[-held:], passage[:held], edited[:held]][: draw.choice([2, 3, 4])]):
            rows.append((at + i, text(30) + part + text(30)))
        rows += [(at + 5, text(40) + passage + text(20)), (at + 6, text(25) + edited + text(35))]
        pairs.append((at + 6, size[0]))
    rows += [(1, text(300)), (2, text(400))]
    found = defaultdict(set)
    for r in substring_dedup.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows])).collect():
        assert r["doc_id"] // 10 == r["source_id"] // 10 and r["similarity"] >= 0.8
        found[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    missed = [(size, len(found[doc])) for doc, size in pairs if len(found[doc] & set(range(25, 25 + size))) < 0.9 * size]
    assert len(missed) <= 1, missed


def test_regions_are_those_of_the_places():
    draw = np.random.default_rng(14)
    for n in (0, 1, 5, 30, 60):
        own, f, l = draw.integers(0, 3, n), draw.integers(0, substring_dedup.HASHES, n), draw.integers(0, 300, n)
        r = l + draw.integers(0, 50, n)
        for enough in (1, 2, 3):
            held = np.zeros((3, substring_dedup.HASHES, 400), dtype=bool)
            for i, x, a, b in zip(own, f, l, r, strict=True):
                held[i, x, a : b + 1] = True
            on = np.zeros((3, 402), dtype=int)
            on[:, 1:-1] = held.sum(axis=1) >= enough
            step = np.diff(on)
            expected = [(i, a, b - 1) for i in range(3) for a, b in zip(np.flatnonzero(step[i] == 1), np.flatnonzero(step[i] == -1), strict=True)]
            assert list(zip(*(x.tolist() for x in substring_dedup.overlaps(own, f, l, r, enough)), strict=True)) == expected


def test_scattered_hits_are_not_measured_one_by_one():
    """Short stretches of hits at one shift need no sets; the functions called are counted, as seconds depend on the machine."""
    a = np.arange(2000, dtype=np.int32)
    b = np.where(a % 12 < 8, a, -1 - a)
    source, calls = substring_dedup.Source(b), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = substring_dedup.passages(a, source)
    finally:
        sys.setprofile(None)
    assert not found
    assert calls < 20 * len(a) // 12
