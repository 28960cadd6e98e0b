"""Phrase collocations of each language, by best-first branch and bound over phrase prefixes.

The tree's nodes are phrases, and a node's children are the phrases with one word more. A
node is expanded by one pass over the texts that counts what follows it. Whatever grows
from a phrase that begins with a word of f occurrences scores 1000 * n / f at most, as its
rest occurs at least as often as the whole: so the count of the first word bounds the score
of all that is below it. Each round expands the nodes of the best bounds, of which a round
takes a bounded number; with what was counted each language's 2000th surviving score rises,
and the rounds end when no open node's bound reaches it. What reaches it by a tie is
expanded too.

A cut's second part may begin with a word that was never expanded. Such parts are counted
by name in a later round, and only for phrases that can still reach the 2000th score.

A candidate lies in a longer one as frequent exactly if all its occurrences have the same
word before or after them, which is seen when it is counted.

Words and phrases are 64-bit hashes, and a last pass brings the texts of what is returned,
with a second hash: should two phrases ever share the first, all is done again with another
seed.

Defined results
- null text: empty; null lang: `und`, as is the lang of that name.
- repeated rows and null ids count as often as they are there; ids are not read.
- texts of any length are read whole; a phrase never crosses a text's or a piece's end.
- a language with fewer candidates returns them all, one without any has no rows; an empty table gives none.
- columns beside text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verisift.llm.common import cut_lineage, in_arrow, small
from verisift.llm.shingles import mixed, powers

#: Occurrences of a candidate, words of the longest one, and phrases of a language that are returned.
OFTEN, LONGEST, FIRST = 100, 5, 2000
#: Nodes, and parts of cuts, that a round takes at most.
NODES = 1 << 18
#: A round takes nodes of a language until they hold one of so many of its words, and so many words at least.
SHARE, LEAST = 16, 1 << 22
#: Bytes whose words are hashed at once, and words whose phrases are.
BYTES, WORDS = 1 << 21, 1 << 19

_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, _U(0xD6E8FEB86659FD93)
#: 1 for what ends a word, 2 for what ends a piece too.
KIND = np.array([2 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 1 if chr(b) in " \t" else 0 for b in range(256)], dtype=np.uint8)
COUNTS = "key long, parent long, last long, n long, l1 long, l2 long, r1 long, r2 long"


@lru_cache(maxsize=2)
def tables(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value = mixed(np.arange(256, dtype=np.uint64) + _U(0x1234567 + 1000 * seed)) | _U(1)
    return value, powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)


class Words:
    """The words of a group of texts: hash, place in the bytes, piece, and hash of the text's language."""

    def __init__(self, texts: list[bytes], langs: list[str], seed: int):
        self.raw = b"\n".join(texts).lower() + b"\n"  # bytes.lower() folds A-Z only
        at = np.frombuffer(self.raw, dtype=np.uint8)
        kind = KIND[at]
        value, power, inverse = tables(BYTES, seed)
        gaps = np.flatnonzero(kind)
        parts, a, breaks = [], 0, 0
        while a < len(at):
            b = int(gaps[min(np.searchsorted(gaps, a + BYTES // 2), len(gaps) - 1)]) + 1
            if b - a >= len(power):  # one word longer than that
                value, power, inverse = tables(b - a, seed)
            gap = kind[a:b] > 0
            edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
            if not gap[0]:
                edge = np.concatenate([[0], edge])
            start, end = edge[0::2], edge[1::2]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[at[a:b]] * power[: b - a], dtype=np.uint64)])
            broken = np.cumsum(kind[a:b] == 2) + breaks
            parts.append((mixed((total[end] - total[start]) * inverse[start]), start + a, end + a, broken[start]))
            a, breaks = b, int(broken[-1])
        self.hash, self.start, self.end, self.piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(bounds, self.start, side="right")
        self.lang = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed) for x in langs], dtype=np.uint64)[self.text]

    def phrase(self, i: int, m: int) -> bytes:
        return b" ".join(self.raw[self.start[j] : self.end[j]] for j in range(i, i + m))


def step(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a phrase with one word more; the empty phrase's is its language's hash."""
    return mixed(key * _STEP + word)


class Keys:
    """A sorted set of keys; most of what isn't in it is told by a table of their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys.astype(np.int64).view(np.uint64))
        self.first = np.zeros(1 << 20, dtype=bool)
        self.first[self.keys >> _U(44)] = True

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys of the set are."""
        some = np.flatnonzero(self.first[keys >> _U(44)])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        return some[self.keys[at] == keys[some]]


def occurrences(words: Words, grown: dict[int, Keys], named: dict[int, Keys]) -> Iterator[tuple[np.ndarray, ...]]:
    """place, length, key, parent, last, word before and word after (0: none) of phrases that continue one of `grown`, or are of `named` (parent 0)."""
    n, deepest = len(words.hash), max([*(m + 1 for m in grown), *named])
    w = np.concatenate([np.zeros(1, np.uint64), words.hash, np.zeros(LONGEST + 1, np.uint64)])
    p = np.concatenate([[-1], words.piece, np.full(LONGEST + 1, -2)])
    for lo in range(0, n, WORDS):
        hi = min(n, lo + WORDS)
        at = lambda a, j: a[lo + 1 + j : hi + 1 + j]  # noqa: B023, E731
        beside = lambda j: np.where(at(p, j) == at(p, 0), at(w, j), _U(0))  # noqa: B023, E731
        before, key, inside = beside(-1), step(words.lang[lo:hi], at(w, 0)), np.ones(hi - lo, dtype=bool)
        for m in range(1, deepest + 1):
            if m in named:
                hit = named[m].among(key)
                hit = hit[inside[hit]]
                none = np.zeros(len(hit), np.uint64)
                yield hit + lo, np.full(len(hit), m), key[hit], none, none, before[hit], beside(m)[hit]
            if m == deepest:
                break
            inside, longer = at(p, m) == at(p, 0), step(key, at(w, m))
            if m in grown:
                hit = grown[m].among(key)
                hit = hit[inside[hit]]
                yield hit + lo, np.full(len(hit), m + 1), longer[hit], key[hit], at(w, m)[hit], before[hit], beside(m + 1)[hit]
            key = longer


def groups(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Words, list[str]]]:
    """The words of texts of about BYTES bytes at a time, with the texts' languages."""
    for batch in batches:
        texts, langs, size = [], [], 0
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            texts.append(text.as_py())
            langs.append(lang)
            size += len(texts[-1])
            if size >= BYTES:
                yield Words(texts, langs, seed), langs
                texts, langs, size = [], [], 0
        if texts:
            yield Words(texts, langs, seed), langs


def _firsts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.empty(0, np.int64)
    return order, first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _read(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))


def word_counts(read: DataFrame, seed: int) -> DataFrame:
    """lang, key, word (hash) and n of words of at least OFTEN occurrences, and for each lang a row without key of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in groups(batches, seed):
            key = step(words.lang, words.hash)
            order, first = _firsts(key)
            n = np.diff(np.append(first, len(order)))
            one = order[first]
            owner = words.text[one]
            all_: dict[str, int] = {}
            for text, often in enumerate(np.bincount(words.text, minlength=len(langs)).tolist()):
                all_[langs[text]] = all_.get(langs[text], 0) + often
            yield pa.RecordBatch.from_arrays([pa.array([langs[t] for t in owner], pa.string()), _signed(key[one]), _signed(words.hash[one]), pa.array(n, pa.int64())], ["lang", "key", "word", "n"])
            none = pa.nulls(len(all_), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(all_), pa.string()), none, none, pa.array(list(all_.values()), pa.int64())], ["lang", "key", "word", "n"])

    found = in_arrow(read, run, "lang string, key long, word long, n long").groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))
    return cut_lineage(found.filter(F.col("key").isNull() | (F.col("n") >= OFTEN)))


def phrase_counts(read: DataFrame, grown: dict[int, Keys], named: dict[int, Keys], seed: int) -> DataFrame:
    """COUNTS of phrases that continue one of `grown`, of at least OFTEN occurrences, and of those of `named`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in groups(batches, seed):
            found = list(occurrences(words, grown, named))
            if not found:
                continue
            key, parent, last, left, right = (np.concatenate(x) for x in list(zip(*found, strict=True))[2:])
            # a phrase may be both a child and asked for by name
            order, first = _firsts(key ^ (parent == 0))
            if not len(order):
                continue
            # signed, as Spark's least and greatest are
            one, ends = order[first], [f.reduceat(x.view(np.int64)[order], first) for x in (left, right) for f in (np.minimum, np.maximum)]
            n = pa.array(np.diff(np.append(first, len(order))), pa.int64())
            yield pa.RecordBatch.from_arrays([_signed(key[one]), _signed(parent[one]), _signed(last[one]), n, *map(_signed, ends)], ["key", "parent", "last", "n", "l1", "l2", "r1", "r2"])

    ends = [f(F.col(c)).alias(c) for c, f in (("l1", F.min), ("l2", F.max), ("r1", F.min), ("r2", F.max))]
    found = in_arrow(read, run, COUNTS).groupBy("key", "parent", "last").agg(F.sum("n").alias("n"), *ends)
    return cut_lineage(found.filter((F.col("parent") == 0) | (F.col("n") >= OFTEN)))


def phrase_texts(read: DataFrame, named: dict[int, Keys], seed: int) -> DataFrame:
    """key, phrase, n, and whether one key had several phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in groups(batches, seed):
            found = list(occurrences(words, {}, named))
            place, length, key = (np.concatenate(x) for x in list(zip(*found, strict=True))[:3]) if found else [np.empty(0, np.int64)] * 3
            if not len(key):
                continue
            other = Words([words.raw[:-1]], [""], seed + 1).hash  # the same words under another hash
            sums = np.zeros(len(key), dtype=np.uint64)
            for j in range(LONGEST):
                more = length > j
                sums[more] = mixed(sums[more] * _STEP + other[place[more] + j])
            order, first = _firsts(key)
            one = order[first]
            texts = pa.array([words.phrase(int(i), int(m)) for i, m in zip(place[one], length[one], strict=True)], pa.binary())
            n = pa.array(np.diff(np.append(first, len(order))), pa.int64())
            low, high = (f.reduceat(sums.view(np.int64)[order], first) for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([_signed(key[one]), texts, n, _signed(low), _signed(high)], ["key", "phrase", "n", "c1", "c2"])

    found = in_arrow(read, run, "key long, phrase binary, n long, c1 long, c2 long")
    several = (F.min("c1") != F.max("c2")) | (F.min("phrase") != F.max("phrase"))
    return found.groupBy("key").agg(F.min("phrase").cast("string").alias("phrase"), F.sum("n").alias("n"), several.alias("several"))


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    over, under = F.lit(1000).cast("decimal(4,0)") * (wide(a) * wide(n)).cast("decimal(34,0)"), wide(left) * wide(right)
    return F.call_function("div", over.cast("decimal(38,0)"), under.cast("decimal(38,0)"))


def bound() -> Column:
    """What no phrase below a node can exceed."""
    return F.call_function("div", F.lit(1000) * F.col("total"), F.coalesce(F.get("fs", F.lit(0)), F.col("f")))


def key_of(lang: str, words: list[int], seed: int) -> int:
    key = np.array([xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)], dtype=np.uint64)
    for w in words:
        key = step(key, np.array([w], dtype=np.int64).view(np.uint64))
    return int(key.view(np.int64)[0])


def by_length(rows: list, length: str = "m") -> dict[int, Keys]:
    found: dict[int, list[int]] = {}
    for r in rows:
        found.setdefault(r[length], []).append(r["key"])
    return {m: Keys(np.array(keys)) for m, keys in found.items()}


def with_cuts(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """The phrases with `cuts`, (score, k, l, r) of each cut, whose score is a bound and whose r is null if the second part isn't known."""
    m = F.size("words")
    cut = phrases.select("*", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cut = cut.select("*", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("_rest"))
    parts = known.select(F.col("lang").alias("_lang"), F.col("words").alias("_words"), F.col("f").alias("r"))
    held = cut.join(parts, (F.col("lang") == F.col("_lang")) & (F.col("_rest") == F.col("_words")), "left")
    left = F.get("fs", F.col("k") - 1)
    one = F.struct(score(F.col("f"), F.col("total"), left, F.coalesce("r", "f")).alias("score"), F.col("k"), left.alias("l"), F.col("r"))
    cuts = held.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("cuts"))
    return phrases.join(cuts, "key")


def weakest(scored: DataFrame) -> DataFrame:
    """lang and its FIRST-th score, of languages with so many."""
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc())
    first = scored.select("lang", "best", F.row_number().over(order).alias("_rank")).filter(F.col("_rank") <= FIRST)
    return first.filter(F.col("_rank") == FIRST).select("lang", F.col("best.score").alias("least"))


def within(rows: DataFrame, least: DataFrame, most: Column) -> DataFrame:
    """The rows whose `most` reaches their language's weakest score."""
    held = rows.join(small(least), "lang", "left")
    return held.filter(F.col("least").isNull() | (most >= F.col("least"))).drop("least")


def next_nodes(frontier: DataFrame) -> DataFrame:
    """The nodes of the best bounds, longer ones first: NODES of all, and of a language as SHARE and LEAST say, but one at least."""
    best = frontier.withColumn("_bound", bound()).orderBy(F.col("_bound").desc(), F.size("words").desc(), "key").limit(NODES)
    order = Window.partitionBy("lang").orderBy(F.col("_bound").desc(), F.size("words").desc(), "key")
    mass = F.sum("f").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("_before", F.coalesce(mass, F.lit(0))).filter(F.col("_before") <= F.greatest(F.col("total") / SHARE, F.lit(LEAST))).drop("_bound", "_before")


def missing_parts(open_: DataFrame, seed: int) -> list[dict]:
    """The unknown second parts of the phrases of the highest bounds, NODES at most."""
    unknown = F.filter("cuts", lambda c: c["r"].isNull())
    parts = open_.select("lang", "words", F.array_min("cuts.score").alias("_most"), F.explode(unknown).alias("_c"))
    parts = parts.select("lang", F.slice("words", F.col("_c.k") + 1, F.size("words") - F.col("_c.k")).alias("words"), "_most")
    best = parts.groupBy("lang", "words").agg(F.max("_most").alias("_most")).orderBy(F.col("_most").desc(), "lang", "words").limit(NODES)
    return [{"lang": r.lang, "words": r.words, "key": key_of(r.lang, r.words, seed), "m": len(r.words)} for r in best.collect()]


def settled(read: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The surviving phrases that may be among the first of their language, with the best of their cuts; and all counted phrases' keys."""
    spark = read.sparkSession
    counts = word_counts(read, seed)
    totals = counts.filter("key IS NULL").select("lang", F.col("n").alias("total"))
    words = counts.filter("key IS NOT NULL").join(small(totals), "lang")
    known = cut_lineage(words.select("lang", "total", F.array("word").alias("words"), "key", F.col("n").alias("f"), F.array().cast("array<long>").alias("fs"), F.lit(False).alias("inside")))
    frontier, columns = known, known.columns
    open_ = scored = None
    least = spark.createDataFrame([], "lang string, least long")
    while True:
        nodes = cut_lineage(next_nodes(frontier))
        parts = missing_parts(open_, seed) if open_ is not None else []
        grown = by_length(nodes.select("key", F.size("words").alias("m")).collect())
        if not grown and not parts:
            break
        found = phrase_counts(read, grown, by_length(parts), seed)
        same = ((F.col("l1") == F.col("l2")) & (F.col("l1") != 0)) | ((F.col("r1") == F.col("r2")) & (F.col("r1") != 0))
        children = found.filter("parent <> 0").join(small(nodes.withColumnRenamed("key", "parent")), "parent")
        longer = F.concat("words", F.array("last"))
        children = cut_lineage(children.select("lang", "total", longer.alias("words"), "key", F.col("n").alias("f"), F.concat("fs", F.array("f")).alias("fs"), (same & (F.size("words") + 1 < LONGEST)).alias("inside")))
        known = known.unionByName(children)
        if parts:
            named = spark.createDataFrame([(x["lang"], x["words"], x["key"]) for x in parts], "lang string, words array<long>, key long")
            named = found.filter("parent = 0").join(small(named), "key").join(children.select("key"), "key", "left_anti")
            named = named.select("lang", F.lit(None).cast("long").alias("total"), "words", "key", F.col("n").alias("f"), F.lit(None).cast("array<long>").alias("fs"), F.lit(True).alias("inside"))
            known = known.unionByName(cut_lineage(named))
        asked = children.filter(~F.col("inside"))
        asked = asked if open_ is None else asked.unionByName(open_.select(columns))
        judged = cut_lineage(with_cuts(asked, known))
        whole = F.forall("cuts", lambda c: c["r"].isNotNull())
        done = judged.filter(whole).withColumn("best", F.array_min("cuts")).drop("cuts")
        scored = done if scored is None else scored.unionByName(done)
        least = cut_lineage(weakest(scored))
        scored = cut_lineage(within(scored, least, F.col("best.score")))
        open_ = cut_lineage(within(judged.filter(~whole), least, F.array_min("cuts.score")))
        frontier = frontier.join(small(nodes.select("key")), "key", "left_anti").unionByName(children.filter(F.size("words") < LONGEST))
        frontier = cut_lineage(within(frontier, least, bound()).select(columns))
    return scored, known


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's FIRST best phrases."""
    read = _read(docs, text_col, lang_col)
    scored, _ = settled(read, seed)
    if scored is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("f").desc())
    tied = cut_lineage(scored.withColumn("_rank", F.rank().over(order)).filter(F.col("_rank") <= FIRST))
    texts, blocks = None, -(-tied.count() // NODES)
    for i in range(blocks):
        keys = tied.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).select("key", F.size("words").alias("m")).collect()
        some = phrase_texts(read, by_length(keys), seed) if keys else None
        texts = some if texts is None else texts.unionByName(some) if some is not None else texts
    if texts is None:
        return collocations(docs.filter("false"), text_col, lang_col, seed)
    held = cut_lineage(tied.join(texts, "key"))
    if held.filter(F.col("several") | (F.col("n") != F.col("f"))).limit(1).count():
        return collocations(docs, text_col, lang_col, seed + 1)
    order = Window.partitionBy("lang").orderBy(F.col("best.score").desc(), F.col("f").desc(), "phrase")
    first = held.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= FIRST)
    return first.select("lang", "rank", "phrase", F.col("f").alias("a"), "best.l", "best.r", F.col("total").alias("n"), "best.score")
