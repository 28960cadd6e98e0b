"""Near-duplicate documents: one-permutation MinHash with optimal densification.

Each document's distinct shingles are hashed once; the hash range is cut into bins, a
bin's value is its least hash, and an empty bin takes the value of a bin that a hash of
(bin, attempt) picks, as optimal densification does. Bands of bins are bucket keys.
Documents with the same set of shingles form a class, and only one document of a class
takes part in the search. A bucket's candidate edges form stars: a member is paired with
the bucket's centre, so that n members give fewer than n pairs. Pairs are confirmed on the
full sets. Where a bucket's members then aren't all one component, those outside its
largest component are centres too, and meet what they can be similar to: each two members
of a bucket are compared, ruled out by a bound, or linked by others.

Defined results
- null text, or text without a word: no shingles, linked with nothing, its own component.
- fewer words than a shingle: the whole sequence is the one shingle.
- repeated rows (same id and text) are one class, and each is returned.
- rows of one id with different texts are in one component, which holds what each text is linked with.
- texts of the same set of shingles are one class, named by a 64-bit hash of its digest.
- an empty table gives no rows; columns beside id and text are only passed on.
- no shingle set is sampled or capped; buckets of any size keep all members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import cut_lineage, fresh, in_arrow, salted_join, small
from verisift.llm.components import connected_components
from verisift.llm.shingles import mixed, shingles, word_hashes

#: Bands, bins of a band, and buckets that a candidate pair must share. A pair of Jaccard
#: similarity 0.8 shares a band with a probability of 0.8**5, and fewer than SHARED of all
#: bands with one of 5e-9.
BANDS, ROWS, SHARED = 64, 5, 3
BINS = BANDS * ROWS
#: Ids up to which a list of documents is broadcast (16 MB).
BROADCAST_IDS = 1_000_000
ATTEMPTS = 64
#: What bounds a set's similarity to others: its size; how many elements it shares with any other;
#: a third set, and how many it shares with that; a bitmap of the elements it shares with any other.
BOUNDS = ("n", "most", "third", "inside", "bits")
#: 64-bit words of that bitmap.
WORDS = 16


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(shingles(w, k, short=True)) for w in word_hashes(texts)]


_donors: np.ndarray | None = None


def donors() -> np.ndarray:
    """For each attempt and bin the bin that an empty one turns to."""
    global _donors
    if _donors is None:
        n = np.arange(ATTEMPTS * BINS, dtype=np.uint64).reshape(ATTEMPTS, BINS)
        _donors = (mixed(n + np.uint64(0xABCDEF)) % np.uint64(BINS)).astype(np.int64)
    return _donors


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values for each non-empty set."""
    out = np.zeros((len(sets), BINS), dtype=np.uint64)
    filled = np.zeros((len(sets), BINS), dtype=bool)
    for i, s in enumerate(sets):
        bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        out[i, bins[first]], filled[i, bins[first]] = s[first], True
    whole = filled.copy()
    for attempt in donors():
        rows, bins = np.nonzero(~whole)
        if not len(rows):
            return out
        ok = filled[rows, attempt[bins]]
        rows, bins = rows[ok], bins[ok]
        out[rows, bins], whole[rows, bins] = out[rows, attempt[bins]], True
    for i, j in zip(*np.nonzero(~whole), strict=True):  # as good as never: the first filled bin after it
        out[i, j] = out[i, np.flatnonzero(np.roll(filled[i], -j))[0] - BINS + j]
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    rows = signature(sets).reshape(len(sets), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for j in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
    return key.view(np.int64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums of a set's hashes."""
    return (int(mixed(s).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mixed(s + np.uint64(77))))) if len(s) else (0, 0)


def node_of(h1: Column, h2: Column, n: Column) -> Column:
    """The number of a class of equal sets; null for the empty set."""
    return F.when(n > 0, F.xxhash64(h1, h2, n))


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 128):
            batch = whole.slice(a, 128)
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if some:
                for i, row in zip(some, band_keys([sets[i] for i in some]), strict=True):
                    keys[i] = row
            digests = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *[pa.array(np.array([d[j] for d in digests], dtype=np.uint64).view(np.int64)) for j in (0, 1)],
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "h1", "h2", "keys"],
            )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 128):
            batch = whole.slice(a, 128)
            sets = [s for s in shingle_sets(batch.column(0).to_pylist(), k) if len(s)]
            digests = [pa.array(np.array([digest(s)[j] for s in sets], dtype=np.uint64).view(np.int64)) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*digests, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["h1", "h2", "grams"])


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, node (the class of equal sets) and the band keys."""
    signed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).transform(
        in_arrow, lambda batches: _signed(batches, k), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"
    )
    return signed.select("doc_id", "n_shingles", node_of(F.col("h1"), F.col("h2"), F.col("n_shingles")).alias("node"), "keys")


def quick_edges(open_: DataFrame) -> DataFrame:
    """(m, c): each member of open_(key, node, degree) and, of its buckets' centres, the one in most of them.

    A bucket's centre is the member of the highest degree, which most copies of one
    original resemble.
    """
    centre = open_.groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("c"))
    met = open_.join(centre, "key").filter(F.col("node") != F.col("c")).groupBy(F.col("node").alias("m"), "c").agg(F.count(F.lit(1)).alias("shared"))
    return met.groupBy("m").agg(F.max_by("c", F.struct("shared", "c")).alias("c"))


def star_edges(open_: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (m, c) of different components that share a bucket of open_(key, node, component and BOUNDS).

    Of each bucket all members outside its largest component are centres, so that each two
    members of different components meet. Sets that can't have enough in common for the
    similarity asked for are no pair.
    """
    sizes = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("_large"))
    outside = open_.join(largest, "key").filter(F.col("component") != F.col("_large")).select("node").distinct()
    outside = small(cut_lineage(outside.withColumn("_centre", F.lit(True))))
    flagged = open_.join(outside, "node", "left").withColumn("_centre", F.coalesce("_centre", F.lit(False)))
    chosen = flagged.filter("_centre").select("key", *[F.col(x).alias(f"c_{x}") for x in ("node", "component", *BOUNDS)])
    # no more can be in common than either shares with any set, nor, inside and outside of one third set, than either has there
    beyond = lambda most, inside: F.greatest(F.col(most) - F.col(inside), F.lit(0))
    apart = F.least("inside", "c_inside") + F.least(beyond("most", "inside"), beyond("c_most", "c_inside"))
    # a bit that only one of them has stands for an element, at least, that the other lacks
    only = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(WORDS)), F.lit(0))
    both = F.least(F.col("most") - only("bits", "c_bits"), F.col("c_most") - only("c_bits", "bits"))
    common = F.least(both, F.when(F.col("third") == F.col("c_third"), apart))
    met = flagged.join(chosen, "key").filter(
        (F.col("component") != F.col("c_component"))
        & (~F.col("_centre") | (F.col("node") < F.col("c_node")))
        & ((100 + percent) * common >= percent * (F.col("n") + F.col("c_n")))
    )
    return met.select(F.col("node").alias("m"), F.col("c_node").alias("c")).distinct()


def set_table(docs: DataFrame, nodes: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(node, grams): the full shingle sets of nodes(node, rep), read from the documents rep."""
    read = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    read = read.join(small(nodes.select("rep").distinct(), BROADCAST_IDS), "rep", "left_semi").select("text")
    sets = read.transform(in_arrow, lambda batches: _sets(batches, k), "h1 long, h2 long, grams array<long>")
    sets = sets.select(node_of(F.col("h1"), F.col("h2"), F.size("grams").cast("long")).alias("node"), "grams")
    return sets.groupBy("node").agg(F.max("grams").alias("grams"))


def measured(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (m, c) with the size of the intersection of their full sets, and whether they are similar enough.

    Few edges are sent to the sets; only the set of m is shuffled for an edge.
    """
    mine = sets.join(small(edges), F.col("node") == F.col("m")).select("m", "c", F.col("grams").alias("_m"))
    few = small(cut_lineage(edges.select("c").distinct()), BROADCAST_IDS)
    other = sets.join(few, F.col("node") == F.col("c"), "left_semi").select(F.col("node").alias("c"), F.col("grams").alias("_c"))
    both = mine.join(other, "c").withColumn("shared", F.size(F.array_intersect("_m", "_c")))
    alike = 100 * F.col("shared") >= percent * (F.size("_m") + F.size("_c") - F.col("shared"))
    return both.select("m", "c", "shared", alike.alias("alike"))


def linked(docs: DataFrame, members: DataFrame, reps: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of members(node, n, key) that share buckets with others.

    A quick turn compares each member with one centre, which joins what is alike to one
    document. A second one compares all members of a bucket that are not in one component
    then. As a candidate pair shares SHARED buckets, each member leaves all but one of so
    many, its largest ones: in the smallest bucket that two share, both are left.
    """
    hot = members.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    held = members.join(hot, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("_size", "key"))).alias("_keys"))
    degree = F.aggregate("_keys", F.lit(0).cast("long"), lambda a, x: a + x["_size"])
    fewer = F.slice("_keys", 1, F.size("_keys") - (SHARED - 1))
    held = cut_lineage(held.filter(F.size("_keys") >= SHARED).select("node", "n", degree.alias("degree"), fewer.alias("_keys")))
    open_ = cut_lineage(held.select("node", "n", "degree", F.explode("_keys.key").alias("key")))
    nodes = cut_lineage(open_.select("node").distinct())
    sets = cut_lineage(set_table(docs, reps.join(nodes, "node", "left_semi"), k, id_col, text_col))

    pairs = cut_lineage(measured(cut_lineage(quick_edges(open_)), sets, percent))
    links = pairs.filter("alike").select(F.col("m").alias("a"), F.col("c").alias("b"))
    first = small(connected_components(links))
    open_ = cut_lineage(_mixed(open_.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))))
    if open_.limit(1).count():
        edges = cut_lineage(star_edges(bounded(open_, pairs, sets, percent), percent))
        if edges.limit(1).count():
            more = cut_lineage(measured(edges, sets, percent))
            links = links.unionByName(more.filter("alike").select(F.col("m").alias("a"), F.col("c").alias("b")))
            return connected_components(links)
    return first


def bounded(open_: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """open_ with BOUNDS, without sets that can't be similar to one of open_.

    The third set is the centre that the set was compared with. Elements are told apart by
    32 bits, so that `most` is never too small.
    """
    thirds = small(pairs.select(F.col("m").alias("node"), F.col("c").alias("_c"), F.col("shared").alias("_shared")))
    open_ = open_.join(thirds, "node", "left").select(
        "key", "node", "component", "n", F.coalesce("_c", "node").alias("third"), F.coalesce("_shared", "n").alias("inside")
    )
    open_ = cut_lineage(open_)
    pool = small(cut_lineage(open_.select(F.explode(F.array("node", "third")).alias("node")).distinct()), BROADCAST_IDS)
    held = sets.join(pool, "node", "left_semi").select("node", F.explode(F.transform("grams", lambda g: F.shiftright(g, 32).cast("int"))).alias("_g"))
    common = held.groupBy("_g").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_a <> _b").select("_g")
    bit = f"shiftleft(1L, CAST(pmod(_g, {64 * WORDS}) % 64 AS INT))"
    bits = [F.expr(f"coalesce(bit_or(CASE WHEN pmod(_g, {64 * WORDS}) DIV 64 = {i} THEN {bit} END), 0L)") for i in range(WORDS)]
    most = held.join(common, "_g", "left_semi").groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("most"), F.array(*bits).alias("bits"))
    most = small(cut_lineage(most))
    return cut_lineage(_mixed(open_.join(most, "node").filter(100 * F.col("most") >= percent * F.col("n"))))


def _mixed(open_: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    several = open_.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a <> _b")
    return open_.join(several.select("key"), "key", "left_semi")


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    return rows.join(small(merged), "component", "left").select(
        *[F.coalesce("_to", "component").alias(c) if c == "component" else F.col(c) for c in rows.columns]
    )


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each document."""
    signed = cut_lineage(signatures(docs, k, id_col, text_col))
    some = signed.filter(F.col("n_shingles") > 0)
    classes = cut_lineage(some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    copied = small(classes.filter("copies > 1").select("node"))
    # one row of each class; of copies one, taken within tasks first
    one = some.join(copied, "node", "left_anti").select("node", "n_shingles", "keys").unionByName(
        some.join(copied, "node", "left_semi").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    )
    members = one.select("node", F.col("n_shingles").cast("int").alias("n"), F.explode("keys").alias("key"))
    labels = linked(docs, members, classes.select("node", "rep"), k, percent, id_col, text_col)
    # an id with several texts holds their classes together
    texts = signed.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
    several = cut_lineage(texts.agg(F.min("node").alias("a"), F.max("node").alias("b"), F.min("n_shingles").alias("_n")).filter("a <> b OR (a IS NOT NULL AND _n = 0)"))
    if several.limit(1).count():
        labels = _joined_by_id(signed, several, labels)
    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    moved = cut_lineage(
        salted_join(named, least, ["component"], "node", salts=8).filter((F.col("copies") > 1) | ~F.col("rep").eqNullSafe(F.col("component_id")))
        .select("node", "component_id")
    )
    out = salted_join(signed.select("doc_id", "n_shingles", "node"), moved, ["node"], "doc_id", "left", 8)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    found = out.select("doc_id", "n_shingles", component.alias("component_id"))
    if several.limit(1).count():  # rows of such an id without words go with its others
        ids = found.join(small(several.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("_least"))
        found = found.join(ids, "doc_id", "left").select("doc_id", "n_shingles", F.least("component_id", "_least").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _joined_by_id(signed: DataFrame, several: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels with the classes of one id in one component."""
    held = signed.filter("node IS NOT NULL").join(small(several.select("doc_id")), "doc_id", "left_semi").select("doc_id", "node").distinct()
    held = held.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = held.groupBy("doc_id").agg(F.min("component").alias("a"))
    links = cut_lineage(held.join(firsts, "doc_id").select("a", F.col("component").alias("b")).distinct())
    merged = connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    every = labels.unionByName(held.select("node", "component")).distinct()
    return cut_lineage(_relabelled(every, merged))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of the least id in their groups, with their columns as they are.

    Of several rows of one id one stays; rows with a null id all stay.
    """
    found = near_duplicates(docs, k, percent, id_col, text_col)
    key = fresh(docs, "_id")
    judged = found.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(key))
    odd = cut_lineage(
        judged.agg(F.bool_and("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")).filter(~F.col("_kept") | (F.col("_rows") > 1))
    )
    some = small(odd.select(key), BROADCAST_IDS)
    again = small(odd.filter("_kept").select(key), BROADCAST_IDS)
    plain = docs.join(some, F.col(id_col) == F.col(key), "left_anti")
    once = docs.join(again, F.col(id_col) == F.col(key), "left_semi").dropDuplicates([id_col])
    return plain.unionByName(once)
