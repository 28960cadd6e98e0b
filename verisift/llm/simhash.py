"""Near-duplicate documents by SimHash: fingerprints that differ in few bits, found by one-wildcard variants of their halves.

A fingerprint has 64 bits. Two that differ in at most two bits agree, but for one bit at
most, in one of the two halves. So each half is indexed 32 times, with one of its bits left
out, and fingerprints of an equal key are compared in full. Documents of one fingerprint
are one class, and only classes are compared.

A key of two members is judged from their least and greatest. A small key is gathered and
its pairs are verified. In a crowded key the members are indexed again, with two bits left
out in all: what then agrees differs in two bits at most, needs no comparing, and has four
members at most, so that no key of any size is compared pair by pair, capped or dropped.
Pairs of one half in common share all its keys; they are looked for in the first of them
only, and in the others pairs that differ in the bit left out.

Defined results
- null text, or text without a word: fingerprint zero, linked like any other.
- fewer words than a shingle: the whole sequence is the one shingle.
- repeated rows are each returned; rows of one id with different texts are rows of their own.
- null ids are never a component's id, unless all ids of it are null: then it is null.
- an empty table gives no rows; columns beside id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import cut_lineage, in_arrow, salted_join, small
from verisift.llm.components import connected_components

#: Words of a shingle, and the seed of its XXH64.
SHINGLE, SEED = 3, 42
#: Bits in which linked fingerprints may differ.
BITS = 2
#: Members up to which a key's pairs are compared in one row: about as many as a member has keys in a crowded one.
FEW = 512
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 15


def shingle_texts(words: list[bytes]) -> Iterator[bytes]:
    """The runs of SHINGLE words, joined by spaces; of fewer words the whole sequence."""
    if len(words) < SHINGLE:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def fingerprint(text: bytes | None) -> int:
    """A bit is 1 if it is in over half of the shingles' hashes; without a word all are 0."""
    # bytes.lower() folds A-Z only, and bytes.split() cuts at the white space of the contracts
    hashes = (xxhash.xxh64_intdigest(s, SEED) for s in shingle_texts((text or b"").lower().split()))
    n, ones = 0, np.zeros(64, dtype=np.int64)
    while len(some := np.fromiter(islice(hashes, AT_ONCE), dtype="<u8")):
        n += len(some)
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = (fingerprint(x.as_py()) for x in batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and print, the fingerprint's bits as a long, for each row."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return in_arrow(read, _printed, "doc_id long, print long")


def _bit(at: Column | int) -> Column:
    return F.shiftleft(F.lit(1).cast("long"), at) if isinstance(at, int) else F.call_function("shiftleft", F.lit(1).cast("long"), at)


def half_keys(prints: DataFrame) -> DataFrame:
    """(print, key): for each half and each of its bits the half without the bit, with the bit's number above it."""
    halves = [F.col("print").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("print", 32)]
    keys = [
        halves[h].bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))).bitwiseOR(F.lit((32 * h + i) << 32))
        for h in (0, 1)
        for i in range(32)
    ]
    return prints.select("print", F.explode(F.array(*keys)).alias("key"))


def close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= BITS


def left_out() -> Column:
    """The bit that a key lacks, 0 to 63."""
    return F.shiftright("key", 32).cast("int")


def few_links(members: DataFrame) -> DataFrame:
    """(a, b) of the close pairs in keys of few members(print, key) that are to be looked for there."""
    held = members.groupBy("key").agg(F.sort_array(F.collect_list("print")).alias("_all"))
    out = left_out()
    here = lambda x, y: (out % 32 == 0) | (x.bitwiseXOR(y).bitwiseAND(_bit(out)) != 0)
    pairs = F.flatten(
        F.transform("_all", lambda x: F.transform(F.filter("_all", lambda y: (x < y) & close(x, y) & here(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    return held.select(F.explode(pairs).alias("_p")).select("_p.a", "_p.b")


def crowded_links(members: DataFrame) -> DataFrame:
    """(a, b) in keys of many members(print, key), which are indexed again with one more bit left out.

    With bit i of a half left out, pairs that differ there, or not at all in that half,
    differ in one bit of the other half at most, or in two of them if the half is the same:
    these meet under i = 0 of the half.
    """
    out = left_out()
    other = F.when(out < 32, 32).otherwise(0)
    ones = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.struct(F.least(out, other + j).alias("i"), F.greatest(out, other + j).alias("j")))
    twos = F.flatten(
        F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.transform(F.sequence(i + 1, F.lit(31)), lambda j: F.struct((other + i).alias("i"), (other + j).alias("j"))))
    )
    masks = F.when(out % 32 == 0, F.concat(ones, twos)).otherwise(ones)
    # each fingerprint once for a pair of bits, though several of its keys may ask for it
    asked = members.repartition("print").select("print", F.explode(masks).alias("_m")).select("print", "_m.i", "_m.j")
    has = lambda at: F.call_function("shiftrightunsigned", F.col("print"), at).bitwiseAND(F.lit(1)).cast("int")
    rest = F.col("print").bitwiseAND(F.bitwise_not(_bit(F.col("i")).bitwiseOR(_bit(F.col("j")))))
    seen = asked.select("i", "j", rest.alias("_rest"), _bit(2 * has(F.col("i")) + has(F.col("j"))).alias("_seen"))
    found = seen.groupBy("i", "j", "_rest").agg(F.bit_or("_seen").alias("_seen")).filter(F.bit_count("_seen") > 1)
    four = F.array(*[
        F.when(F.col("_seen").bitwiseAND(F.lit(1 << (2 * x + y))) != 0, F.col("_rest").bitwiseOR(F.lit(x) * _bit(F.col("i"))).bitwiseOR(F.lit(y) * _bit(F.col("j"))))
        for x in (0, 1)
        for y in (0, 1)
    ])
    all_ = found.select(F.array_compact(four).alias("_all"))
    return all_.select(F.get("_all", F.lit(0)).alias("a"), F.explode(F.slice("_all", 2, 3)).alias("b"))


def links(prints: DataFrame) -> DataFrame:
    """(a, b) that connect all distinct prints(print) which differ in at most BITS bits."""
    keys = half_keys(prints)
    # which values the bit left out has among the members
    side = F.col("print").bitwiseAND(_bit(left_out())) != 0
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("print").alias("a"), F.max("print").alias("b"), (F.min(side) != F.max(side)).alias("_both"))
    held = cut_lineage(held.filter((F.col("_n") > 1) & (F.col("_both") | (left_out() % 32 == 0))))
    two = held.filter((F.col("_n") == 2) & close(F.col("a"), F.col("b"))).select("a", "b")
    more = held.filter(F.col("_n") > 2).select("key", "_n")
    if not more.limit(1).count():
        return two.distinct()
    members = cut_lineage(keys.join(small(more), "key"))
    few = few_links(members.filter(F.col("_n") <= FEW).select("print", "key"))
    crowded = crowded_links(members.filter(F.col("_n") > FEW).select("print", "key"))
    return two.unionByName(few).unionByName(crowded).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint in 16 hexadecimal digits and component_id, a row for each document."""
    printed = cut_lineage(fingerprints(docs, id_col, text_col))
    classes = cut_lineage(printed.groupBy("print").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_copies")))
    labels = connected_components(links(classes.select("print")))
    named = classes.join(small(labels.withColumnRenamed("node", "print")), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("_least").alias("component_id"))
    # most rows are alone, and are in no join's right side
    moved = salted_join(named, least, ["component"], "print", salts=8).filter((F.col("_copies") > 1) | ~F.col("_least").eqNullSafe(F.col("component_id")))
    moved = cut_lineage(moved.select("print", "component_id", F.lit(True).alias("_moved")))
    out = salted_join(printed, moved, ["print"], "doc_id", "left", 8)
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), F.when(F.col("_moved"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
