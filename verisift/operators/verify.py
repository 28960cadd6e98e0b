"""Quotes against the pages they are said to stand on, or against all pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisift.functions.text import canonical, tokens

# The widest gap between two tokens, and the fewest tokens, of a layout match.
MAX_GAP, MIN_TOKENS = 1200, 6
#: Characters of the probes by which a quote is looked up in all pages.
PROBE = 6
#: Probes up to which pages are searched for them where they are read; above it, words and probes meet in a shuffled join.
BROADCAST_PROBES = 100_000
#: Bytes of pages that are searched at once.
STRETCH = 1 << 20
#: Bits of the hash that most places of a page fail by.
BITS = 20


def in_order(quote_tokens: Column, page: Column) -> Column:
    """Whether the tokens stand on the page in order, each the first after the one before, with bounded gaps."""
    start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("first"), F.lit(True).alias("ok"))

    def step(state: Column, token: Column) -> Column:
        found = F.call_function("locate", token, page, state["at"])
        fits = (found > 0) & (state["first"] | (found - state["at"] <= MAX_GAP))
        return F.struct((found + F.length(token)).alias("at"), F.lit(False).alias("first"), (state["ok"] & fits).alias("ok"))

    return (F.size(quote_tokens) >= MIN_TOKENS) & F.aggregate(quote_tokens, start, step, lambda s: s["ok"])


def tier(quote: Column, page: Column) -> Column:
    """exact, layout or unverified, of canonical texts."""
    exact = (quote != "") & F.contains(page, quote)
    return F.when(F.coalesce(exact, F.lit(False)), "exact").when(F.coalesce(in_order(tokens(quote), page), F.lit(False)), "layout").otherwise("unverified")


def verify_cited(evidence: DataFrame, pages: DataFrame, doc: str, page: str, quote: str, text: str) -> DataFrame:
    """Evidence with verification: a page that doesn't exist is out_of_range, a result and not a miss."""
    known = pages.select(doc, page, F.lit(True).alias("_known"), canonical(F.col(text)).alias("_page"))
    quoted = evidence.withColumn("_quote", canonical(F.coalesce(F.col(quote), F.lit(""))))
    joined = quoted.join(known, [doc, page], "left")
    found = F.when(F.col("_known").isNull(), "out_of_range").otherwise(tier(F.col("_quote"), F.coalesce("_page", F.lit(""))))
    return joined.withColumn("verification", found).drop("_page", "_quote", "_known")


def search_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, page_id, verification) of quotes(quote_id, quote) found on pages(page_id, text).

    Either tier finds each token of a quote within one word of the page. So a quote asks for
    the first PROBE letters of each of its tokens that are so long, and a page is a candidate
    if it has all of them. Candidates are then verified whole. A quote without so long a token
    meets all pages. Up to BROADCAST_PROBES probes each page is searched for all of them at
    once where it is read, so that neither texts nor words are shuffled; more are met by `met_by_words`.
    """
    wanted = quotes.select("quote_id", canonical(F.col("quote")).alias("_q")).filter("_q <> ''")
    parts = F.when(F.size(tokens(F.col("_q"))) >= MIN_TOKENS, tokens(F.col("_q"))).otherwise(F.split("_q", " "))
    long_ = F.filter(parts, lambda w: F.length(w) >= PROBE)
    wanted = wanted.withColumn("_probes", F.array_distinct(F.transform(long_, lambda w: F.substring(w, 1, PROBE))))
    read = pages.select("page_id", canonical(F.col("text")).alias("_p"))
    few = wanted.select(F.explode_outer("_probes")).limit(BROADCAST_PROBES + 1).count() <= BROADCAST_PROBES
    found = (met_where_read if few else met_by_words)(wanted, read).withColumn("verification", tier(F.col("_q"), F.col("_p")))
    return found.filter(F.col("verification") != "unverified").select("quote_id", "page_id", "verification").distinct()


def met_where_read(wanted: DataFrame, read: DataFrame) -> DataFrame:
    """(quote_id, page_id, _q, _p) of wanted(quote_id, _q, _probes), of BROADCAST_PROBES probes at most, and the pages that have all of a quote's."""
    rows = wanted.filter("quote_id IS NOT NULL").collect()
    schema = T.StructType([T.StructField("_no", T.IntegerType()), wanted.schema["quote_id"], wanted.schema["_q"]])
    numbered = wanted.sparkSession.createDataFrame([(i, r["quote_id"], r["_q"]) for i, r in enumerate(rows)], schema)
    held = read.filter("page_id IS NOT NULL").select("page_id", "_p", holders(rows)(F.col("_p")).alias("_held"))
    # outer, as explode alone filters by _held first, for which each page would be searched twice; the join drops the nulls
    return held.select("page_id", "_p", F.explode_outer("_held").alias("_no")).join(F.broadcast(numbered), "_no")


def holders(quotes: list[Row]):
    """A column function: the numbers of the quotes all of whose probes a page has.

    Probes are compared by their first PROBE bytes, as one number: what has all letters of a probe has these.
    """
    owners: dict[int, list[int]] = {}
    for i, r in enumerate(quotes):
        for probe in {int.from_bytes(probe.encode()[:PROBE], "little") for probe in r["_probes"]}:
            owners.setdefault(probe, []).append(i)
    probes = np.array(sorted(owners), dtype=np.uint64)
    sizes = np.array([len(owners[p]) for p in probes.tolist()], dtype=np.int64)
    owner = np.array([i for p in probes.tolist() for i in owners[p]], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    needed = np.bincount(owner, minlength=len(quotes))
    always = np.flatnonzero(needed == 0)
    many = max(len(quotes), 1)

    def hashed(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)

    def search(pages: pa.Array) -> pa.Array:
        likely = np.zeros(1 << BITS, dtype=bool)
        likely[hashed(probes)] = True
        pages = pages.cast(pa.large_string())
        ends = np.frombuffer(pages.buffers()[1], dtype=np.int64)[pages.offset : pages.offset + len(pages) + 1]
        data = np.frombuffer(pages.buffers()[2] or b"", dtype=np.uint8)[: ends[-1]]
        met = [np.empty(0, dtype=np.int64)]
        for a in range(int(ends[0]), len(data) - PROBE + 1 if len(probes) else 0, STRETCH):
            part = data[a : a + STRETCH + PROBE - 1].astype(np.uint64)
            n = len(part) - PROBE + 1
            grams = part[:n].copy()
            for k in range(1, PROBE):
                grams |= part[k : n + k] << np.uint64(8 * k)
            at = np.flatnonzero(likely[hashed(grams)])
            probe = np.minimum(np.searchsorted(probes, grams[at]), len(probes) - 1)
            at, probe = (x[probes[probe] == grams[at]] for x in (at, probe))
            page = np.searchsorted(ends, at + a, side="right") - 1
            inside = at + a + PROBE <= ends[page + 1]
            met.append(np.unique(page[inside] * len(probes) + probe[inside]))
        page, probe = np.divmod(np.unique(np.concatenate(met)), max(len(probes), 1))
        n = sizes[probe] if len(probes) else probe
        which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[probe] if len(probes) else probe, n)
        pairs, counts = np.unique(np.repeat(page, n) * many + owner[which], return_counts=True)
        pairs = pairs[counts == needed[pairs % many]] if len(pairs) else pairs
        pairs = np.sort(np.concatenate([pairs, np.add.outer(np.arange(len(pages)) * many, always).ravel()]))
        offsets = np.searchsorted(pairs, np.arange(len(pages) + 1) * many)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs % many, pa.int32()))

    return F.arrow_udf(search, "array<int>")


def met_by_words(wanted: DataFrame, read: DataFrame) -> DataFrame:
    """What `met_where_read` gives, for any number of probes: substrings are taken once of each distinct word, and ids only are joined."""
    asked = wanted.filter(F.size("_probes") > 0).select("quote_id", F.size("_probes").alias("_all"), F.explode("_probes").alias("probe"))
    others = wanted.filter(F.size("_probes") == 0)
    words = F.filter(F.array_distinct(F.split("_p", " ")), lambda w: F.length(w) >= PROBE)
    held = read.select("page_id", F.explode(words).alias("word"))
    inside = F.transform(F.sequence(F.lit(1), F.length("word") - PROBE + 1), lambda i: F.substring(F.col("word"), i, F.lit(PROBE)))
    spelt = held.select("word").distinct().select("word", F.explode(F.array_distinct(inside)).alias("probe"))
    met = held.join(spelt.join(asked, "probe"), "word").groupBy("page_id", "quote_id", "_all").agg(F.count_distinct("probe").alias("_n"))
    met = met.filter("_n = _all").select("page_id", "quote_id")
    if others.limit(1).count():
        met = met.unionByName(read.select("page_id").crossJoin(others.select("quote_id")))
    return met.join(wanted.select("quote_id", "_q"), "quote_id").join(read, "page_id").select("quote_id", "page_id", "_q", "_p")
