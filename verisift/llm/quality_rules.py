"""Quality rules: cross-document line frequency, in DataFrame functions only.

A line that many documents of one host share is boilerplate. Lines are normalised and
hashed, the distinct documents of each (host, line) are counted, lines above the limit
are removed, and a document of which too little is left is rejected.

Defined results
- null text: no words, no lines; every count is 0 and the base rules reject it.
- null host: such documents form a host of their own.
- ties and repeated rows: the rows of one id count as one document of their host, and each
  row is returned; documents without an id lose lines but aren't counted.
- a column of the input named like one of this module's is not read; only the three
  columns named in the arguments are.
- an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import SPACE, WORD, cut_lineage, fresh, let, salted_join, small

#: A line is removed if more documents of its host than both limits allow have it.
MIN_DOCUMENTS = 20
MIN_SHARE = 0.002
#: A document is depleted if a smaller share of its words than this is left.
LEAST_LEFT = 0.3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lines_of(text: Column) -> Column:
    """The lines of the text that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, f"{SPACE}+", " ")))


def repeated_window_words(words: Column, k: int = 5) -> Column:
    """How many words stand in a window of k words that the array holds twice or more."""

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = let(
            ranked,
            lambda s: F.sort_array(
                F.filter(
                    F.transform(
                        s,
                        lambda x, i: F.when(
                            F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
                            x["i"],
                        ),
                    ),
                    lambda x: x.isNotNull(),
                )
            ),
        )
        step = let(
            at,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(step)

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
        )

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.when(F.size(h) > k, let(windows(h), covered)).otherwise(F.lit(0)))


def base_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with the counts of the base rules and their verdict."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("doc_id"), *keep, text.alias("_t"), words_of(text).alias("_w"), lines_of(text).alias("_l")
    )
    counted = read.select(
        "doc_id",
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - F.regexp_count("_t", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("_w")).cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def line_table(docs: DataFrame, host_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each distinct normalised line of each document: host, doc_id, key, line, words, times."""
    hashed = F.transform(
        lines_of(F.col(text_col)),
        lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words")),
    )
    summed = F.transform(
        F.array_distinct(F.col("_h")["line"]),
        lambda h: F.struct(
            h.alias("line"), F.aggregate(F.filter(F.col("_h"), lambda x: x["line"] == h), F.lit(0), lambda a, x: a + x["words"]).alias("words")
        ),
    )
    rows = docs.select(
        F.coalesce(F.col(host_col), F.lit("")).alias("host"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("text_key"),
        hashed.alias("_h"),
    )
    unique = F.size(F.array_distinct(F.col("_h")["line"])) == F.size("_h")
    each = rows.select("host", "doc_id", "text_key", F.explode(F.when(unique, F.col("_h")).otherwise(summed)).alias("_x"))
    return each.select("host", "doc_id", "text_key", "_x.line", "_x.words")


def frequent_lines(
    lines: DataFrame,
    docs: DataFrame,
    host_col: str = "source",
    id_col: str = "doc_id",
    min_documents: int = MIN_DOCUMENTS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """(host, line, documents) of the lines above the limits, line being the normalised line's hash.

    Distinct ids are counted, so that repeated rows count once: the rows of a line that a
    third of all documents share are dealt out by id, and their counts summed.
    """
    host = F.coalesce(F.col(host_col), F.lit("")).alias("host")
    sizes = docs.select(host, F.col(id_col).alias("_id")).groupBy("host").agg(F.countDistinct("_id").alias("_all"))
    counts = lines.groupBy("host", "line").agg(F.countDistinct("doc_id").alias("documents")).filter(F.col("documents") > min_documents)
    return (
        counts.join(sizes, "host").filter(F.col("documents") > F.col("_all") * min_share).select("host", "line", "documents")
    )


def removed_lines(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, text_key, removed): hashes and words of the lines that each document loses."""
    lines = cut_lineage(line_table(docs, host_col, id_col, text_col))
    frequent = small(cut_lineage(frequent_lines(lines, docs, host_col, id_col, **limits).select("host", "line")))
    return (
        salted_join(lines, frequent, ["host", "line"], "doc_id")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("line", "words")).alias("removed"))
    )


def remove_frequent_lines(
    docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **limits
) -> DataFrame:
    """The documents with their frequent lines cut out of the text; all columns stay."""
    gone = removed_lines(docs, host_col, id_col, text_col, **limits)
    name, key, lines = (fresh(docs, n) for n in ("_name", "_key", "_gone"))
    gone = gone.select(F.col("doc_id").alias(name), F.col("text_key").alias(key), F.col("removed")["line"].alias(lines))
    same = F.col(id_col).eqNullSafe(F.col(name)) & (F.xxhash64(text_col) == F.col(key))
    lost = F.col(lines)
    kept = F.array_join(
        F.filter(F.split(text_col, "\n", -1), lambda x: ~F.coalesce(F.array_contains(lost, F.xxhash64(normalised(x))), F.lit(False))), "\n"
    )
    cut = F.when(lost.isNull(), F.col(text_col)).otherwise(kept)
    return docs.join(gone, same, "left").select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def quality(
    docs: DataFrame,
    host_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    least_left: float = LEAST_LEFT,
    **limits,
) -> DataFrame:
    """The base rules and the line-frequency verdict, a row for each document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    gone = removed_lines(docs, "host", **limits).select(
        "doc_id",
        "text_key",
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("n_removed_words"),
    )
    base = base_columns(docs.withColumn("text_key", F.xxhash64("text")), keep=("text_key",))
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        base.join(gone, [base["doc_id"].eqNullSafe(gone["doc_id"]), base["text_key"] == gone["text_key"]], "left")
        .select(
            base["doc_id"], *base.columns[2:], F.coalesce("n_removed_words", F.lit(0)).cast("long").alias("n_removed_words")
        )
        .withColumn("depleted", left < least_left * F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )
