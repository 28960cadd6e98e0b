"""Ranked lexical search of all documents for a set of items, by two trees that are searched together.

One pass turns each document into a vector over the items' terms, and counts what the
weights need. Within a task, blocks of documents become a tree: a node holds, for each
term, the greatest impact in any of its documents. The items of a block form a tree too,
whose nodes hold each term's greatest weight in any of their items. The product of two
nodes bounds the score of every document of the one for every item of the other, and a
pair of nodes is dropped if that is less than the weakest kth score among its items. A kth
score is at least that of a small sample of the documents, which is searched first, and
rises while a task goes on. Dropping is exact: all documents are searched.

Products are sums of integers below 2**53, so that doubles hold them exactly.

Defined results
- null and empty texts, and texts without a term: not counted and never found.
- each row of documents is a document, repeated rows and null ids too; a null id comes last among equal scores.
- rows of one item id are one item with the terms of all of them; an item without a term has no rows.
- very long texts are read whole; a term's repeats count once for an item.
- empty tables give no rows; columns beside id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verisift.llm.common import cut_lineage, in_arrow

#: Items that are searched for together; more items are taken in several blocks.
BLOCK = 256
#: One of so many documents is searched first.
SAMPLE = 64
#: Numbers in the dense matrix of a tree of documents.
CELLS = 1 << 20
#: Documents and items of a leaf.
DOCS_IN_LEAF, ITEMS_IN_LEAF = 16, 8
#: Terms of an item up to which doubles hold all scores.
EXACT = 100_000

#: Bytes that end a term become spaces, and A-Z lower case; bytes over 0x7F belong to terms.
TERM_BYTES = bytes(
    b if b > 0x7F or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, their terms by number, and which item has which."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    owners: np.ndarray
    held: np.ndarray

    @property
    def most_terms(self) -> int:
        return int(np.bincount(self.owners).max())


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms(x.as_py()))) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["id", "terms"])


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items with terms, in blocks of about BLOCK."""
    found = in_arrow(_texts(items, id_col, text_col), _item_terms, "id long, terms array<binary>").filter(F.size("terms") > 0)
    found = cut_lineage(found)
    blocks = math.ceil(found.count() / BLOCK)
    for i in range(blocks):
        mine: dict[int | None, set[bytes]] = {}
        for row in found.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect():
            mine.setdefault(row.id, set()).update(map(bytes, row.terms))
        if mine:
            vocabulary = {t: j for j, t in enumerate(sorted(set().union(*mine.values())))}
            pairs = np.array([(j, vocabulary[t]) for j, own in enumerate(mine.values()) for t in own])
            yield Items(list(mine), vocabulary, pairs[:, 0], pairs[:, 1])


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n (all terms), and numbers and counts of the vocabulary's terms, for each document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            ids, sizes, which, often = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(text.as_py())
                if found:
                    own = Counter(map(number, found))
                    own.pop(None, None)
                    ids.append(i)
                    sizes.append(len(found))
                    which.append(list(own))
                    often.append(list(own.values()))
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "tf"])

    return in_arrow(_texts(docs, id_col, text_col), run, "id long, n long, terms array<int>, tf array<int>")


def halves(rows: np.ndarray, weights: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The leaves of a tree over the rows of a matrix: a set of rows is halved along the column that tells most of them apart."""
    if len(rows) <= leaf:
        return [rows]
    own = weights[rows]
    along = own[:, np.argmax(own.var(axis=0))]
    order = rows[np.argsort(along, kind="stable")]
    middle = leaf * (-(-len(rows) // leaf) // 2)
    return halves(order[:middle], weights, leaf) + halves(order[middle:], weights, leaf)


def maxima(leaves: np.ndarray) -> list[np.ndarray]:
    """Of a tree's levels the nodes' greatest values, the root first and the leaves last; a node's children are 2i and 2i + 1."""
    levels = [leaves]
    while len(levels[0]) > 1:
        below = levels[0]
        above = below[::2].copy()
        np.maximum(above[: len(below) // 2], below[1::2], out=above[: len(below) // 2])
        levels.insert(0, above)
    return levels


class Search:
    """The best documents of each item among those that it was shown."""

    def __init__(self, items: Items, weights: np.ndarray, least: np.ndarray, k: int):
        kind = np.float64 if items.most_terms < EXACT else np.int64
        self.weights = np.zeros((len(items.ids), len(items.vocabulary)), dtype=kind)
        self.weights[items.owners, items.held] = weights[items.held]
        self.leaves = halves(np.arange(len(items.ids)), self.weights, ITEMS_IN_LEAF)
        self.levels = maxima(np.array([self.weights[x].max(axis=0) for x in self.leaves]))
        self.items, self.k, self.kind = items, k, kind
        #: scores that the kth document has at least; a score of 0 is none
        self.least = np.maximum(least, 1)
        self.scores = [np.empty(0, dtype=np.int64) for _ in items.ids]
        self.found = [np.empty((0, 2), dtype=np.int64) for _ in items.ids]

    def weakest(self, level: int) -> np.ndarray:
        """For each node of a level of the items' tree the weakest kth score among its items."""
        out = np.array([self.least[x].min() for x in self.leaves])
        for _ in range(len(self.levels) - 1 - level):
            out = np.minimum.reduceat(out, np.arange(0, len(out), 2))
        return out

    def add(self, ids: np.ndarray, impacts: np.ndarray) -> None:
        """ids: the id and whether there is one, a row for each row of impacts."""
        leaves = halves(np.arange(len(ids)), impacts, DOCS_IN_LEAF)
        levels = maxima(np.array([impacts[x].max(axis=0) for x in leaves]))
        alive = np.ones((1, 1), dtype=bool)
        for step in range(max(len(levels), len(self.levels))):
            d, i = min(step, len(levels) - 1), min(step, len(self.levels) - 1)
            if step:  # from pairs of nodes to the pairs of their children
                if step < len(levels):
                    alive = np.repeat(alive, 2, axis=0)[: len(levels[d])]
                if step < len(self.levels):
                    alive = np.repeat(alive, 2, axis=1)[:, : len(self.levels[i])]
            rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(rows):
                return
            bound = levels[d][rows] @ self.levels[i][columns].T
            alive[np.ix_(rows, columns)] &= bound >= self.weakest(i)[columns]
        for j in np.flatnonzero(alive.any(axis=0)):
            own, rows = self.leaves[j], np.concatenate([leaves[x] for x in np.flatnonzero(alive[:, j])])
            scores = impacts[rows] @ self.weights[own].T
            for column, item in enumerate(own):
                some = np.flatnonzero(scores[:, column] >= self.least[item])
                if len(some):
                    self.keep(item, scores[some, column].astype(np.int64), ids[rows[some]])

    def keep(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[item], scores]), np.concatenate([self.found[item], ids])
        best = np.lexsort((ids[:, 0], -ids[:, 1], -scores))[: self.k]
        self.scores[item], self.found[item] = scores[best], ids[best]
        if len(best) == self.k:
            self.least[item] = max(self.least[item], scores[best[-1]])

    def rows(self) -> pa.RecordBatch:
        n = [len(x) for x in self.scores]
        ids = np.concatenate(self.found)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(n)), n), pa.int32()),
                pa.array(ids[:, 0], pa.int64(), mask=ids[:, 1] == 0),
                pa.array(np.concatenate(self.scores), pa.int64()),
            ],
            ["item", "doc_id", "score"],
        )


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def best(found: DataFrame, items: Items, weights: np.ndarray, least: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item (its number in the block), doc_id and score of at most k documents for each item and task."""
    terms_ = len(items.vocabulary)
    at_once = max(DOCS_IN_LEAF, CELLS // terms_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, weights, least, k)
        for whole in batches:
            for a in range(0, whole.num_rows, at_once):
                batch = whole.slice(a, at_once)
                ids = np.array([(x or 0, x is not None) for x in batch.column(0).to_pylist()], dtype=np.int64)
                m = np.array([50 + (50 * n * documents) // length for n in batch.column(1).to_pylist()], dtype=np.int64)
                which, tf = (x.flatten().to_numpy(zero_copy_only=False) for x in (batch.column(2), batch.column(3)))
                owner = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
                impacts = np.zeros((batch.num_rows, terms_), dtype=search.kind)
                impacts[owner, which] = impact(tf.astype(np.int64), m[owner])
                search.add(ids, impacts)
        yield search.rows()

    return in_arrow(found, run, "item int, doc_id long, score long")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(docs: DataFrame, items: Items, k: int, id_col: str, text_col: str) -> DataFrame:
    read = cut_lineage(vectors(docs, items.vocabulary, id_col, text_col))
    documents, length = read.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(items.vocabulary), dtype=np.int64)
    for term, df in read.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    found = read.filter(F.size("terms") > 0)
    none = np.zeros(len(items.ids), dtype=np.int64)
    first = ranked(best(found.filter(F.pmod(F.xxhash64("id", "n"), F.lit(SAMPLE)) == 0), items, weights, none, documents, length, k), k)
    least = none.copy()
    for item, score in first.filter(F.col("rank") == k).select("item", "score").collect():
        least[item] = score
    rows = ranked(best(found, items, weights, least, documents, length, k), k)
    names = F.array(*[F.lit(i).cast("long") for i in items.ids])
    return rows.select(F.get(names, F.col("item")).alias("item_id"), "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k highest-scoring documents."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, item_col, item_text_col):
        out = out.unionByName(_searched(docs, block, k, id_col, text_col))
    return out
