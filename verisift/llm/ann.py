"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts; a small network
learns from each sampled vector its part. It then places every vector of the index in
its most probable part, and sends a query to its several most probable ones, where
Spark ranks all vectors by their exact distance. The number of parts grows with the
vectors, one for each PER_PART of them, between PARTS and MOST_PARTS. How many parts a query
probes is the least number that finds TARGET of the neighbours of sampled vectors which
nothing was fitted on, and never fewer than hold as many vectors as are asked for.

Defined results
- vectors that are null, zero, hold null or non-finite components, or are not of the
  most frequent length (the shorter at a tie) take no part.
- a repeated id is one query (its least vector) and one candidate (its nearest vector).
- ties go to the smaller id; fewer candidates than asked for: all of them.
- an empty table, or one without queries, gives no rows; other columns are not read.
- parts of any size are searched whole: they are dealt out in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verisift.llm.common import cut_lineage, in_arrow

#: Vectors that graph and network are fitted on at most, vectors kept apart at most (a fifth
#: of a small sample) to choose the probes by, and neighbours of each in the graph.
SAMPLE, APART, NEIGHBOURS = 4096, 1024, 10
#: Vectors of a part, and the fewest and most parts.
PER_PART, PARTS, MOST_PARTS = 10_000, 16, 256
#: The share of a sampled vector's neighbours that the probed parts must hold.
TARGET = 0.96
#: Vectors, and queries, that meet in one task at most (about).
BLOCK = 4096
HIDDEN, EPOCHS, RATE = 96, 150, 0.02


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    square, out = (x * x).sum(axis=1), []
    for a in range(0, len(x), 1024):
        d = square[a : a + 1024, None] - 2 * x[a : a + 1024] @ x.T + square
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out.append(np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)])
    return np.concatenate(out) if out else np.empty((0, 0), dtype=int)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 12, slack: float = 1.15) -> np.ndarray:
    """A part for each row: grown from spread seeds, then moved to cut fewer edges, none above slack times the mean."""
    n = len(x)
    seeds = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(seeds) < min(parts, n):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(axis=1))
    centres = x[seeds]
    for _ in range(10):
        own = ((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)
        centres = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
    most = int(np.ceil(slack * n / len(seeds)))
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    part, sizes = np.full(n, -1), np.zeros(len(seeds), dtype=int)
    near = d.argsort(axis=1, kind="stable")
    for i in np.argsort(d.min(axis=1), kind="stable"):
        part[i] = next(j for j in near[i] if sizes[j] < most)
        sizes[part[i]] += 1
    both: list[list[int]] = [list(r) for r in graph]
    for i, row in enumerate(graph):
        for j in row:
            both[j].append(i)
    for _ in range(sweeps):
        moved = 0
        for i in range(n):
            votes = np.bincount(part[both[i]], minlength=len(seeds))
            for j in np.argsort(-votes, kind="stable"):
                if votes[j] <= votes[part[i]]:
                    break
                if sizes[j] < most:
                    sizes[part[i]] -= 1
                    sizes[j] += 1
                    part[i] = j
                    moved += 1
                    break
        if not moved:
            break
    return part


class Router:
    """A network of one hidden layer from a vector to the probabilities of the parts."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int):
        draw = np.random.default_rng(7)
        self.scale = np.maximum(np.abs(x).mean(axis=0), 1e-12)
        w = [draw.normal(0, 0.3, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.3, (HIDDEN, parts)), np.zeros(parts)]
        x, goal = x / self.scale, np.eye(parts)[part]
        first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        for t in range(1, EPOCHS + 1):
            h = np.maximum(x @ w[0] + w[1], 0)
            out = (self._soft(h @ w[2] + w[3]) - goal) / len(x)
            back = (out @ w[2].T) * (h > 0)
            for i, g in enumerate((x.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ out + 1e-4 * w[2], out.sum(axis=0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w[i] = w[i] - RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        self.w = w

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._soft(np.maximum(x / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def usable(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, v being an array of doubles, and how many they are."""
    v = F.col("v")
    fine = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull()
        & v.isNotNull()
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists(v, lambda c: c != 0)
    )
    sizes = fine.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return fine.filter(F.size("v") == (sizes[0]["n"] if sizes else 0)), sizes[0]["c"] if sizes else 0


def parts_for(vectors: int) -> int:
    return min(max(vectors // PER_PART, PARTS), MOST_PARTS)


def fit(vectors: DataFrame, k: int, parts: int) -> tuple[Router, int] | None:
    """The router and how many parts a query probes, from a sample dealt by a hash of the id."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE + APART).collect()
    if not rows:
        return None
    x = np.array([r["v"] for r in rows])
    if len(x) == 1:
        return Router(x, np.zeros(1, dtype=int), 1), 1
    apart = max(len(x) // 5, 1)
    x, asked = x[:-apart], x[-apart:]
    part = balanced_parts(x, neighbour_graph(x, NEIGHBOURS), parts)
    router = Router(x, part, part.max() + 1)
    home, p = router.probabilities(x).argmax(axis=1), router.probabilities(asked)
    rank = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1, kind="stable")  # of each part, for each row
    far = (x * x).sum(axis=1) - 2 * asked @ x.T
    near = np.argsort(far, axis=1, kind="stable")[:, :k]
    needed = rank[np.arange(len(asked))[:, None], home[near]]
    probes = next(m for m in range(1, p.shape[1] + 1) if (needed < m).mean() >= TARGET)
    return router, probes


def _placed(batches: Iterator[pa.RecordBatch], router: Router) -> Iterator[pa.RecordBatch]:
    """id, part, and the vector as bytes."""
    for batch in batches:
        if batch.num_rows:
            x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            part = pa.array(router.probabilities(x).argmax(axis=1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), part, pa.array([r.tobytes() for r in x])], ["id", "part", "v"])


def _routed(batches: Iterator[pa.RecordBatch], router: Router, probes: int, counts: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """A query's most probable parts: so many, and more until they hold at least so many vectors."""
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1)
        ids, parts, vs = [], [], []
        for i, order in enumerate(np.argsort(-router.probabilities(x), axis=1, kind="stable")):
            held = np.cumsum(counts[order])
            n = max(probes, int(np.searchsorted(held, least)) + 1)
            for p in order[:n]:
                ids.append(batch.column(0)[i].as_py())
                parts.append(int(p))
                vs.append(x[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(vs, pa.binary())], ["id", "part", "v"])


def nearest(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest of x to each query, in double precision; equal ids count once and never for themselves."""
    out: list[tuple[int, int, float]] = []
    rough = (q * q).sum(axis=1)[:, None] - 2 * q @ x.T + (x * x).sum(axis=1)
    rough[query_ids[:, None] == ids[None, :]] = np.inf
    for i, row in enumerate(rough):
        n = k + 1
        while True:
            n = min(n, len(ids))
            at = np.argpartition(row, n - 1)[:n] if n < len(ids) else np.arange(len(ids))
            edge = row[at].max()
            at = np.flatnonzero(row <= edge + 1e-9 * (1 + abs(edge))) if np.isfinite(edge) else np.flatnonzero(np.isfinite(row))
            exact = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[at], exact))
            _, first = np.unique(ids[at][order], return_index=True)
            best = order[np.sort(first)]
            if len(best) > k or n == len(ids):
                break
            n *= 2
        out += [(int(query_ids[i]), int(ids[at][j]), float(exact[j])) for j in best[:k]]
    return out


def search(rows: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score; `queries` is a condition on the column id."""
    result = "query_id long, vec_id long, score double"
    vectors, n = usable(rows, id_col, vec_col)
    fitted = fit(vectors, k, parts or parts_for(n))
    if fitted is None:
        empty = rows.sparkSession.createDataFrame([], result)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    router, probes = fitted
    index = cut_lineage(vectors.transform(in_arrow, lambda b: _placed(b, router), "id long, part int, v binary"))
    counts = np.zeros(router.w[3].shape[0], dtype=np.int64)
    for r in index.groupBy("part").agg(F.countDistinct("id").alias("n")).collect():
        counts[r["part"]] = r["n"]
    asked = index.filter(queries).groupBy("id").agg(F.min("v").alias("v"))
    probing = asked.transform(in_arrow, lambda b: _routed(b, router, probes, counts, k + 1), "id long, part int, v binary")
    probing = cut_lineage(probing)
    wanted = np.zeros_like(counts)
    for r in probing.groupBy("part").count().collect():
        wanted[r["part"]] = r["count"]

    def blocks(n: np.ndarray):
        return F.get(F.array(*[F.lit(int(-(-c // BLOCK) or 1)) for c in n]), F.col("part"))

    own = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    left = probing.withColumn("qb", own(wanted)).withColumn("vb", every(counts))
    right = index.withColumn("vb", own(counts)).withColumn("qb", every(wanted))

    def ranked(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        matrix = lambda f: np.frombuffer(b"".join(f["v"]), dtype=np.float64).reshape(len(f), -1)
        found = nearest(q["id"].to_numpy(), matrix(q), x["id"].to_numpy(), matrix(x), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ["part", "vb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(ranked, result)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
