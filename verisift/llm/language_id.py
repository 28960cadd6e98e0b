"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed letter bigrams and trigrams. Document
frequencies are counted over all training documents in Spark; centroids are clustered
per language from a bounded sample of them. A text gets the language of the centroid
of the highest cosine, and is rejected if even that cosine lies under a limit that
depends on its length and on that language. Limits come from what texts of no known
language reach: each language's sample without its own centroids, and with its letters
drawn anew; but a limit is never more than nearly all texts of the language itself reach.

Defined results
- null text, or text without a letter: `und`, score 0, rejected.
- null or repeated ids: the id is only passed on; a null id is not held out.
- rows with a null language are predicted but not learned from.
- equal cosines: the language first in order.
- no training row: every text is `und` with score 0 and rejected; an empty table: no rows.
- texts of any length are read whole, in pieces of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verisift.llm.common import cut_lineage, in_arrow, small

#: Dimensions of the hashed vectors.
DIM = 4096
#: Centroids per language.
CENTROIDS = 3
#: Documents per language that centroids and limits are fitted on at most.
SAMPLE = 300
#: A cluster of a smaller share of its language's sample is dropped: mislabelled texts gather in such.
LEAST_CLUSTER = 0.1
#: Texts, and characters, that are made into vectors at once.
BATCH_TEXTS, BATCH_CHARS = 64, 250_000
#: Lengths for which a limit is fitted; a longer text has the last one's limit, a shorter one none.
LENGTHS = (10, 20, 40, 80, 160, 320, 640)
#: A limit is what all but FOREIGN of texts of no known language stay below, but not more than all but OWN of a language's texts reach.
FOREIGN, OWN = 0.05, 0.03

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def _count(pieces: list[tuple[int, str]], out: np.ndarray) -> None:
    """Add each piece's n-grams to the row of out that it names. A run of other characters is one space."""
    at = np.frombuffer("  ".join(p for _, p in pieces).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.repeat([r for r, _ in pieces], [len(p.lower()) + 2 for _, p in pieces])[: len(at)]
    letter = letters()[at]
    keep = letter | np.concatenate([[True], letter[:-1]])  # of a run of others, the first
    code, rows, letter = np.where(letter, at, 32)[keep].astype(np.uint32), rows[keep], letter[keep]
    if len(code) < 2:
        return
    pair = (code[:-1] * np.uint32(0x9E3779B1)) ^ (code[1:] * np.uint32(0x85EBCA77))
    same = rows[:-1] == rows[1:]
    keys = [(rows[:-1] * DIM + (pair * np.uint32(0x27D4EB2F) >> np.uint32(20)))[same]]
    if len(code) > 2:
        three = (pair[:-1] * np.uint32(0xC2B2AE3D)) + (code[2:] * np.uint32(0x165667B1))
        keys.append((rows[:-2] * DIM + (three * np.uint32(0x27D4EB2F) >> np.uint32(20)))[same[:-1] & same[1:]])
    out += np.bincount(np.concatenate(keys), minlength=out.size).reshape(out.shape)


def counts(texts: list[str | None]) -> np.ndarray:
    """n-gram counts, a row for each text."""
    out = np.zeros((len(texts), DIM), dtype=np.int64)
    batch: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for a in range(0, len(text or ""), BATCH_CHARS):
            piece = text[max(0, a - 2) : a + BATCH_CHARS]
            if batch and size + len(piece) > BATCH_CHARS:
                _count(batch, out)
                batch, size = [], 0
            batch.append((i, piece))
            size += len(piece)
    if batch:
        _count(batch, out)
    return out


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    weight = np.log1p(counts(texts)).astype(np.float32) * idf
    return weight / np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-9)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _grouped(values: list) -> Iterator[slice]:
    for a in range(0, len(values), BATCH_TEXTS):
        yield slice(a, a + BATCH_TEXTS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): in how many of the partition's texts each dimension occurs; gram -1 counts the texts."""
    total = np.zeros(DIM + 1, dtype=np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for part in _grouped(texts):
            total[:DIM] += (counts(texts[part]) > 0).sum(axis=0)
        total[DIM] += len(texts)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(some == DIM, -1, some)), pa.array(total[some])], ["gram", "n"])


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids; the first start is the mean's nearest row, each next the row farthest from those before."""
    mean = x.mean(axis=0)
    starts = [int(np.argmax(x @ mean))]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin((x @ x[starts].T).max(axis=1))))
    centres = x[starts]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        means = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    sizes = np.bincount(np.argmax(x @ centres.T, axis=1), minlength=len(centres))
    return centres[sizes >= LEAST_CLUSTER * len(x)]


class Model:
    def __init__(self, langs: list[str], centres: np.ndarray, idf: np.ndarray, limits: np.ndarray):
        self.langs, self.centres, self.idf, self.limits = langs, centres, idf, limits


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model | None:
    """Learn from rows with a language; the sample of each language is dealt by a hash of id and text."""
    known = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, lang_col, text_col)
    rows = (
        known.select(text_col)
        .transform(in_arrow, _frequencies, "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    seen = {r["gram"]: r["n"] for r in rows}
    if not seen.get(-1):
        return None
    df = np.array([seen.get(i, 0) for i in range(DIM)], dtype=np.float64)
    idf = np.log((1 + seen[-1]) / (1 + df)).astype(np.float32) + np.float32(0.1)

    # a part of each language's rows by their hash, a few times the sample, repeated rows once; then the first of them
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    hashed = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), key.alias("_h"))
    sizes = small(cut_lineage(hashed.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_rows"))))
    part = hashed.join(sizes, "lang").filter(F.pmod("_h", F.lit(1_000_000)) * F.col("_rows") <= F.lit(3 * SAMPLE) * 1_000_000)
    once = part.groupBy("lang", "_h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    sample = once.withColumn("_n", rank).filter(F.col("_n") <= SAMPLE).select("lang", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x, t) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            for part in _grouped(rows):
                v = vectors([t for _, t in rows[part]], idf)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows[part]], pa.string()), pa.array([x.tobytes() for x in v], pa.binary())], ["lang", "v"])

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        centres = spherical_means(np.stack([np.frombuffer(v, dtype=np.float32) for v in rows["v"].sort_values()]), CENTROIDS)
        return pd.DataFrame([(rows["lang"].iloc[0], c.astype(np.float32).tobytes()) for c in centres], columns=["lang", "v"])

    found = sample.transform(in_arrow, made, "lang string, v binary").groupBy("lang").applyInPandas(fitted, "lang string, v binary").collect()
    centres = sorted((r["lang"], r["v"]) for r in found)
    if not centres:
        return None
    langs, of = [c[0] for c in centres], np.stack([np.frombuffer(c[1], dtype=np.float32) for c in centres])
    return Model(langs, of, idf, _limits(sample, langs, of, idf))


def _redrawn(text: str) -> str:
    """The text with each of its letters drawn anew among those that it has."""
    lower = text.lower()
    some = sorted({c for c in lower if c.isalpha()})
    draw = np.random.default_rng(zlib.crc32(lower.encode("utf-8", "surrogatepass"))).integers(0, len(some), len(lower))
    return "".join(some[i] if c.isalpha() else c for c, i in zip(lower, draw, strict=True))


def _limits(sample: DataFrame, langs: list[str], centres: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The least cosine for a centroid and each of LENGTHS.

    Pieces of the sample are compared with their own language; with all others, as if their own had
    been left out; and once more with their letters drawn anew. The last two are of no known language.
    """
    names = np.array(langs)
    known = sorted(set(langs))
    firsts = np.searchsorted(names, known)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                middle = [text[len(text) // 3 :][:n] for n in LENGTHS]
                pieces = [(i, m) for i, m in enumerate(middle) if len(m) == LENGTHS[i] and has_letter(m)]
                if lang not in known or not pieces:
                    continue
                texts = [m for _, m in pieces]
                near = np.maximum.reduceat(vectors([*texts, *map(_redrawn, texts)], idf) @ centres.T, firsts, axis=1)
                own = known.index(lang)
                others = np.delete(near[: len(texts)], own, axis=1)
                for j, (i, _) in enumerate(pieces):
                    rows.append((lang, i, float(near[j, own])))
                    rows.append((None, i, float(near[len(texts) + j].max())))
                    if len(known) > 1:
                        rows.append((None, i, float(others[j].max())))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64()), strict=True)], ["lang", "size", "near"])

    seen = sample.transform(in_arrow, compared, "lang string, size int, near double").groupBy("lang", "size")
    found = {(r["lang"], r["size"]): r["q"] for r in seen.agg(F.percentile("near", F.array(F.lit(OWN), F.lit(1 - FOREIGN))).alias("q")).collect()}
    return np.array([[min(found.get((x, i), [0.0])[0], found.get((None, i), [0.0, 0.0])[1]) for i in range(len(LENGTHS))] for x in langs])


def judged(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and whether it is accepted, for each text."""
    langs, scores, accepted = [], [], []
    for part in _grouped(texts):
        some = [model is not None and has_letter(t) for t in texts[part]]
        if not any(some):
            langs, scores, accepted = langs + ["und"] * len(some), scores + [0.0] * len(some), accepted + [False] * len(some)
            continue
        near = vectors(texts[part], model.idf) @ model.centres.T
        best = near.argmax(axis=1)
        top = np.clip(near[np.arange(len(best)), best].astype(np.float64), 0, 1)
        size = np.searchsorted(LENGTHS, [len(t or "") for t in texts[part]], side="right") - 1
        limit = np.where(size < 0, 0.0, model.limits[best, np.clip(size, 0, len(LENGTHS) - 1)])
        langs += [model.langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
        scores += [float(x) if s else 0.0 for x, s in zip(top, some, strict=True)]
        accepted += [bool(s and x >= y) for x, y, s in zip(top, limit, some, strict=True)]
    return langs, scores, accepted


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns with lang_pred, score and accepted; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, accepted = judged(batch.column(len(keep)).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())],
                [*keep, "lang_pred", "score", "accepted"],
            )

    return docs.select(*keep, text_col).transform(in_arrow, predicted, ", ".join([*schema, "lang_pred string", "score double", "accepted boolean"]))


def accepted_only(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that aren't rejected, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(~held_out())))
    at = docs.columns.index(text_col)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, accepted = judged(batch.column(at).to_pylist(), shared.value)
            yield batch.filter(pa.array(accepted, pa.bool_()))

    return docs.transform(in_arrow, filtered, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the documents that aren't held out, then judge all of them."""
    model = fit(docs.filter(~held_out()))
    return predict(docs, model, keep=keep)


def digest(docs: DataFrame) -> DataFrame:
    return identify(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
