"""Sampled segmentation into the pieces of a SentencePiece vocabulary, and decoding.

Forward filtering, backward sampling: the lattice of all ways to write a text in pieces
weighs a way by the product of its pieces' weights, (1 + rank) ** -THETA, rank being the
piece's place in the vocabulary. Forward sums are computed once per distinct word, since
no piece reaches over the start of a word, and backward steps are drawn for all words of
a batch at once. The random numbers are a hash of the row's key, the word's place and
the step: a row's segmentation depends on nothing but its key and text.

A character outside the vocabulary, and a literal U+2581, is written as byte pieces, so
that decoding gives back every text.

Defined results
- null text gives null ids; the empty text gives no ids.
- a null key is the key 0; repeated rows get the same ids.
- an empty table gives no rows; columns beside id and text are not read.
- very long words and texts are read whole; the word cache is bounded and its clearing
  changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import in_arrow, kept
from verisift.llm.shingles import mixed

SPACE = "▁"
THETA = 0.3
#: Distinct words whose lattices a worker keeps, and characters whose words are sampled at once.
CACHE_WORDS = 400_000
BATCH_CHARS = 1_000_000
#: Characters of words whose lattices are summed at once, and above which a word is summed on its own, place by place.
ADD_CHARS, LONG = 100_000, 64
#: Size of the table that rules out substrings that are no piece.
SIEVE = 1 << 22
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


#: The word that stands for U+0000, marked by a private character.
NUL = "\ue0ffNUL"


class Column:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1024, dtype=dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(self.n, len(values)), dtype=self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Lattices:
    """Backward distributions of distinct words, as flat arrays over their nodes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.raw = [names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece reaches over the start of a word")
        self.lengths = np.array([len(x) for x in names], dtype=np.int64)
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        self.weight = np.array([*[(1.0 + rank.get(i, 0)) ** -THETA for i in range(n)], 0.0])  # the last stands for no piece
        self.longest = max(len(names[i]) for i in plain)
        self.letters = np.zeros((n, self.longest), dtype=np.uint32)
        hashes = {}
        for i in plain:
            code = self._codes(names[i])
            self.letters[i, : len(code)] = code
            h = np.full(1, len(code), dtype=np.uint64)
            for c in code:
                h = h * _FACTOR + c
            hashes[int(mixed(h)[0])] = i
        if len(hashes) < len(plain):
            raise ValueError("two pieces have the same hash")
        self.hashes = np.array(sorted(hashes), dtype=np.uint64)
        self.hashed = np.array([hashes[int(h)] for h in self.hashes], dtype=np.int32)
        self.sieve = np.zeros(SIEVE, dtype=bool)
        self.sieve[(self.hashes % np.uint64(SIEVE)).astype(np.int64)] = True
        self.pool = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in self.raw], dtype=np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        chars = {names[i] for i in plain if len(names[i]) == 1} - {SPACE}
        known = "".join(sorted(re.escape(c) for c in chars))
        # U+0000 stands for a space here, so that a literal U+2581 stays another character
        self.words = re.compile(f"\0*[{known}]+|\0+|[^\0{known}]")
        self.chars = frozenset(chars)
        self.clear()

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.first = Column(np.int64)  # of a word: its first node
        self.nodes = Column(np.int64)  # of a word: how many steps of one place it has
        self.edge = Column(np.int64)  # of a node: its first edge
        self.edge.extend(np.zeros(1, dtype=np.int64))
        self.key = Column(np.float64)  # of an edge: the summed probability of its node's edges up to it
        self.piece = Column(np.int32)
        self.step = Column(np.uint8)

    def add(self, words: list[str]) -> None:
        """Learn distinct words that aren't known yet."""
        ordinary = [w for w in words if w[0] in self.chars or w[0] == "\0"]
        other = [w for w in words if not (w[0] in self.chars or w[0] == "\0")]
        group: list[str] = []
        size = 0
        for w in [*ordinary, None]:
            if group and (w is None or size + len(w) > ADD_CHARS):
                self._add(group, *self._forward(group))
                group, size = [], 0
            if w is not None:
                group.append(w)
                size += len(w)
        if other:
            data = [[self.byte[b] for b in w.encode()] for w in other]
            pieces = np.array([p for d in data for p in d])
            at = np.arange(len(pieces))
            self._add(other, np.array([len(d) for d in data]), at, pieces, np.ones(len(pieces), dtype=np.int64), np.ones(len(pieces)))

    def _pieces(self, code: np.ndarray, left: np.ndarray) -> np.ndarray:
        """For each place and length - 1 the piece that ends there, else -1; left: places to the word's end."""
        found = np.full((len(code), self.longest), -1, dtype=np.int32)
        start = np.arange(len(code))
        for size in range(1, self.longest + 1):
            start = start[left[start] >= size]
            if not len(start):
                break
            h = np.full(len(start), size, dtype=np.uint64)
            for j in range(size):
                h = h * _FACTOR + code[start + j]
            h = mixed(h)
            some = np.flatnonzero(self.sieve[(h % np.uint64(SIEVE)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            some, at = some[self.hashes[at] == h[some]], at[self.hashes[at] == h[some]]
            piece, begin = self.hashed[at], start[some]
            same = (self.letters[piece, :size] == code[begin[:, None] + np.arange(size)]).all(axis=1)
            found[begin[same] + size - 1, size - 1] = piece[same]
        return found

    def _forward(self, words: list[str]):
        """Of the words: lengths; of their edges in order of their end: node, piece, length and weight."""
        length = np.array([len(w) for w in words], dtype=np.int64)
        code = self._codes("".join(words).replace("\0", SPACE))
        start = np.cumsum(length) - length
        found = self._pieces(code, np.repeat(start + length, length) - np.arange(len(code)))
        # total[i + word + 1] is the sum after place i, total[start + word] that before a word
        total, back = np.zeros(len(code) + len(words) + self.longest), np.arange(1, self.longest + 1)
        base = start + np.arange(len(words)) + self.longest
        total[base] = 1.0
        value = np.empty(found.shape)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] <= LONG]
        sizes = -length[order]
        for place in range(LONG):
            active = order[: np.searchsorted(sizes, -place, side="left")]
            if not len(active):
                break
            node, at, most = start[active] + place, base[active] + place + 1, min(place + 1, self.longest)
            sums = total[at[:, None] - back[:most]] * self.weight[found[node, :most]]
            value[node, :most] = sums
            total[at] = sums.sum(axis=1)
        for w in np.flatnonzero(length > LONG):  # the sums before a place are scaled alike as soon as they get large or small
            for place in range(length[w]):
                node, at = start[w] + place, base[w] + place + 1
                value[node] = total[at - back] * self.weight[found[node]]
                total[at] = value[node].sum()
                if not 1e-100 < total[at] < 1e100:
                    total[max(at - self.longest, base[w]) : at + 1] /= total[at]
        node, size = np.nonzero(found >= 0)
        return length, node, found[node, size], size + 1, value[node, size]

    def _add(self, words, nodes, node, piece, step, value) -> None:
        """node: of each edge, from 0, in order; nodes: how many each word has."""
        count = np.bincount(node, minlength=int(nodes.sum()))
        first = np.concatenate([[0], np.cumsum(count)])
        whole = np.add.reduceat(value, first[:-1])
        if not (np.isfinite(whole).all() and (whole > 0).all()):
            raise ArithmeticError("a word's sums are out of range")
        share = value / np.repeat(whole, count)
        before = np.concatenate([[0.0], np.cumsum(share)])[first[:-1]]
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.first.extend(self.edge.n - 1 + np.cumsum(nodes) - nodes)
        self.nodes.extend(nodes)
        self.edge.extend(self.edge.data[self.edge.n - 1] + first[1:])
        self.key.extend(np.cumsum(share) - np.repeat(before, count))
        self.piece.extend(piece)
        self.step.extend(step)

    def sample(self, word: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all words in order, and how many each has."""
        first, at = self.first.data[word], self.nodes.data[word]
        edge, key = self.edge.data, self.key.data
        active, steps = np.argsort(word, kind="stable"), 0  # near words are near in memory
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        number = np.zeros(len(word), dtype=np.int64)
        halvings = range(self.longest.bit_length())
        while len(active):
            u = (mixed(seed[active] + np.uint64(steps * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            node = first[active] + at[active] - 1
            low, high = edge[node], edge[node + 1] - 1
            for _ in halvings:  # the node's first edge whose sum is over u, or its last
                middle = (low + high) >> 1
                over = key[middle] > u
                low, high = np.where(over, low, np.minimum(middle + 1, high)), np.where(over, middle, high)
            taken.append((active, self.piece.data[low]))
            at[active] -= self.step.data[low]
            number[active] += 1
            active = active[at[active] > 0]
            steps += 1
        ends = np.cumsum(number)
        out = np.empty(ends[-1] if len(ends) else 0, dtype=np.int32)
        for j, (who, piece) in enumerate(taken):
            out[ends[who] - 1 - j] = piece
        return out, number

    def encode(self, keys: list[int | None], texts: list[str]) -> list[np.ndarray]:
        """The sampled ids of each text; together they should not exceed BATCH_CHARS by much."""
        split = [self.words.findall("\0" + t.replace("\0", "").replace(" ", "\0")) if t else [] for t in texts]
        if any("\0" in t for t in texts):  # U+0000 itself goes to its byte piece
            split = [self._with_nul(t) if "\0" in t else s for t, s in zip(texts, split, strict=True)]
        seen = set().union(*split)
        if missing := seen.difference(self.index):
            if len(self.index) + len(missing) > CACHE_WORDS:
                self.clear()
                missing = set(seen)
            if NUL in missing:  # it is no word of the pieces', and is put back when the words were cleared
                missing.remove(NUL)
                self._add([NUL], np.array([1]), np.array([0]), np.array([self.byte[0]]), np.array([1]), np.array([1.0]))
            self.add(sorted(missing))
        counts = [len(s) for s in split]
        word = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sum(counts))
        row = mixed(np.array([k or 0 for k in keys], dtype=np.int64).view(np.uint64) + np.uint64(0x51ED270B))
        place = np.concatenate([np.arange(c, dtype=np.uint64) for c in counts]) if counts else np.empty(0, dtype=np.uint64)
        seed = mixed(np.repeat(row, counts) + place * np.uint64(0x9E3779B97F4A7C15))
        ids, number = self.sample(word, seed)
        per_text = np.add.reduceat(np.concatenate([number, [0]]), np.concatenate([[0], np.cumsum(counts)])[:-1]) if counts else []
        per_text = np.where(np.array(counts) > 0, per_text, 0)
        return np.split(ids, np.cumsum(per_text)[:-1])

    def _with_nul(self, text: str) -> list[str]:
        """Words of a text that holds U+0000, which is its own word, marked by a private character."""
        out: list[str] = []
        for i, part in enumerate(text.split("\0")):
            if i:
                out.append(NUL)
            out += self.words.findall(("\0" if not i else "") + part.replace(" ", "\0"))
        return out

    def lossless(self, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether the ids of each text decode to it, byte for byte."""
        every = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
        size = self.sizes[every]
        ends = np.cumsum(size)
        at = np.repeat(self.offsets[every] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        data = self.pool[at].tobytes()
        last = np.concatenate([[0], ends])[np.cumsum([len(i) for i in ids])].tolist() if ids else []
        return [data[a:b] == ((" " + t).encode("utf-8", "surrogatepass") if t else b"") for a, b, t in zip([0, *last], last, texts, strict=False)]

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8")[1:]


def lattices_of(path: str) -> Lattices:
    return kept(path, lambda: Lattices(path))


def _groups(texts: list[str | None]) -> Iterator[slice]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t or "") > BATCH_CHARS:
            yield slice(a, i)
            a, size = i, 0
        size += len(t or "")
    if a < len(texts):
        yield slice(a, len(texts))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_ids and lossless (decoding gave the text back), a row for each document."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(model_path)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _groups(texts):
                whole = [t or "" for t in texts[part]]
                ids = lattices.encode(keys[part], whole)
                same = lattices.lossless(ids, whole)
                none = [t is None for t in texts[part]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[part], pa.int64()),
                        pa.array([None if x else i for i, x in zip(ids, none, strict=True)], pa.list_(pa.int32())),
                        pa.array([None if x else len(i) for i, x in zip(ids, none, strict=True)], pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "ids", "n_ids", "lossless"],
                )

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col)
    return read.transform(in_arrow, encoded, "doc_id long, ids array<int>, n_ids long, lossless boolean", model_path)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column text instead of the ids."""
    others = [c for c in rows.columns if c not in (ids_col, "text")]
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.select(*others).dtypes] + ["text string"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(model_path)
        for batch in batches:
            texts = [None if i is None else lattices.decode(i) for i in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string())], [*others, "text"])

    return rows.select(*others, ids_col).transform(in_arrow, decoded, schema, model_path)
