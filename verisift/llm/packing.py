"""Hierarchical packing of token sequences into windows of several lengths.

Each task tokenises the documents of its input split and packs them, so no token is
shuffled. Documents are routed to the shortest tier that holds them (longer ones give
whole windows of the longest tier first and route their rest); from the longest tier
down, a window's gap is filled with the best-fitting whole documents of shorter tiers,
then with a cut of one. Windows of a tier are dealt to step groups of equal tokens.
What a block of documents leaves open is carried to the next; what the split leaves is
cut into windows of powers of two. No window is padded.

Defined results
- null text is the empty string: its only id is the end id.
- repeated rows are packed one by one; ids may be null.
- very long texts are tokenised in pieces that end at white space.
- an empty table gives no rows. Columns beside id and text are not read.
- sequence ids are unique; which documents share a window depends on the input's splits,
  and is the same for a task that runs again.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from verisift.llm.common import in_arrow, kept

TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group, and of a block whose documents are packed together.
STEP_TOKENS = 16_384
BLOCK_TOKENS = 1_000_000
END_ID = 1
#: Words whose ids a worker remembers, texts that are tokenised together, and characters
#: above which a text is cut.
CACHE_WORDS = 1_500_000
BATCH_TEXTS = 128
CHUNK_CHARS = 1_000_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
    "tier long, step_id long"
)

#: Characters that are looked up by word; a text with others, or with what may be a special token, goes to the tokenizer whole.
USUAL = [c for c in range(0x250) if c not in (0x130, 0x85) and (c in range(9, 14) or c in range(0x20, 0x7F) or c >= 0xA0)]


def _class(kind: str) -> str:
    """The usual characters of a general category."""
    return "".join(re.escape(chr(c)) for c in USUAL if unicodedata.category(chr(c))[0] == kind)


# How the tokenizer's own file splits a text into words.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\s{_class('L')}{_class('N')}]+"
UNUSUAL = rf"[^{''.join(re.escape(chr(c)) for c in USUAL)}]|<\|"


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes; words seen before are looked up.

    The tokenizer treats the words of a text independently of each other, so that a text's
    ids are those of its words in order.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.words, self.unusual, self.space = re.compile(WORDS), re.compile(UNUSUAL), re.compile(r"\s")

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _chunks(self, texts: list[str]) -> list[bytes]:
        """Ids of short texts; words that are new to the worker are tokenised in one call."""
        split = [None if self.unusual.search(t) else self.words.findall(t.lower()) for t in texts]
        seen = set().union(*[s for s in split if s is not None])
        if missing := seen.difference(self.known):
            if len(self.known) + len(missing) > CACHE_WORDS:
                self.known.clear()
                missing = seen
            names = list(missing)
            found = self.tokenizer.encode_batch_fast(names, add_special_tokens=False)
            self.known.update(zip(names, map(self._bytes, [e.ids for e in found]), strict=True))
        look = self.known.__getitem__
        return [
            self._bytes(self.tokenizer.encode(t, add_special_tokens=False).ids) if s is None else b"".join(map(look, s))
            for t, s in zip(texts, split, strict=True)
        ]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a long one is cut at white space, which no word reaches over."""
        cut: list[tuple[int, str]] = []
        for i, text in enumerate(texts):
            a = 0
            while len(text) - a > CHUNK_CHARS and (space := self.space.search(text, a + CHUNK_CHARS)):
                cut.append((i, text[a : space.start()]))
                a = space.start()
            cut.append((i, text[a:]))
        out: list[list[bytes]] = [[] for _ in texts]
        for (i, _), ids in zip(cut, self._chunks([c for _, c in cut]), strict=True):
            out[i].append(ids)
        return [b"".join(x) for x in out]


class Packer:
    """Packs pieces (row, start, length) of rows' tokens into windows."""

    def __init__(self):
        self.open: list[list[tuple[int, int, int]]] = [[] for _ in TIERS]  # by length, row, start
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []  # window length, pieces in order

    def add(self, row: int, tokens: int) -> None:
        whole, rest = divmod(tokens, TIERS[-1])
        for i in range(whole):
            self.done.append((TIERS[-1], [(row, i * TIERS[-1], TIERS[-1])]))
        if rest:
            self._route(row, whole * TIERS[-1], rest)

    def _route(self, row: int, start: int, length: int) -> None:
        tier = next(i for i, size in enumerate(TIERS) if length <= size)
        insort(self.open[tier], (length, row, start))

    def _best(self, tier: int, most: int) -> tuple[int, int, int] | None:
        """The longest open piece of at most so many tokens in the tiers up to this one."""
        for i in range(tier, -1, -1):
            if at := bisect_right(self.open[i], (most, float("inf"), 0)):
                return self.open[i].pop(at - 1)
        return None

    def pack(self, last: bool) -> None:
        for tier in range(len(TIERS) - 1, -1, -1):
            size = TIERS[tier]
            while self.open[tier]:
                length, row, start = self.open[tier].pop()
                pieces, gap = [(row, start, length)], size - length
                while gap:
                    if found := self._best(tier, gap):
                        length, row, start = found
                    elif lower := next((i for i in range(tier + 1) if self.open[i]), None):
                        length, row, start = self.open[lower].pop(0)
                    elif self.open[0]:
                        length, row, start = self.open[0].pop(0)
                    else:
                        break
                    take = min(length, gap)
                    pieces.append((row, start, take))
                    gap -= take
                    if take < length:
                        self._route(row, start + take, length - take)
                if not gap:
                    self.done.append((size, pieces))
                elif last:
                    self._powers(pieces)
                else:  # all that is open is in this window; it waits for the next block
                    for row, start, length in pieces:
                        self._route(row, start, length)
                    return

    def _powers(self, pieces: list[tuple[int, int, int]]) -> None:
        left = sum(p[2] for p in pieces)
        while left:
            size, window = 1 << (left.bit_length() - 1), []
            left -= size
            need = size
            while need:
                row, start, length = pieces.pop(0)
                take = min(length, need)
                window.append((row, start, take))
                need -= take
                if take < length:
                    pieces.insert(0, (row, start + take, length - take))
            self.done.append((size, window))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document; tier is the window's length, step_id its step group."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = kept(tokenizer_path, lambda: WordTokenizer(tokenizer_path)), Packer()
        ids: dict[int, bytes] = {}
        names: dict[int, int | None] = {}
        high = TaskContext.get().partitionId() << 32
        counters = {"sequence": 0, "step": 0}
        steps: dict[int, tuple[int, int]] = {}  # of a window length: step, windows in it
        end = END_ID.to_bytes(4, "little")

        def flush(last: bool) -> pa.RecordBatch:
            packer.pack(last)
            rows: list[tuple] = []
            for size, pieces in packer.done:
                step, n = steps.get(size, (-1, 0))
                if step < 0 or (n + 1) * size > STEP_TOKENS:
                    step, n = counters["step"], 0
                    counters["step"] += 1
                steps[size] = (step, n + 1)
                offset = 0
                for row, start, length in pieces:
                    crc = zlib.crc32(ids[row][4 * start : 4 * (start + length)])
                    rows.append((names[row], start, length, crc, len(ids[row]) // 4, high + counters["sequence"], offset, size, high + step))
                    offset += length
                counters["sequence"] += 1
            packer.done.clear()
            waiting = {row for tier in packer.open for _, row, _ in tier}
            for row in [r for r in ids if r not in waiting]:
                del ids[row], names[row]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            fields = [x.split()[0].strip("`") for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], fields)

        row, waiting = 0, 0
        for batch in batches:
            for part in (batch.slice(a, BATCH_TEXTS) for a in range(0, batch.num_rows, BATCH_TEXTS)):
                found = words.encode([t or "" for t in part.column(1).to_pylist()])
                for name, text_ids in zip(part.column(0).to_pylist(), found, strict=True):
                    ids[row], names[row] = text_ids + end, name
                    packer.add(row, len(ids[row]) // 4)
                    waiting += len(ids[row]) // 4
                    row += 1
                if waiting >= BLOCK_TOKENS:
                    yield flush(False)
                    waiting = 0
        yield flush(True)

    return docs.select(id_col, text_col).transform(in_arrow, packed, SCHEMA, tokenizer_path)
