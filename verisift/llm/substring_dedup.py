"""Near-duplicate passages by compact windows over the min-hashes of word shingles.

For each of several hash functions, all runs of at least WIDTH shingles whose least hash
is at the same place form one compact window (l, c, r). The places that can be such a c
are the minima of sliding windows; a Cartesian tree over them, built with a stack, gives
l and r. Documents whose windows have the same least hash meet in Spark at the first and
second of them (by id), so that a group of n gives fewer than 2n pairs. Intervals of a pair's windows that
overlap for enough hash functions are candidate regions, which are verified on the full
shingles of both documents. A passage is missed by these stars only if some of its
windows stand third or later in their groups. Such places are looked at more closely: runs
of WIDTH shingles are looked up whole, each at the first document that has it; the runs that
no earlier document has get bands of three of nine further min-hashes, whose groups are those
of nearly equal runs only and form stars of their own. The bands are the twelve lines of the
plane of three by three points, so that runs that agree in any five of the nine share a band.

Defined results
- null text or id, and texts shorter than a passage: no rows.
- several rows of one id: the last of their texts, by its shingles, stands for the id.
- repetition within one document is not reported; an empty table gives no rows.
- of a pair the document of the smaller id keeps the passage.
- columns beside id and text are only passed on by `without_passages`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import WORD, cut_lineage, fresh, in_arrow, small
from verisift.llm.shingles import mixed, powers, shingles, word_hashes

#: Words of a shingle; words of the shortest passage; least similarity.
K, PASSAGE, SIMILARITY = 5, 50, 0.8
WIDTH = PASSAGE - K + 1
#: Hash functions, and how many must agree on a region.
HASHES, ENOUGH = 4, 2
#: What stands for a hash function in intervals that are shared exactly, and in those that share a band.
EXACT, NEAR = HASHES, HASHES + 1
#: Hash functions of the closer look at crowded places, as points of a plane of three by three, and its lines.
POINTS = 9
LINES = [[3 * x + (m * x + c) % 3 for x in range(3)] for m in range(3) for c in range(3)] + [[3 * c + y for y in range(3)] for c in range(3)]
_LINES = np.array(LINES).T
#: Members of a key, from which one that meets neither of two centres can have an earlier partner that isn't one.
CROWDED = 4
#: Hash functions with crowded windows from which near copies, and exact ones (which agree in all), can be lost.
CROWDED_NEAR, CROWDED_EXACT = 2, HASHES - ENOUGH + 1
#: Shingles that may miss within what is first taken as one part: what two edited words spoil.
GAP = 2 * K
#: Tasks that the rows of one run of WIDTH shingles are dealt over.
SALTS = 8
#: Document ids up to which the texts to verify are picked by a broadcast (16 MB), not by a shuffle.
BROADCAST_IDS = 1_000_000
SEEDS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64))
POINT_SEEDS = mixed(np.arange(HASHES + 1, HASHES + 1 + POINTS, dtype=np.uint64))
_INDEX = np.uint64((1 << 20) - 1)
_PLACE = (1 << 29) - 1
#: Shingles that are searched at once; longer texts are read in overlapping parts.
PART = 1 << 19


def minima(low: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of width values."""
    have = 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(low) - (width - have)], low[width - have :]) if have < width else low


def bounds(values: list[int], begins: list[int], left: list[int], right: list[int], places: list[int]) -> None:
    """Set l and r of each place: how far it is the least, by the Cartesian tree of the places of each text.

    The nearest smaller hash of such a place, to either side, is itself among the places.
    begins has the first place of each text; left and right hold the texts' ends.
    """
    for a, b in zip(begins, [*begins[1:], len(values)], strict=True):
        stack: list[int] = []
        for i in range(a, b):
            v = values[i]
            while stack and values[stack[-1]] > v:
                right[stack.pop()] = places[i] - 1
            if stack:
                left[i] = places[stack[-1]] + 1
            stack.append(i)


def compact_windows(texts: list[np.ndarray], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text, f, key, l, r) of the compact windows of at least width shingles of some texts, of PART in all."""
    sizes = np.array([len(g) for g in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    g = np.concatenate(texts) if texts else np.empty(0, dtype=np.uint64)
    out: list[tuple[np.ndarray, ...]] = [(np.empty(0, dtype=np.int64),) * 5]
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - width + 1, 0))
    # of each run of width shingles within one text, its start
    runs = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(np.maximum(sizes - width + 1, 0)) - np.maximum(sizes - width + 1, 0)), np.maximum(sizes - width + 1, 0))
    for f in range(HASHES if len(owner) else 0):
        h = mixed(g ^ SEEDS[f])
        low = minima((h & ~_INDEX) | np.arange(len(h), dtype=np.uint64), width)[runs]
        new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))  # no place is in two texts
        low, own = low[new], owner[new]
        at = (low & _INDEX).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        left, right = starts[own].tolist(), (ends[own] - 1).tolist()
        bounds(low.tolist(), begins.tolist(), left, right, at.tolist())
        keys = mixed(h[at] + np.uint64(f)).view(np.int64)
        out.append((own, np.full(len(own), f), keys, np.array(left) - starts[own], np.array(right) - starts[own]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _groups(grams: list[np.ndarray]) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Texts, with their numbers and how many shingles go before, in groups of about PART; longer ones are cut into overlapping parts."""
    who: list[int] = []
    before: list[int] = []
    parts: list[np.ndarray] = []
    for i, g in enumerate(grams):
        for start in range(0, max(1, len(g) - WIDTH + 1), PART - WIDTH + 1):
            part = g[start : start + PART]
            if parts and sum(map(len, parts)) + len(part) > PART:
                yield who, before, parts
                who, before, parts = [], [], []
            who.append(i)
            before.append(start)
            parts.append(part)
    if parts:
        yield who, before, parts


def packed(f: np.ndarray | int, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Windows (f, l, r) as one number each."""
    return (np.asarray(f, dtype=np.int64) << 56) + (l.astype(np.int64) << 28) + r.astype(np.int64)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 128):
            batch = whole.slice(a, 128)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            grams = [shingles(words, K, short=False) for words in word_hashes(batch.column(1).to_pylist())]
            for who, before, parts in _groups(grams):
                own, f, key, left, right = compact_windows(parts)
                shift = np.array(before)[own]
                columns = [key, ids[np.array(who)[own]], packed(f, left + shift, right + shift)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc", "w"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles in order, as 32-bit fingerprints."""
    for whole in batches:
        for a in range(0, whole.num_rows, 128):
            batch = whole.slice(a, 128)
            grams = [(shingles(w, K, short=False) >> np.uint64(32)).astype(np.uint32).view(np.int32) for w in word_hashes(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int32()))], ["id", "grams"])


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def run_keys(g: np.ndarray) -> np.ndarray:
    """A hash of each run of WIDTH shingles, in order."""
    n = len(g)
    if n < WIDTH:
        return np.empty(0, dtype=np.int64)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(g.astype(np.uint32).astype(np.uint64)) * powers(_BASE, n - 1), dtype=np.uint64)])
    return mixed((total[WIDTH:] - total[:-WIDTH]) * powers(pow(_BASE, -1, 1 << 64), n - WIDTH)).view(np.int64)


def band_windows(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, l, r) of the neighbouring runs of WIDTH shingles, of those that begin at the places at, with equal min-hashes in a band."""
    low, high = int(at[0]), int(at[-1])
    names = mixed(g[low : high + WIDTH].astype(np.uint32).astype(np.uint64))
    least = np.stack([minima(mixed(names ^ seed), WIDTH)[at - low] for seed in POINT_SEEDS])
    least = mixed(least + np.arange(POINTS, dtype=np.uint64)[:, None])
    key = least[_LINES[0]] ^ least[_LINES[1]] ^ least[_LINES[2]]  # a row for each line
    starts = np.ones(key.shape, dtype=bool)
    starts[:, 1:] = (key[:, 1:] != key[:, :-1]) | (np.diff(at) > 1)
    new = np.flatnonzero(starts)
    last = np.append(new[1:], key.size) - 1
    return key.ravel()[new].view(np.int64), at[new % len(at)], at[last % len(at)] + WIDTH - 1


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, enough, a, b): where stars may have missed so many hash functions that near or exact copies can be lost."""
    for batch in batches:
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        own, windows = flat(batch.column(1))
        out = []
        for enough in (CROWDED_NEAR, CROWDED_EXACT):
            i, a, b = overlaps(own, *unpacked(windows), enough)
            out.append([x[b - a + 1 >= WIDTH] for x in (docs[i], np.full(len(i), enough), a, b)])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc", "enough", "a", "b"])


def _begins(zones: list[dict]) -> np.ndarray:
    """Where runs of WIDTH shingles begin in the zones."""
    return np.unique(np.concatenate([np.arange(z["a"], z["b"] - WIDTH + 2) for z in zones]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, doc, at): the runs of WIDTH shingles in the zones of (id, grams, zones), each once a document."""
    for batch in batches:
        for i, (doc, zones) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            keys = run_keys(np.array(batch.column(1)[i].values))
            at = _begins(zones)
            at = at[at < len(keys)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at]), pa.array(np.full(len(at), doc, dtype=np.int64)), pa.array(at.astype(np.int32))], ["run", "doc", "at"]
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, w): the bands of the runs in the zones of (id, grams, zones)."""
    for batch in batches:
        for i, (doc, zones) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            g = np.array(batch.column(1)[i].values)
            at = _begins(zones)
            at = at[at <= len(g) - WIDTH]
            if len(at):
                key, left, right = band_windows(g, at)
                columns = [key, np.full(len(key), doc, dtype=np.int64), packed(NEAR, left, right)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc", "w"])


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of (doc, zones, done) whose runs no interval of done holds, as zones (doc, a, b)."""
    for batch in batches:
        rows = []
        for doc, zones, done in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            at = _begins(zones)
            if done:
                at = at[~np.isin(at, _begins(done))]
            for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                rows.append((doc, int(part[0]), int(part[-1]) + WIDTH - 1))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32()], strict=True)], ["doc", "a", "b"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs at places of (doc, source, at) as intervals of shingles."""
    for batch in batches:
        rows = []
        for doc, source, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            at = np.sort(np.array(places))
            for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                rows.append((doc, source, int(part[0]), int(part[-1]) + WIDTH - 1))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc", "source", "a", "b"])


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a column, and the row that each is of."""
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy(zero_copy_only=False)


def unpacked(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return w >> 56, w >> 28 & 0xFFFFFFF, w & 0xFFFFFFF


def merged(own: np.ndarray, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, a, b): the closed intervals of each owner in order, those that overlap or touch made one."""
    left = (own << 29) + l
    order = np.argsort(left)
    left, reach = left[order], np.maximum.accumulate(((own << 29) + r)[order])
    new = np.flatnonzero(np.append(True, left[1:] > reach[:-1] + 1)[: len(left)])
    last = np.append(new[1:], len(left)) - 1 if len(new) else new
    return left[new] >> 29, left[new] & _PLACE, reach[last] & _PLACE


def overlaps(own: np.ndarray, f: np.ndarray, l: np.ndarray, r: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, a, b): where an owner's windows (f, l, r) of at least so many hash functions overlap, as closed intervals in order."""
    part, l, r = merged(own * HASHES + f, l, r)
    own = part // HASHES << 29
    at = np.concatenate([own + l, own + r + 1])
    order = np.argsort(at)
    at, held = at[order], np.cumsum(np.repeat([1, -1], len(l))[order])
    at, held = (x[np.append(at[1:] != at[:-1], True)[: len(at)]] for x in (at, held))  # what is held behind all that begins or ends there
    on = held >= enough
    edge = np.flatnonzero(on != np.append(False, on[:-1])[: len(on)])
    a, b = at[edge[::2]], at[edge[1::2]] - 1
    return a >> 29, a & _PLACE, b & _PLACE


def regions(windows: list[tuple[int, int, int]], enough: int) -> list[tuple[int, int]]:
    """Where windows (f, l, r) of one owner overlap."""
    f, l, r = np.array(windows, dtype=np.int64).reshape(-1, 3).T
    _, a, b = overlaps(np.zeros(len(f), dtype=np.int64), f, l, r, enough)
    return list(zip(a.tolist(), b.tolist(), strict=True))


class Source:
    """The shingles of an earlier document, and where they and its runs are first, made once for all that is compared with it."""

    def __init__(self, b: np.ndarray):
        self.b = b

    @cached_property
    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.b, return_index=True)

    @cached_property
    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(run_keys(self.b), return_index=True)


def values(x: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def passages(a: np.ndarray, b: np.ndarray | Source) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start in b, end in b, similarity) of passages of a, in shingles, that b has too."""
    source = b if isinstance(b, Source) else Source(b)
    b, (names, first) = source.b, source.grams
    at = np.searchsorted(names, a)
    at[at == len(names)] = 0
    found = names[at] == a if len(names) else np.zeros(len(a), dtype=bool)
    hits = np.flatnonzero(found)
    if not len(hits):
        return []
    where = first[at[hits]]
    shifts = where - hits
    bend = shifts[1:] != shifts[:-1]
    bends = np.flatnonzero(bend) + 1  # hits that another place of b goes on from
    steps = hits[1:] - hits[:-1]
    jumps = np.flatnonzero(steps > 1) + 1  # hits behind a miss
    if not len(bends) and not len(jumps):  # one stretch that is the same in b
        s, e = int(hits[0]), int(hits[-1])
        return [(s, e, int(where[0]), int(where[-1]), 1.0)] if e - s + K >= PASSAGE else []
    new = ~found
    if distinct := len(values(a)) == len(a):
        simple = len(names) == len(b)  # no shingle twice in either, so that counting hits is enough
    else:
        simple = False
        once = np.zeros(len(a), dtype=bool)
        once[np.unique(a, return_index=True)[1]] = True
        new &= once
    lost = [0, *new.cumsum().tolist()]  # distinct misses so far, at least
    mine, theirs, bent = hits.tolist(), where.tolist(), [0, *bend.cumsum().tolist()]

    def few(i: int, j: int) -> bool:
        """The hits from i to j (exclusive) are too few for the stretch, however many of them are in common."""
        return j - i < SIMILARITY * (j - i + lost[mine[j - 1] + 1] - lost[mine[i]])

    def measured(i: int, j: int) -> tuple[int, int, int, int, float]:
        """The stretch of a from hit i to the last before j, and its best counterpart in b; of a score too low it may be none."""
        s, e = mine[i], mine[j - 1]
        if bent[i] == bent[j - 1] and (simple or e - s == j - i - 1):  # at one shift, and counted by its hits or equal
            return s, e, theirs[i], theirs[j - 1], (j - i) / (2 * (e - s + 1) - (j - i))
        best = (s, e, 0, 0, 0.0)
        if few(i, j):
            return best
        places = where[i:j]
        shift = np.sort(shifts[i:j])[(j - i) // 2]
        own = None if simple else values(a[s : e + 1])
        for c, d in {(int(places.min()), int(places.max())), (int(s + shift), int(e + shift))}:
            c, d = max(c, 0), min(d, len(b) - 1)
            if c <= d <= c + 2 * (e - s) + 1:
                if simple:  # the hits from s to e are those of the run
                    same, both = int(np.count_nonzero((places >= c) & (places <= d))), e - s + d - c + 2
                else:
                    other = values(b[c : d + 1])
                    both = len(own) + len(other)
                    same = both - len(values(np.concatenate([own, other])))
                score = same / (both - same)
                if score > best[4]:
                    best = (s, e, c, d, score)
        return best

    def split(i: int, j: int, edges: np.ndarray) -> list[tuple[int, int]]:
        inner = edges[np.searchsorted(edges, i, "right") : np.searchsorted(edges, j)].tolist()
        return list(zip([i, *inner], [*inner, j], strict=True))

    def grown(parts: list[tuple[int, int]]) -> list[tuple[int, int, int, int, float]]:
        """Neighbouring parts joined, over any gap, as long as the whole stays similar."""
        out = []
        (i, j), best = parts[0], None
        for p, q in [*parts[1:], (-1, -1)]:
            if p >= 0 and not few(i, q) and (new := measured(i, q))[4] >= SIMILARITY:
                j, best = q, new
                continue
            if mine[j - 1] - mine[i] + K >= PASSAGE and (best := best or measured(i, j))[4] >= SIMILARITY:
                out.append(best)
            i, j, best = p, q, None
        return out

    parts: list[tuple[int, int]] = []
    for i, j in split(0, len(hits), jumps[steps[jumps - 1] > GAP + 1]):
        if measured(i, j)[4] >= SIMILARITY:
            parts.append((i, j))
            continue
        for p, q in split(i, j, jumps):  # stretches without a miss; one that comes from several places of b is split there
            alike = measured(p, q)[4] >= SIMILARITY
            parts += [(p, q)] if alike else split(p, q, bends)
    return grown(parts)


def copied(a: np.ndarray, source: Source) -> list[tuple[int, int, int]]:
    """(start, end, start in the source) of what covers all runs of WIDTH shingles of a that it has too, each as long as both go on."""
    b, (names, first) = source.b, source.runs
    keys = run_keys(a)
    if not len(names) or not len(keys):
        return []
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    out, done = [], 0
    for s in np.flatnonzero(names[at] == keys).tolist():
        if s < done:
            continue
        c = int(first[at[s]])
        n = min(len(a) - s, len(b) - c)
        differ = np.flatnonzero(a[s : s + n] != b[c : c + n])
        length = int(differ[0]) if len(differ) else n
        if length >= WIDTH:
            out.append((s, s + length - 1, c))
            done = s + length - WIDTH + 1
    return out


RESULT = "doc_id long, start_word int, end_word int, source_id long, source_start int, source_end int, similarity double"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, other = None, Source(np.empty(0, dtype=np.int32))
    for batch in batches:
        rows: list[tuple] = []
        docs, sources, lows = (batch.column(i).to_pylist() for i in (0, 1, 3))
        own, windows = flat(batch.column(2))
        f, l, r = unpacked(windows)
        held, exact = f < HASHES, f == EXACT
        alike = overlaps(own[held], f[held], l[held], r[held], ENOUGH)
        near = own[f == NEAR], l[f == NEAR], r[f == NEAR]
        where: list[list[tuple[int, int]]] = [[] for _ in docs]
        for i, a, b in zip(*(x.tolist() for x in merged(*map(np.concatenate, zip(near, alike, strict=True)))), strict=True):
            where[i].append((a, b))
        whole: list[list[tuple[int, int]]] = [[] for _ in docs]
        for i, a, b in zip(own[exact].tolist(), l[exact].tolist(), r[exact].tolist(), strict=True):
            whole[i].append((a, b))
        (grams, ends), (others, other_ends) = ((x.flatten().to_numpy(), np.cumsum(x.value_lengths().to_numpy()).tolist()) for x in (batch.column(4), batch.column(5)))
        for i, (doc, source, low) in enumerate(zip(docs, sources, lows, strict=True)):
            mine = grams[ends[i - 1] if i else 0 : ends[i]]
            if source != last:  # a source's rows follow one another behind the join
                last, other = source, Source(others[other_ends[i - 1] if i else 0 : other_ends[i]].copy())
            got: list[tuple[int, int]] = []
            for a, b in where[i]:
                for s, e, c, d, score in passages(mine[a - low : b - low + 1], other):
                    rows.append((doc, a + s, a + e + K, source, c, d + K, score))
                    got.append((a + s, a + e))
            for a, b in whole[i]:
                if not any(s <= a and b <= e for s, e in got):
                    rows += [(doc, a + s, a + e + K, source, c, c + e - s + K, 1.0) for s, e, c in copied(mine[a - low : b - low + 1], other)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        names = [x.split()[0] for x in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def gram_arrays(read: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, grams) of the documents in ids(_id)."""
    return (
        read.join(small(ids, BROADCAST_IDS), F.col("doc") == F.col("_id"), "left_semi")
        .transform(in_arrow, _arrays, "id long, grams array<int>")
        .groupBy("id")
        .agg(F.max("grams").alias("grams"))
    )


def starred(members: DataFrame) -> DataFrame:
    """The members but each group's first, with the first as their source.

    Counts and join share one shuffle of the members, as both ask for all of its columns (hence _w) and drop nulls before it.
    """
    dealt = members.filter("key IS NOT NULL AND doc IS NOT NULL AND w IS NOT NULL").repartition("key")
    firsts = (
        dealt.groupBy("key")
        .agg(F.min("doc").alias("source"), F.max("doc").alias("_last"), F.max("w").alias("_w"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("source") < F.col("_last")) & F.col("_w").isNotNull())
        .select("key", "source", "n")
    )
    return dealt.join(firsts, "key").filter(F.col("doc") != F.col("source"))


def in_zones(read: DataFrame, zones: DataFrame) -> DataFrame:
    """(id, grams, zones) of the documents in zones(doc, zones)."""
    return gram_arrays(read, cut_lineage(zones.select(F.col("doc").alias("_id")))).join(zones, F.col("id") == F.col("doc")).select("id", "grams", "zones")


def closer(read: DataFrame, zones: DataFrame) -> DataFrame:
    """(doc, source, w): what zones(doc, enough, a, b) of crowded places share exactly with the first document that
    has it in its zones, and what the rest shares a band of with its group's first or second.

    All that hold a run of WIDTH shingles hold the same words, so the first of them is enough: it is the
    source of the others, and it alone meets what is nearly equal.
    """
    gathered = lambda df: df.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias("zones"))
    by_doc = cut_lineage(gathered(zones.filter(F.col("enough") == CROWDED_EXACT)))
    runs = in_zones(read, by_doc).transform(in_arrow, _runs, "run long, doc long, at int")
    # the rows of one run are dealt over SALTS tasks; counts and join share this shuffle, as in starred
    dealt = (
        runs.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
        .filter("run IS NOT NULL AND doc IS NOT NULL AND at IS NOT NULL AND _salt IS NOT NULL")
        .repartition("run", "_salt")
    )
    firsts = (
        dealt.groupBy("run", "_salt")
        .agg(F.min("doc").alias("source"), F.max("doc").alias("_last"), F.max("at").alias("_at"))
        .groupBy("run")
        .agg(F.min("source").alias("source"), F.max("_last").alias("_last"), F.max("_at").alias("_at"))
        .filter((F.col("source") < F.col("_last")) & F.col("_at").isNotNull())
        .select("run", "source", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    met = dealt.join(firsts, ["run", "_salt"]).filter(F.col("doc") != F.col("source"))
    exact = cut_lineage(
        met.groupBy("doc", "source").agg(F.collect_set("at").alias("at")).transform(in_arrow, _joined, "doc long, source long, a int, b int")
    )
    done = gathered(exact).withColumnRenamed("zones", "done")
    near = gathered(zones.filter(F.col("enough") == CROWDED_NEAR))
    rest = near.join(done, "doc", "left").select("doc", "zones", "done").transform(in_arrow, _rest, "doc long, a int, b int")
    bands = in_zones(read, cut_lineage(gathered(rest))).transform(in_arrow, _bands, "key long, doc long, w long")
    once = cut_lineage(starred(bands))
    as_window = F.lit(EXACT << 56) + F.shiftleft(F.col("a").cast("long"), 28) + F.col("b").cast("long")
    return exact.select("doc", "source", as_window.alias("w")).unionByName(stars(once))


def stars(once: DataFrame) -> DataFrame:
    """(doc, source, w) of members with their group's first as source, and of those behind its second with that.

    What a document shares with its group's second but not its first is found too; a group of two windows has nothing more.
    """
    twice = starred(once.filter(F.col("n") > 2).drop("source", "n"))
    return once.unionByName(twice).select("doc", "source", "w")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that an earlier document (by id) has too: words start_word to end_word (exclusive)."""
    read = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    once = cut_lineage(starred(read.transform(in_arrow, _windows, "key long, doc long, w long")))
    members = stars(once)
    crowded = starred(once.filter(F.col("n") >= CROWDED).drop("source", "n"))
    zones = cut_lineage(
        crowded.groupBy("doc").agg(F.collect_set("w").alias("windows")).transform(in_arrow, _zones, "doc long, enough int, a int, b int")
    )
    if zones.limit(1).count():
        members = members.unionByName(closer(read, zones))
    f, l, r = F.shiftright("w", 56), F.shiftright("w", 28).bitwiseAND((1 << 28) - 1), F.col("w").bitwiseAND((1 << 28) - 1)
    pairs = cut_lineage(
        members.groupBy("doc", "source")
        .agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1), f.cast("int"))).alias("_which"),
            F.collect_set("w").alias("windows"),
            F.min(l).cast("int").alias("low"),
            F.max(r).cast("int").alias("high"),
        )
        .filter((F.bit_count(F.col("_which").bitwiseAND((1 << HASHES) - 1)) >= ENOUGH) | (F.col("_which") >= 1 << EXACT))
        .drop("_which")
    )
    ids = cut_lineage(pairs.select(F.explode(F.array("doc", "source")).alias("_id")).distinct())
    arrays = gram_arrays(read, ids)
    mine = pairs.join(arrays.withColumnRenamed("id", "doc"), "doc").select(
        "doc", "source", "windows", "low", F.slice("grams", F.col("low") + 1, F.col("high") - F.col("low") + 1).alias("mine")
    )
    both = mine.join(arrays.withColumnRenamed("id", "source"), "source").select("doc", "source", "windows", "low", "mine", "grams")
    return both.transform(in_arrow, _verified, RESULT).distinct()


def _cut(batches: Iterator[pa.RecordBatch], n: int, fields: list[str]) -> Iterator[pa.RecordBatch]:
    word = re.compile(WORD)
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
            if text is None or not spans:
                texts.append(text)
                continue
            at = [m.span() for m in word.finditer(text)]
            out, done = [], 0
            for s in sorted((s for s in spans if s["a"] < len(at)), key=lambda x: (x["a"], x["b"])):
                begin, end = at[s["a"]][0], at[min(s["b"], len(at)) - 1][1]
                if end > done:
                    out.append(text[done : max(begin, done)])
                    done = end
            texts.append("".join([*out, text[done:]]).strip())
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], fields)


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, their repeated passages cut out; a document left without a word is dropped.

    Where several rows share an id, each row whose words reach so far is cut.
    """
    found = repeated_passages(docs, id_col, text_col)
    key, held, after = (fresh(docs, name) for name in ("_id", "_spans", "_cut"))
    spans = cut_lineage(
        found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias(held))
    )
    others = [c for c in docs.columns if c != text_col]
    spans = small(spans)
    joined = docs.join(spans, F.col(id_col) == F.col(key), "left").select(*others, text_col, held)
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.select(*others).dtypes] + [f"{after} string"])
    cut = joined.transform(in_arrow, lambda b: _cut(b, len(others), [*others, after]), schema)
    kept = cut.filter(F.col(after).isNull() | F.col(after).rlike(WORD))
    return kept.select(*[F.col(after).alias(c) if c == text_col else F.col(c) for c in docs.columns])
