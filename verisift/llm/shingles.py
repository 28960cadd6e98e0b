"""Hashes of words and of word shingles, for whole texts, with numpy inside tasks."""

from __future__ import annotations

import re

import numpy as np

#: Bytes that are hashed at once; a longer text is read in pieces that end at white space.
BATCH_BYTES = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_SPACES = frozenset(b" \t\n\x0b\x0c\r")
_SPACE = re.compile(r"[\x20\x09-\x0D]")

_tables: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n, modulo 2**64."""
    steps = np.full(n + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _made() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte (A-Z as a-z), which bytes are space, and the powers of the base."""
    global _tables
    if _tables is None:
        folded = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
        value = mixed(folded + _U(0x1234567)) | _U(1)
        space = np.array([b in _SPACES for b in range(256)])
        n = 2 * BATCH_BYTES + 64
        _tables = value, space, powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)
    return _tables


def _batch(raw: list[bytes]) -> list[np.ndarray]:
    value, space, power, inverse = _made()
    at = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    if len(at) >= len(power):  # one word longer than a batch
        power, inverse = powers(_BASE, len(at)), powers(pow(_BASE, -1, 1 << 64), len(at))
    gap = space[at]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value[at] * power[: len(at)], dtype=np.uint64)])
    words = mixed((total[end] - total[start]) * inverse[start])
    bounds = np.cumsum([len(r) + 1 for r in raw])
    return np.split(words, np.searchsorted(start, bounds[:-1]))


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words, A-Z and a-z being alike."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    owners: list[int] = []
    raw: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        for i, words in zip(owners, _batch(raw), strict=True):
            out[i].append(words)
        owners.clear()
        raw.clear()
        size = 0

    for i, text in enumerate(texts):
        for piece in pieces(text or ""):
            data = piece.encode("utf-8", "surrogatepass")
            if raw and size + len(data) > BATCH_BYTES:
                flush()
            owners.append(i)
            raw.append(data)
            size += len(data) + 1
    if raw:
        flush()
    return [np.concatenate(x) if x else np.empty(0, dtype=np.uint64) for x in out]


def pieces(text: str, chars: int = BATCH_BYTES // 4) -> list[str]:
    """The text, cut at white space into pieces of about so many characters."""
    out, a = [], 0
    while len(text) - a > chars:
        cut = _SPACE.search(text, a + chars)
        if not cut:
            break
        out.append(text[a : cut.start()])
        a = cut.end()
    return [*out, text[a:]]


def shingles(words: np.ndarray, k: int, short: bool) -> np.ndarray:
    """Hashes of the runs of k words in order; of fewer words, if short, the whole run as one."""
    n = len(words)
    if n < k:
        if not short or n == 0:
            return np.empty(0, dtype=np.uint64)
        k = n
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = h * _U(0xD6E8FEB86659FD93) + words[j : n - k + 1 + j]
    return mixed(h)
