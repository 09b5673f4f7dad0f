"""Vectorised words, hashes and shingles of many texts at once, for use inside tasks.

A group of texts is joined to one byte array with a separator between them. Words are maximal runs of the bytes that
``in_word`` allows. A span's hash is polynomial, from one running sum, so words, prefixes and n-grams cost the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_tables: list[np.ndarray] = []

#: Every byte but white space: space, \t, \n, \v, \f and \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Digits, a to z and every byte of a character beyond ASCII (texts are lower-cased from A to Z before).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def groups(texts: list[bytes], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer text stands alone and whole."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        n = max(n, _PIECE + (_PIECE >> 3))
        _tables[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _tables.append(np.cumprod(p))
    return _tables[0], _tables[1]


def span_hash(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``symbols[start:end]`` for ascending ``start``; works through pieces of bounded size."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(start, base + _PIECE)))
        stop = int(end[lo:hi].max())
        up, down = _powers(stop - base + 1)
        run = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((symbols[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base], out=run[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        lo = hi
    return out


class Words:
    """``start``, ``end``, ``doc`` (place of the text in its group) and ``hash`` of each word; ``first[d]:first[d+1]`` are text d's words."""

    def __init__(self, texts: list[bytes], in_word: np.ndarray, hashed: bool = True):
        self.symbols = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        inside = in_word[self.symbols]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        #: where each text begins, and the end
        self.at = np.concatenate([[1], 1 + np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if hashed:
            self.hash = span_hash(self.symbols, self.start, self.end)


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes; run i begins at word i. Runs may cross texts: callers mask those."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = (out + h[j : len(h) - n + 1 + j]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text; fewer words: one hash of the whole sequence; none: empty."""
    grams = ngram_hash(w.hash, n)
    out = []
    for lo, hi in zip(w.first[:-1], w.first[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            out.append(ngram_hash(w.hash[lo:hi], int(hi - lo)) + np.uint64(hi - lo))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Table:
    """64-bit hashes to small integers, all looked up at once (open addressing over two arrays)."""

    def __init__(self, room: int):
        self.mask = np.uint64((1 << max(4, (2 * room - 1).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.zeros(len(self.keys), np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The integer of each hash, -1 if there is none."""
        h = np.maximum(h, np.uint64(1))  # 0 marks a free slot
        out = np.full(len(h), -1, np.int32)
        slot = (h & self.mask).astype(np.int64)
        keys = self.keys[slot]
        hit = keys == h
        out[hit] = self.values[slot[hit]]
        rest = np.flatnonzero(~hit & (keys != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & int(self.mask)
            keys = self.keys[slot[rest]]
            hit = keys == h[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (keys != 0)]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that are not there yet; at most ``room`` in all."""
        h = np.maximum(h, np.uint64(1))
        slot = (h & self.mask).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]  # of several for one slot one stays
            done = free & (self.keys[slot] == h)
            self.values[slot[done]] = values[done]
            h, values, slot = h[~done], values[~done], (slot[~done] + 1) & int(self.mask)
