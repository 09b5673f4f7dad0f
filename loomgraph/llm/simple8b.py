"""Simple-8b: unsigned ids packed into 64-bit words, four bits of selector and 60 of payload.

Ids are coded in blocks that each start at a word of their own, so a reader finds id number ``i`` in block ``i // BLOCK``.
Ids of more than 60 bits are escapes: the stream holds 0 and a side list their places and values.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: ids in a word and bits of each, by selector.
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 4096


def _width(ids: np.ndarray) -> np.ndarray:
    """Bits that each id below 2 ** 60 needs."""
    low = np.frexp((ids & np.uint64((1 << 30) - 1)).astype(np.float64))[1]
    high = np.frexp((ids >> np.uint64(30)).astype(np.float64))[1]
    return np.where(high > 0, high + 30, low).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, each block's first word, and escapes (places, values)."""
    ids = np.asarray(ids, np.uint64)
    places = np.flatnonzero(ids >> np.uint64(60))
    values = ids[places]
    if len(places):
        ids = ids.copy()
        ids[places] = 0
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), places.astype(np.uint32), values
    # each block is padded with zeros, which fit any selector
    padded = np.zeros((blocks, BLOCK + 240), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    # widest id of each run of a selector's length, from the shorter run's
    widest, have, fits = _width(padded), 1, np.full((blocks, BLOCK), 15, np.uint8)
    for s in range(14, -1, -1):
        n = int(COUNT[s])
        while have < n:
            step = min(have, n - have)
            nxt = widest.copy()
            nxt[:, :-step] = np.maximum(widest[:, :-step], widest[:, step:])
            widest, have = nxt, have + step
        fits[widest[:, :BLOCK] <= BITS[s]] = s
    # all blocks take their words in step: the largest run that fits at each place
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = len(ids) - (blocks - 1) * BLOCK
    at, rows, taken = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(rows):
        s = fits[rows, at[rows]]
        taken.append((rows, at[rows], s))
        at[rows] += COUNT[s]
        rows = rows[at[rows] < sizes[rows]]
    row, place, sel = (np.concatenate(x) for x in zip(*taken, strict=True))
    order = np.lexsort((place, row))
    row, place, sel = row[order], place[order], sel[order]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        at = np.flatnonzero(sel == s)
        if len(at):
            run = np.arange(COUNT[s])
            words[at] |= np.bitwise_or.reduce(padded[row[at][:, None], place[at][:, None] + run] << (run * BITS[s]).astype(np.uint64), axis=1)
    return words, np.searchsorted(row, np.arange(blocks)).astype(np.uint32), places.astype(np.uint32), values


def decode(words: np.ndarray, offsets: np.ndarray, count: int, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """All ``count`` ids: every selector's words at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    run = COUNT[sel]
    ends = np.cumsum(run)
    starts = ends - run
    # a block's last word may hold padding: places count from the block's first word
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    place = starts - starts[offsets[block]] + block * BLOCK if len(words) else starts
    out = np.zeros(len(offsets) * BLOCK + 240, np.uint64)
    for s in range(15, 1, -1):
        at = np.flatnonzero(sel == s)
        for k in range(COUNT[s] if len(at) else 0):
            here = place[at] + k
            inside = here < (block[at] + 1) * BLOCK
            out[here[inside]] = (words[at][inside] >> np.uint64(k * BITS[s])) & np.uint64((1 << int(BITS[s])) - 1)
    out = out[:count].copy()
    out[places] = values
    return out
