"""Fuzzy line deduplication over all documents.

A line is normalised to its lower-case words with digits as 0. Equal lines are one node, named by a 128-bit hash. Nodes that
have a value in common are compared by edit similarity. ``near`` says which values a node gets: "blocks" are the 32-bit blocks
of a SimHash of its distinct words, one of which agrees if fewer bits than there are blocks differ, which few near copies do;
"pairs" are ``HASHES`` pairs of MinHashes, of shingles of some words in its first half and in its second, so that lines which
share a passage but not the rest don't meet; and for short lines one hash without each of the words, so that any one word may
differ (a character of a script without spaces is a word here). op9 and the pipeline take pairs. Of each connected group of
lines the first occurrence (smallest document id, then line number) stays, all others go.

Within a value, members are first compared with one pivot, then only with members of other groups, so nothing grows
with the square of a group and no link between groups is lost.

Defined cases: lines under ``least`` words always stay, as do blank lines; where a script has no spaces, each character
counts as a word. Null text stays null; null ids are left alone.
Repeated rows share their occurrences, so both keep what either keeps. Empty table: no rows. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, small, table, trim, written
from .components import components
from .words import ALNUM, Words, groups, mix, ngram_hash, span_hash

BLOCKS = 6
#: MinHashes of a line's halves, and bytes of words in each shingle; lines of up to SHORT words get hashes without each word too.
HASHES, SPAN, SHORT = 14, 8, 12
_DIGITS = bytes.maketrans(b"123456789", b"0" * 9)
#: The eight bits of a byte as eight bytes, to be summed in one word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()


def _unspaced(s: np.ndarray) -> np.ndarray:
    """Where a character of a script without spaces begins: Han, kana, Thai, Lao, Tibetan, Burmese, Khmer."""
    if s.max(initial=0) < 0xE0:
        return np.empty(0, np.int64)
    n = np.append(s[1:], np.uint8(0))
    found = ((s >= 0xE4) & (s <= 0xE9)) | ((s == 0xE3) & (n >= 0x81)) | ((s == 0xE0) & (n >= 0xB8)) | ((s == 0xF0) & (n >= 0xA0) & (n <= 0xB3))
    return np.flatnonzero(found | ((s == 0xE1) & ((n <= 0x82) | (n == 0x9E) | (n == 0x9F))))


def _pieces(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, cut further into characters where a script has no spaces."""
    at = _unspaced(w.symbols)
    if not len(at):
        return w.start, w.end
    start = np.unique(np.concatenate([w.start, at, at + np.where(w.symbols[at] == 0xF0, 4, 3)]))
    start = start[ALNUM[w.symbols[start]]]
    return start, np.minimum(np.append(start[1:], len(w.symbols)), w.end[np.searchsorted(w.start, start, "right") - 1])


class Lines:
    """Lines of at least ``least`` words or characters of a script without spaces: text's place, line number, first word and end among all words, key."""

    def __init__(self, texts: list[bytes], least: int):
        self.words = w = Words([t.lower().translate(_DIGITS) for t in texts], ALNUM)
        breaks = np.flatnonzero(w.symbols == 10)
        line = np.searchsorted(breaks, w.start)  # a break stands before each text too
        first = np.flatnonzero(np.diff(line, prepend=-1))
        end = np.append(first[1:], len(line))
        piece, _ = _pieces(w)
        enough = np.searchsorted(piece, w.end[end - 1]) - np.searchsorted(piece, w.start[first]) >= least
        first, end = first[enough], end[enough]
        self.first, self.end, self.doc = first, end, w.doc[first]
        self.number = line[first] - 1 - np.searchsorted(breaks, w.at[self.doc] - 1)
        keys = np.stack([span_hash(w.hash, first, end), span_hash(mix(w.hash ^ np.uint64(0xA0761D6478BD642F)), first, end)], axis=1)
        self.key = np.ascontiguousarray(keys.astype(">u8")).view("V16").ravel()

    def text(self, i: int) -> str:
        w = self.words
        raw = w.symbols[w.start[self.first[i]] : w.end[self.end[i] - 1]].tobytes()
        at = w.start[self.first[i]]
        return b" ".join(raw[a - at : b - at] for a, b in zip(w.start[self.first[i] : self.end[i]], w.end[self.first[i] : self.end[i]], strict=True)).decode()

    def simhash(self) -> np.ndarray:
        """(lines, BLOCKS) signed 32-bit blocks: bit by bit, the majority of the distinct words' hashes."""
        size = self.end - self.first
        if not len(size):
            return np.empty((0, BLOCKS), np.int32)
        # a line's distinct words, so that frequent words don't make all long lines alike
        word = np.repeat(self.first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        h, of = self.words.hash[word], np.repeat(np.arange(len(size)), size)
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
        h, size = h[new], np.bincount(of[new], minlength=len(size))
        # in segments of at most 255, as that is what a lane can count
        per = -(-size // 255)
        segment = np.repeat(np.cumsum(size) - size, per) + 255 * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
        line = np.cumsum(per) - per
        out = np.empty((len(size), BLOCKS * 4), np.uint8)
        for k in range(BLOCKS // 2):
            some = mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).astype("<u8").view(np.uint8).reshape(-1, 8)
            for j in range(8):
                lanes = np.add.reduceat(_LANES[some[:, j]], segment).astype("<u8").view(np.uint8).reshape(-1, 8)
                many = np.add.reduceat(lanes.astype(np.int32), line, axis=0)
                out[:, k * 8 + j] = np.packbits(2 * many > size[:, None], axis=1).ravel()
        return out.view("<i4")


    def size(self) -> np.ndarray:
        """Characters of each line's text."""
        w = self.words
        run = np.concatenate([[0], np.cumsum((w.symbols & 0xC0) != 0x80)])
        chars = np.concatenate([[0], np.cumsum(run[w.end] - run[w.start])])
        return chars[self.end] - chars[self.first] + self.end - self.first - 1

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Values of the lines one after another, and how many each has: the SimHash's blocks with their places."""
        h = self.simhash()
        return (h.view(np.uint32).astype(np.int64) | (np.arange(BLOCKS, dtype=np.int64) << 32)).ravel(), np.full(len(h), BLOCKS)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Values of the lines one after another, and how many each has: MinHashes of shingles, and hashes without one word."""
        w, n = self.words, len(self.first)
        start, end = _pieces(w)
        lo, hi = np.searchsorted(start, w.start[self.first]), np.searchsorted(start, w.end[self.end - 1])
        h, size = w.hash if start is w.start else span_hash(w.symbols, start, end), hi - lo
        letters = np.concatenate([[0], np.cumsum(end - start)])
        odd = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
        out, of = [], []
        for a in range(0, n, 4096):
            # from each word, as many as it takes to SPAN bytes; of long lines, the last words, with too few after them, begin none
            at, count = lo[a : a + 4096], size[a : a + 4096]
            begin = np.cumsum(count) - count
            place = np.repeat(at - begin, count) + np.arange(count.sum())
            ends = np.repeat(at + count, count)
            stop = np.searchsorted(letters, letters[place] + SPAN)
            whole = (stop <= ends) | np.repeat(count <= SHORT, count)
            stop = np.minimum(stop, ends)
            line = np.repeat(np.arange(len(at)), count)[whole]
            shingle = span_hash(h, place[whole], stop[whole])
            new = np.flatnonzero(np.diff(line, prepend=-1))
            many = np.diff(np.append(new, len(line)))
            halves = np.stack([new, new + many // 2], axis=1).ravel()  # of one shingle, both are that
            for k in range(HASHES if len(new) else 0):
                least = np.minimum.reduceat(shingle * odd[k], halves)
                out.append(mix(mix(least[::2] + np.uint64(k)) + least[1::2]))
                of.append(a + line[new])
        for p in range(1, SHORT + 1):
            some = np.flatnonzero(size == p)
            if len(some):
                m = h[lo[some][:, None] + np.arange(p)]
                for skip in range(p + 1):  # the last is the whole line
                    rest = np.delete(m, skip, axis=1) if skip < p else m
                    out.append(ngram_hash(rest.ravel(), rest.shape[1])[:: rest.shape[1]] if rest.shape[1] else np.zeros(len(some), np.uint64))
                    of.append(some)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        of, out = np.concatenate(of), np.concatenate(out)
        order = np.lexsort((out, of))
        of, out = of[order], out[order]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (out[1:] != out[:-1])])
        return out[new].view(np.int64), np.bincount(of[new], minlength=n)


def _keys(k: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(k), [None, pa.py_buffer(np.ascontiguousarray(k).tobytes())]).cast(pa.binary())


def found(d: DataFrame, least: int, near: str = "blocks") -> DataFrame:
    """doc_id, line, key, name (the key's first half), values of every line of enough words."""
    if near not in ("blocks", "pairs"):
        raise ValueError(f"near is {near}, not blocks or pairs")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in groups(texts):
                x = Lines(texts[lo:hi], least)
                values, n = getattr(x, near)()
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values, pa.int64()))
                name = x.key.view(">i8")[::2].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][x.doc], pa.int64()), pa.array(x.number, pa.int32()), _keys(x.key), pa.array(name), values], names=["doc_id", "line", "key", "name", "values"])
        trim()

    return d.where("doc_id is not null").mapInArrow(rows, "doc_id long, line int, key binary, name long, values array<long>")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"


def _texts(d: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """id, name, words (normalised text) and size of the lines at the given occurrences (id, name, key, doc_id, line)."""
    wanted = written(firsts.groupBy("doc_id").agg(F.collect_list(F.struct("line", "id", "name", "key")).alias("asked")), "wanted")  # some lines of one document
    split = small(wanted).join(d.select("doc_id", F.split("text", "\n").alias("split")), "doc_id").select("split", F.explode("asked").alias("w"))
    words = F.btrim(F.regexp_replace(F.translate(F.get("split", F.col("w.line")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    out = split.select("w.id", "w.name", "w.key", words.alias("words")).where("words is not null")

    # rows that share an id have lines of their own under that number: only the one of this key is meant
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() for t in b.column("words").to_pylist()]
            for lo, hi in groups(texts):
                x = Lines(texts[lo:hi], 1)
                same = np.zeros(hi - lo, bool)
                asked = np.array([k for k in b.column("key").slice(lo, hi - lo).to_pylist()], "V16")
                same[x.doc] = x.key == asked[x.doc]
                yield b.slice(lo, hi - lo).filter(pa.array(same)).select(["id", "name", "words"])

    t = out.mapInArrow(rows, "id long, name long, words string")
    return written(t.dropDuplicates(["id"]).withColumn("size", F.char_length("words")), "texts")


def _same(a: str, b: str) -> int:
    """Characters that the beginnings have in common."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def _alone(a: str, b: str, most: int) -> int:
    """The edit distance of a and b, which is not shorter, or ``most`` + 1: bit-parallel, a column of the table as one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score, left = full, 0, len(a), len(b)
    for c in b:
        x = at.get(c, 0) | down
        zero = (((x & up) + up) ^ up | x) & full
        plus, minus = down | full ^ (up | zero), up & zero
        left -= 1
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        if score - left > most:
            return most + 1
        plus = plus << 1 | 1
        down = plus & zero
        up = (minus << 1 | full ^ (full & plus | zero)) & full
    return score


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``.

    Common beginnings and ends go first. What is left of n characters takes n steps over n bits.
    """
    k = _same(a, b)
    a, b = a[k:], b[k:]
    k = _same(a[::-1], b[::-1])
    a, b = sorted((a[: len(a) - k], b[: len(b) - k]), key=len)
    if len(b) - len(a) > most:
        return False
    return len(b) <= most or bool(a) and _alone(a, b, most) <= most


#: Longest text whose edit distance is taken many pairs at a time, and 64-bit words of masks that are held for them.
LANES, TOGETHER = 2048, 1 << 20


def _together(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of like length, none of b longer than a; ``most`` + 1 where that is exceeded.

    The diagonals that a path of ``most`` edits can touch are a column of bits, which moves down a row with each character
    of b. A distance never falls along a diagonal, so a pair ends where that of the last cell's exceeds ``most``.
    """
    m, n, one = np.array([len(x) for x in a]), np.array([len(y) for y in b]), np.uint64(1)
    above = (most - (m - n)) // 2  # diagonals above the first cell's
    target = m - n + above
    words = int(target.max() + above.max()) // 64 + 1
    code = lambda t: np.frombuffer("".join(t).encode("utf-32-le"), "<u4")
    place = lambda size: np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    x, y, pair = code(a), code(b), np.arange(len(a))
    known = np.zeros(int(max(x.max(), y.max())) + 1, bool)
    known[x] = True
    letter = np.cumsum(known) * known  # 0: in no a
    kinds = int(known.sum()) + 1
    # masks[w, k * pairs + p]: where a of pair p has letter k, from ``above`` rows before its first
    rows = int(max((m + above).max(), n.max() + 64 * words)) // 64 + 2
    if len(a) > 1 and rows * kinds * len(a) > 4 * TOGETHER:
        k = len(a) // 2
        return np.concatenate([_together(a[:k], b[:k], most[:k]), _together(a[k:], b[k:], most[k:])])
    masks, i = np.zeros((rows, kinds * len(a)), np.uint64), place(m) + np.repeat(above, m)
    np.bitwise_or.at(masks.ravel(), (i >> 6) * masks.shape[1] + letter[x] * len(a) + np.repeat(pair, m), one << (i & 63).astype(np.uint64))
    steps = np.zeros((int(n.max()), len(a)), np.int64)
    steps[place(n), np.repeat(pair, n)] = letter[y] * len(a)
    steps += pair

    out, who, last, far = most + 1, pair, n, m - n
    bit = np.where(target >> 6 == np.arange(words)[:, None], one << (target & 63).astype(np.uint64), np.uint64(0))
    start = np.clip(above - 64 * np.arange(words)[:, None], 0, 64)  # rows before the first differ by nothing
    up = np.where(start < 64, ~np.uint64(0) << np.minimum(start, 63).astype(np.uint64), np.uint64(0))
    down, limit, ends = np.zeros_like(up), most, set(n.tolist())
    for j in range(len(steps) + 1):
        if j in ends or j % 8 == 0:
            over = last == j
            out[who[over]] = np.minimum(far[over], out[who[over]])
            stay = ~over & (far <= limit)
            if np.count_nonzero(stay) < (len(who) if over.any() else 0.8 * len(who)):
                who, last, far, limit, bit, up, down = who[stay], last[stay], far[stay], limit[stay], bit[:, stay], up[:, stay], down[:, stay]
            if not len(who):
                break
        c, by, add, zeros = steps[j, who], np.uint64(j & 63), None, []
        for w in range(words):
            x = masks[(j >> 6) + w][c] >> by
            if j & 63:
                x |= masks[(j >> 6) + w + 1][c] << (np.uint64(64) - by)
            p = up[w]
            total = (x & p) + p
            if w + 1 < words or add is not None:
                carry = total < p
                if add is not None:
                    total += add
                    carry |= total < add
                add = carry.astype(np.uint64)
            zeros.append((total ^ p) | x | down[w])
        hit = zeros[0] & bit[0]
        for w in range(1, words):
            hit |= zeros[w] & bit[w]
        far = far + (hit == 0)
        for w in range(words):
            zero, p = zeros[w], up[w]
            plus, minus = down[w] | ~(zero | p), zero & p
            zero = zero >> one
            if w + 1 < words:
                zero |= zeros[w + 1] << np.uint64(63)
            up[w], down[w] = minus | ~(zero | plus), zero & plus
    return out


def distances(a: list[str], b: list[str], most: list[int]) -> np.ndarray:
    """The edit distance of each pair, or any larger number than ``most`` if it exceeds that. Pairs of like length go together."""
    most = np.array(most, np.int64)
    out, some = most + 1, []
    for i, (x, y, m) in enumerate(zip(a, b, most.tolist(), strict=True)):
        if len(x) < len(y):
            x, y = y, x
        if len(x) - len(y) > m:
            continue
        k = _same(x, y)
        x, y = x[k:], y[k:]
        k = _same(x[::-1], y[::-1])
        x, y = x[: len(x) - k], y[: len(y) - k]
        if not y:
            out[i] = len(x)
        elif len(x) > LANES:
            out[i] = _alone(y, x, m)
        else:
            some.append((min(m, len(x)) // 64, -len(x), i, x, y, min(m, len(x))))
    some.sort(key=lambda t: t[:3])
    lo = 0
    while lo < len(some):
        hi = min(len(some), lo + max(1, TOGETHER // (40 * (2 - some[lo][1] // 64))))
        while some[hi - 1][0] != some[lo][0]:
            hi -= 1
        _, _, i, x, y, m = zip(*some[lo:hi], strict=True)
        m, i = np.array(m), list(i)
        got = _together(x, y, m)
        out[i] = np.where(got <= m, got, out[i])
        lo = hi
    return out


def all_within(a: list[str], b: list[str], most: list[int]) -> np.ndarray:
    """``within`` of each pair."""
    return distances(a, b, most) <= np.array(most, np.int64)


#: Counters of neighbouring characters in a bag, and characters of lines whose bags are compared at once.
BAG, CHUNK = 256, 1 << 21


def _bag(texts: list[str], apart: np.uint32) -> np.ndarray:
    """(texts, BAG) numbers of pairs of neighbouring characters, which share a counter if their hashes do."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = of[1:] == of[:-1]
    pair = ((code[:-1] * np.uint32(0x9E3779B1) + code[1:]) * apart) >> np.uint32(24)
    return np.bincount(of[1:][inside] * BAG + pair[inside], minlength=len(texts) * BAG).reshape(-1, BAG)


def possible(a: list[str], b: list[str], most: list[int]) -> np.ndarray:
    """Which pairs may be within their edit distances: an edit takes away or adds at most two pairs of neighbours.

    Exact as a bound: counters that several pairs share only make bags look more alike. Costs in proportion to the texts.
    """
    out = np.ones(len(a), bool)
    size = np.cumsum([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK, "right")))
        hi = min(hi, lo + 4096)
        gap = _bag(a[lo:hi], np.uint32(0x85EBCA6B)) - _bag(b[lo:hi], np.uint32(0x85EBCA6B))
        lost, won = np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1)
        out[lo:hi] = np.maximum(lost, won) <= 2 * np.array(most[lo:hi], np.int64)
        lo = hi
    return out


def _most(a: str, b: str, similarity: float) -> Column:
    return F.floor(F.lit(1 - similarity + 1e-9) * F.greatest(a, b)).cast("int")


def linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the written pairs whose edit distance is at most (1 - similarity) of the longer line.

    A line that meets very many others is dealt out in parts, each with a copy of its text.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, most = (batch.column(c).to_pylist() for c in ("words_a", "words_b", "most"))
            may = np.flatnonzero(possible(x, y, most))
            close = all_within(*[[c[i] for i in may] for c in (x, y, most)])
            yield batch.select(["a", "b"]).take(pa.array(may[close]))
        trim()

    side = lambda c: texts.select(F.col("id").alias(c), F.col("words").alias(f"words_{c}"), F.col("size").alias(f"size_{c}"))
    m = dealt(pairs.join(side("a"), "a"), side("b"), pairs, "b")
    m = m.withColumn("most", _most("size_a", "size_b", similarity)).where(F.abs(F.col("size_a") - F.col("size_b")) <= F.col("most"))
    return written(m.select("a", "b", "words_a", "words_b", "most").mapInArrow(rows, "a long, b long"), "linked")


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def duplicates(documents: DataFrame, least: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", near: str = "blocks") -> DataFrame:
    """doc_id, removed (line numbers from 0), kept_in (documents that hold the lines that stay), of documents that lose lines."""
    d = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    lines = written(found(d, least, near), "lines")
    nodes = lines.groupBy("key", "name").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    # most values stand in one node: they go before anything wider is shuffled. The smallest name of a list is its pivot
    values = lines.select(F.explode("values").alias("value"), "name")
    several = values.groupBy("value").agg(F.min("name").alias("pivot"), F.max("name").alias("last")).where("pivot < last").select("value", "pivot")
    listed = written(values.join(small(written(several, "several")), "value").distinct(), "listed")
    names = written(listed.select("name").distinct(), "names")
    near_nodes = nodes.join(small(names), "name", "left_semi")
    texts = _texts(d, near_nodes.select("id", "name", "key", "first.doc_id", "first.line"), least)
    of = lambda c: texts.select(F.col("name").alias(f"name_{c}"), F.col("id").alias(c), F.col("size").alias(f"size_{c}"))
    # names are half keys: two nodes of one name both stand for it
    lists = written(listed.select("value", "pivot", F.col("name").alias("name_a")).join(of("a"), "name_a").drop("name_a"), "lists")

    # each node with the pivot it meets most often, of those whose sizes allow a link; then with the others that are still apart
    close = F.abs(F.col("size_a") - F.col("size_b")) <= _most("size_a", "size_b", similarity)
    star = lists.groupBy("a", "size_a", F.col("pivot").alias("name_b")).agg(F.count(F.lit(1)).alias("n"))
    star = written(star.join(of("b"), "name_b").where(close & (F.col("a") != F.col("b"))).select("a", "b", "n"), "star")
    done = written(_pairs(star.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", "m.b")), "pairs")
    links = linked(done, texts, similarity)
    for step in ("pivots", "lists"):
        root = written(components(links), "roots")
        at = lambda df, c: df.join(root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))  # noqa: B023, E731
        if step == "pivots":
            apart = _pairs(at(at(star, "a"), "b").where("root_a <> root_b"))
        else:
            named = at(lists.drop("pivot"), "a")
            mixed = named.groupBy("value").agg(F.min("root_a").alias("lo"), F.max("root_a").alias("hi")).where("lo < hi").select("value")
            # two nodes meet in the smallest value that both have, so each pair comes once, however many values it has in common
            named = named.join(mixed, "value").groupBy("a", "size_a", "root_a").agg(F.array_sort(F.collect_set("value")).alias("all_a"))
            named = written(named.select("*", F.explode("all_a").alias("value")), "mixed")
            met = named.join(named.withColumnsRenamed({"a": "b", "size_a": "size_b", "root_a": "root_b", "all_a": "all_b"}), "value")
            met = met.where((F.col("root_a") < F.col("root_b")) & close & (F.array_min(F.array_intersect("all_a", "all_b")) == F.col("value")))
            apart = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = written(apart.join(done, ["a", "b"], "left_anti"), "pairs")
        known = root.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        links = known.unionByName(linked(more, texts, similarity))
        done = done.unionByName(more)

    root = components(links).select(F.col("node").alias("id"), "root")
    grouped = written(nodes.join(root, "id", "left").where("root is not null or n > 1").select("key", "first", F.coalesce("root", "id").alias("root")), "grouped")
    stays = grouped.groupBy("root").agg(F.min("first").alias("stays"))
    stays = written(grouped.join(stays, "root").select("key", "stays"), "stays")
    gone = lines.select("doc_id", "line", "key").join(small(stays), "key")
    gone = gone.where((F.col("doc_id") != F.col("stays.doc_id")) | (F.col("line") != F.col("stays.line")))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"), F.array_sort(F.collect_set("stays.doc_id")).alias("kept_in"))


def deduplicated(documents: DataFrame, least: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", near: str = "blocks") -> DataFrame:
    """All documents with ``text`` without its removed lines; removed_lines and kept_in (null where nothing goes) are added, or replace columns of these names."""
    documents = documents.drop("removed_lines", "kept_in")
    gone = written(duplicates(documents, least, similarity, key, text, near), "removed").withColumnsRenamed({"doc_id": "_gone_id", "removed": "removed_lines"})
    out = documents.join(small(gone), documents[key] == gone["_gone_id"], "left").drop("_gone_id")
    rest = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("removed_lines", i)), "\n")
    return out.withColumn(text, F.when(F.col("removed_lines").isNull(), F.col(text)).otherwise(rest))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deduplicated(docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")), near="pairs")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"), "kept_in")
