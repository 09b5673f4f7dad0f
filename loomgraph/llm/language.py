"""Word-first language identification with backoff to character n-grams.

A known word scores by its log frequency in each language; an unseen one by the mean log frequency of its character n-grams,
of the longest order of which any is known, from ``ORDERS[0]`` down to single characters. A text's language has the highest
sum. The model is fitted on a bounded sample of labelled documents; every whole text is scored.

Defined cases: null text, or one without letters: ``und``, score 0. No labelled rows: all ``und``. Null id: not held out.
Ties: the first language in alphabetical order. Repeated rows are scored alike. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .samples import sampled
from .words import Table, groups, span_hash

ORDERS = (4, 3, 2, 1)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Letters:
    """Runs of letters of lower-cased texts, over code points."""

    def __init__(self, texts: list[bytes]):
        lower = [t.decode(errors="replace").lower() for t in texts]
        self.symbols = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        inside = letters()[self.symbols]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        at = np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in lower])])
        self.first = np.searchsorted(self.start, at)
        self.hash = span_hash(self.symbols, self.start, self.end)


def _grams(x: Letters, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word's place in ``which``, hash) of each n-gram, with the word's borders as characters of it."""
    size = x.end[which] - x.start[which] + 2 - n + 1
    word = np.repeat(np.arange(len(which)), np.maximum(size, 0))
    ends = np.cumsum(np.maximum(size, 0))
    at = x.start[which][word] - 1 + np.arange(len(word)) - (ends - np.maximum(size, 0))[word]
    return word, at


class Model:
    def __init__(self, langs: list[str], words, grams):
        self.langs, self.words, self.grams = langs, words, grams

    @staticmethod
    def _part(hashes: np.ndarray, times: np.ndarray, lang: np.ndarray, langs: int, least: int) -> tuple[Table, np.ndarray]:
        keys, place = np.unique(hashes, return_inverse=True)
        counts = np.stack([np.bincount(place[lang == k], weights=times[lang == k], minlength=len(keys)) for k in range(langs)], axis=1)
        known = counts.sum(axis=1) >= least
        keys, counts = keys[known], counts[known]
        t = Table(max(1, len(keys)))
        t.add(keys, np.arange(len(keys), dtype=np.int32))
        return t, np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * max(1, len(keys)))).astype(np.float32)

    def scores(self, x: Letters) -> np.ndarray:
        """Log score of each text (rows) in each language."""
        per = np.zeros((len(x.hash), len(self.langs)), np.float32)
        known = self.words[0].find(x.hash)
        per[known >= 0] = self.words[1][known[known >= 0]]
        rest = np.flatnonzero(known < 0)
        _, one, back = np.unique(x.hash[rest], return_index=True, return_inverse=True)
        which = rest[one]
        found, open_ = np.zeros((len(which), len(self.langs)), np.float32), np.arange(len(which))
        symbols = bordered(x.symbols)
        for n in ORDERS:
            if not len(open_):
                break
            word, at = _grams(x, which[open_], n)
            k = self.grams[n][0].find(_spans(symbols, at, n))
            word, k = word[k >= 0], k[k >= 0]
            times = np.bincount(word, minlength=len(open_))
            some = np.flatnonzero(times)
            for j in range(len(self.langs)):
                found[open_[some], j] = np.bincount(word, weights=self.grams[n][1][k, j], minlength=len(open_))[some] / times[some]
            open_ = open_[times == 0]
        per[rest] = found[back]
        total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(per, axis=0, dtype=np.float64)])
        return total[x.first[1:]] - total[x.first[:-1]]


def bordered(symbols: np.ndarray) -> np.ndarray:
    """Every character but letters as one border sign."""
    return np.where(letters()[symbols], symbols, np.uint32(32))


def _spans(symbols: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``symbols[at:at + n]`` in any order of ``at``, n up to 4."""
    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h = (h ^ symbols[at + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def fit(sample: list[tuple[str, bytes]]) -> Model:
    """Fit on (language, text)."""
    langs = sorted({y for y, _ in sample})
    if not langs:
        return Model([], None, None)
    words, grams = [], {n: [] for n in ORDERS}

    def add(to: list, hashes: np.ndarray, lang: int) -> None:
        """Counted at once, so that memory goes with distinct hashes."""
        keys, times = np.unique(hashes, return_counts=True)
        to.append((keys, times.astype(np.int32), np.full(len(keys), lang, np.int16)))

    for k, lang in enumerate(langs):
        texts = [t for y, t in sample if y == lang]
        for lo, hi in groups(texts, 1 << 21):
            x = Letters(texts[lo:hi])
            add(words, x.hash, k)
            symbols = bordered(x.symbols)
            # n-grams of distinct words, as unseen words are rather of that kind
            _, one = np.unique(x.hash, return_index=True)
            for n in ORDERS:
                add(grams[n], _spans(symbols, _grams(x, one, n)[1], n), k)
    part = lambda found, least: Model._part(*(np.concatenate(c) for c in zip(*found, strict=True)), len(langs), least)
    return Model(langs, part(words, 2), {n: part(grams[n], 1) for n in ORDERS})


def identified(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score, the language's posterior under equal priors."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in groups(texts):
                x = Letters(texts[lo:hi])
                none = np.diff(x.first) == 0
                if not m.langs:
                    names, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                else:
                    s = m.scores(x)
                    p = np.exp(s - s.max(axis=1, keepdims=True))
                    best = s.argmax(axis=1)
                    names = ["und" if e else m.langs[k] for e, k in zip(none.tolist(), best.tolist(), strict=True)]
                    score = np.where(none, 0.0, 1 / p.sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    d = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(rows, "doc_id long, lang_pred string, score double")


def fitted(documents: DataFrame, most: int = 2000, max_bytes: int = 20_000) -> Model:
    """Fit on at most about ``most`` documents of each language, of up to ``max_bytes`` bytes, outside the held-out fold."""
    return fit(sampled(documents.where(fold("doc_id", 4) != 2).select("doc_id", "text", F.col("lang").alias("label")), most, max_bytes))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = identified(documents, fitted(documents))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
