"""Benchmark decontamination by winnowing.

Of every run of ``window - gram + 1`` word grams the smallest hash is kept (all places, if it occurs more than once), in
items and documents alike, so any shared span of ``window`` words has a common fingerprint. Fingerprints are joined, each
hit is extended in both directions, and spans of at least ``window`` words count. Items shorter than a window count as a whole.

The benchmark is taken in blocks of bounded bytes, each broadcast to one pass over the documents; documents are not shuffled.

Defined cases: null or empty text: no words, no hits. Items without words: never found. Items of equal text all count.
Null item id: counts under the id "". Repeated document rows: each gets a row. Empty tables: no rows, or no hits. Very
long texts are taken whole. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .words import ALNUM, Table, Words, groups, ngram_hash

#: Bytes of benchmark text in one broadcast block, and blocks between two written tables.
BLOCK_BYTES, CHAIN = 16 << 20, 4


def _least(g: np.ndarray, same: np.ndarray, span: int) -> np.ndarray:
    """Which grams are the smallest of a run of ``span``; ``same[i]`` says that the run from i lies within one text."""
    n = len(g) - span + 1
    keep = np.zeros(len(g), bool)
    if n > 0:
        least = g[:n].copy()
        for j in range(1, span):
            np.minimum(least, g[j : j + n], out=least)
        for j in range(span):
            keep[j : j + n] |= (g[j : j + n] == least) & same[:n]
    return keep


def winnowed(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (first word) and hashes of the kept grams."""
    g = ngram_hash(w.hash, gram)
    n = max(0, len(w.doc) - window + 1)
    at = np.flatnonzero(_least(g, w.doc[:n] == w.doc[window - 1 :][:n], window - gram + 1))
    return at, g[at]


class Items:
    """Fingerprints of a block of items."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int, gram: int):
        self.ids, self.window, self.gram = ids, window, gram
        w = Words([t.lower() for t in texts], ALNUM)
        self.hash, self.first = w.hash, w.first
        self.at: dict[int, list[tuple[int, int]]] = {}
        for at, h in zip(*winnowed(w, window, gram), strict=True):
            self.at.setdefault(int(h), []).append((int(w.doc[at]), int(at)))
        keys = np.array(list(self.at), np.uint64)
        self.table = Table(max(1, len(keys)))
        self.table.add(keys, np.arange(len(keys), dtype=np.int32))
        #: length: {hash of the whole item: items}
        self.whole: dict[int, dict[int, list[int]]] = {}
        for i, (lo, hi) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
            if 0 < hi - lo < window:
                self.whole.setdefault(int(hi - lo), {}).setdefault(int(ngram_hash(w.hash[lo:hi], int(hi - lo))[0]), []).append(i)

    def found(self, w: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items found in each text."""
        hit, items = np.zeros(len(w.hash), bool), defaultdict(set)
        at, h = winnowed(w, self.window, self.gram)
        known = np.flatnonzero(self.table.find(h) >= 0)
        seen = set()
        for p, x in zip(at[known].tolist(), h[known].tolist(), strict=True):
            d = int(w.doc[p])
            for i, q in self.at[x]:
                if (d, i, p - q) in seen:
                    continue
                seen.add((d, i, p - q))
                # along this alignment, every run of equal words that is long enough
                before = min(p - w.first[d], q - self.first[i])
                after = min(w.first[d + 1] - p, self.first[i + 1] - q)
                equal = np.concatenate([[False], w.hash[p - before : p + after] == self.hash[q - before : q + after], [False]])
                edge = np.flatnonzero(equal[1:] != equal[:-1])
                for lo, hi in zip(edge[::2], edge[1::2], strict=True):
                    if hi - lo >= self.window:
                        hit[p - before + lo : p - before + hi] = True
                        items[d].add(self.ids[i])
        for n, whole in self.whole.items():
            g = ngram_hash(w.hash, n)
            for p in np.flatnonzero(np.isin(g, np.array(list(whole), np.uint64))).tolist():
                if w.doc[p] == w.doc[p + n - 1]:
                    hit[p : p + n] = True
                    items[int(w.doc[p])].update(self.ids[i] for i in whole[int(g[p])])
        return hit, items


_OUT = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def _pass(d: DataFrame, model) -> DataFrame:
    """Add one block's hits to spans and items."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Items = model.value
        for b in batches:
            texts = [(t or b"").lower() for t in b.column("text").cast(pa.binary()).to_pylist()]
            old = zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True)
            spans, items, counts = [], [], []
            for lo, hi in groups(texts):
                w = Words(texts[lo:hi], ALNUM)
                hit, found = m.found(w)
                hits = set(np.unique(w.doc[hit]).tolist())
                for k, (was, names) in zip(range(hi - lo), old, strict=False):
                    first, last = int(w.first[k]), int(w.first[k + 1])
                    if k in hits:
                        mark = hit[first:last]
                        for s in was:
                            mark[s["start"] : s["end"]] = True
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]]).astype(np.int8)))
                        was = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                        names = sorted({*names, *found[k]})
                    spans.append(was)
                    items.append(names)
                    counts.append(last - first)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(counts, pa.int64()), pa.array(spans, out.field("spans").type), pa.array(items, out.field("items").type)], schema=out)

    return d.mapInArrow(rows, f"doc_id long, text string, {_OUT}")


def hits(documents: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text, n_words, spans of hit words (from word 0, ends exclusive) and the sorted ids of the items found."""
    spark = documents.sparkSession
    b = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = int(size) // BLOCK_BYTES + 1
    none = ["cast(0 as long) as n_words", "cast(array() as array<struct<start: long, end: long>>) as spans", "cast(array() as array<string>) as items"]
    d = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).selectExpr("*", *none)
    for k in range(blocks):
        own = b.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()  # about BLOCK_BYTES
        d = _pass(d, spark.sparkContext.broadcast(Items([r["id"] for r in own], [r["text"].encode() for r in own], window, gram)))
        if k % CHAIN == CHAIN - 1:
            d = written(d, "hits")
    return d


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return h.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, unnest(CASE WHEN len(ws) < 10 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i+9], ' ')) END) AS g,
              least(len(ws), 10) AS n FROM b WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, lens WHERE len(ws) >= n),
m AS (SELECT doc_id, item_id, i, dw.n AS n FROM (SELECT doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') AS g FROM dw) dw JOIN bw ON bw.n = dw.n AND bw.g = dw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
