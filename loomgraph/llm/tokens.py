"""Token ids of whole texts, and their binary files.

Files: Parquet, whose rows are runs of documents in ascending id order. A row holds the documents' ids and lengths and
their token ids in Simple-8b words, with the first word of each block of ids, and the escapes. ``shard`` and ``run``
order the rows, and ``before`` counts the shard's ids before the row.

Defined cases: null text: empty (its end id alone). Null id: first. Repeated rows: each is written. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import scratch, small, table
from .words import NOT_SPACE, Table, Words, groups, span_hash


#: Points that end a word. After an ASCII letter they begin a token of their own.
_POINT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_POINT[list(b".,;:!?")] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


class Encoder:
    """The library's ids of texts, piece by piece.

    The tokenizer drops white space, lower-cases, and never joins anything across ASCII white space or from a letter to a
    point, so a text's ids are those of such pieces in order. Pieces repeat: each is encoded once, and up to ``most`` of
    them are kept by hash.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.clear()

    def clear(self) -> None:
        self.place, self.pieces = Table(self.most), 0
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size = np.empty(self.most, np.int64), np.empty(self.most, np.int32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        for lo in range(0, len(pieces), 10_000):
            found = self.tokenizer.encode_batch_fast(pieces[lo : lo + 10_000], add_special_tokens=False)
            ids = [e.ids for e in found]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            n, k = int(size.sum()), self.pieces + len(ids)
            if self.used + n > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(len(self.flat) + n, np.uint32)])
            self.flat[self.used : self.used + n] = np.fromiter(chain.from_iterable(ids), np.uint32, n)
            self.start[self.pieces : k], self.size[self.pieces : k] = self.used + np.cumsum(size) - size, size
            self.place.add(hashes[lo : lo + 10_000], np.arange(self.pieces, k, dtype=np.int32))
            self.used, self.pieces = self.used + n, k

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        # a special token's name counts as written, so case stays where one may be
        w = Words([t if b"<|" in t else t.lower() for t in texts], NOT_SPACE, hashed=False)
        long = w.end - w.start > 1
        split = long & _POINT[w.symbols[w.end - 1]] & _LETTER[w.symbols[w.end - 2]]
        last = np.cumsum(1 + split)
        start, end = np.repeat(w.start, 1 + split), np.repeat(w.end, 1 + split)
        point = last[split] - 1
        start[point] = end[point] - 1
        end[point - 1] -= 1
        h = span_hash(w.symbols, start, end)
        k = self.place.find(h)
        fresh, at = np.unique(h[k < 0], return_index=True)
        if len(fresh):
            if self.pieces + len(fresh) > self.most:
                self.clear()
                fresh, at = np.unique(h, return_index=True)
                if len(fresh) > self.most:
                    self.most = len(fresh)
                    self.clear()
            else:
                at = np.flatnonzero(k < 0)[at]
            raw = w.symbols.tobytes()
            self._learn(fresh, [raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            k = self.place.find(h)
        size = self.size[k].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[k] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.concatenate([[0], ends])[np.concatenate([[0], last])[w.first]]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str, most: int = 1_500_000) -> Encoder:
    return Encoder(path, most)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int, most: int = 1_500_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids of the documents' rows (first column) and the token ids of their texts (second) with the end id, a few MB at a time.

    The worker keeps up to ``most`` pieces and their ids for its next task.
    """
    enc = encoder(path, most)
    for b in batches:
        keys, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
        for lo, hi in groups(texts):
            yield keys[lo:hi], [np.append(x, np.uint32(end)) for x in enc(texts[lo:hi])]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


_FILE = "shard int, run int, before long, doc_id array<long>, n_tokens array<long>, words binary, block_word binary, escape_at binary, escape_value binary"


def write(documents: DataFrame, path: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all texts, each followed by ``end``, in ascending key order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, before = TaskContext.get().partitionId(), 0
        for run, (keys, ids) in enumerate(encoded(batches, tokenizer, end)):
            flat = np.concatenate(ids)
            words, first, at, value = simple8b.encode(flat)
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "run": run, "before": before, "doc_id": keys, "n_tokens": [len(x) for x in ids], "words": words.astype("<u8").tobytes(), "block_word": first.astype("<u4").tobytes(), "escape_at": at.astype("<u4").tobytes(), "escape_value": value.astype("<u8").tobytes()}],
                schema=pa.schema([("shard", pa.int32()), ("run", pa.int32()), ("before", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("words", pa.binary()), ("block_word", pa.binary()), ("escape_at", pa.binary()), ("escape_value", pa.binary())]),
            )
            before += len(flat)

    d = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    d.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(rows, _FILE).write.parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the token ids if asked for."""
    files = spark.read.schema(_FILE).parquet(path)
    # one row a shard: ids of the shards before it
    shards = files.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["n_tokens"], np.int64)
                ends = np.cumsum(n)
                raw = lambda c, kind: np.frombuffer(r[c], kind)  # noqa: B023, E731
                flat = simple8b.decode(raw("words", "<u8"), raw("block_word", "<u4"), int(ends[-1]), raw("escape_at", "<u4"), raw("escape_value", "<u8"))
                each = np.split(flat, ends[:-1])
                out = {"doc_id": pa.array(r["doc_id"], pa.int64()), "start": pa.array(r["shard_start"] + r["before"] + ends - n), "n_tokens": pa.array(n), "ids_crc32": pa.array([crc(x) for x in each], pa.int64())}
                if ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    joined = files.join(small(shards), "shard").select("shard_start", *[c.split()[0] for c in _FILE.split(", ") if c.split()[0] not in ("shard", "run")])
    return joined.mapInArrow(docs, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "ids")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return read(spark, path, ids=False)
