"""Best-two-fit packing of pieces into sequences.

Only lengths matter to a plan, and there are at most ``size`` of them: the plan is made on their counts. A sequence is
filled greedily with the longest length that fits; then its smallest document gives way to two unpacked ones if they fill
the gap better. The same filling is used as often as its lengths last, so each step uses up a length and the plan stays
bounded whatever the corpus. Pieces are then numbered within their length, in salted parts, and a piece's number says which
sequence and place it takes.

Defined cases: null text: empty (the end id alone). Longer documents are cut, never others. Repeated rows are packed each.
Null ids are packed too. Empty table: no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, table, trim, written
from .tokens import crc, encoded

#: Pieces of one length that one window numbers, at most about this many.
PART = 20_000
#: Pieces of text whose ids a worker keeps after its task: what it holds stands beside whatever its executor runs next.
KEPT = 1 << 19


def pieces(documents: DataFrame, tokenizer: str, end: int, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and end id, cut at ``size``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in encoded(batches, tokenizer, end, KEPT):
            out = [(k, i, i * size, len(x[i * size : (i + 1) * size]), crc(x[i * size : (i + 1) * size])) for k, x in zip(keys, ids, strict=True) for i in range(-(-len(x) // size))]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    d = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: how many}) of each filling, until all counts are used."""
    left = dict(counts)
    lengths = sorted(n for n in left if left[n] > 0)
    fillings = []
    while lengths:
        used: Counter[int] = Counter()
        free = lambda n: left[n] - used[n] > 0  # noqa: B023, E731

        def longest(gap: int) -> int:
            i = bisect_right(lengths, gap) - 1  # noqa: B023
            while i >= 0 and not free(lengths[i]):  # noqa: B023
                i -= 1
            return lengths[i] if i >= 0 else 0  # noqa: B023

        gap = size
        while gap and (n := longest(gap)):
            k = min(left[n] - used[n], gap // n)
            used[n] += k
            gap -= k * n
        if gap and sum(used.values()) > 1:
            least = min(used)
            room, best = gap + least, (least, 0, 0)
            for i in range(bisect_right(lengths, room - 1) - 1, -1, -1):
                a = lengths[i]
                if 2 * a <= best[0]:
                    break
                if not free(a):
                    continue
                used[a] += 1
                b = longest(min(room - a, a))
                used[a] -= 1
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
            if best[1]:
                used[least] -= 1
                used[best[1]] += 1
                used[best[2]] += 1
        used = +used
        times = min(left[n] // k for n, k in used.items())
        fillings.append((times, dict(used)))
        for n, k in used.items():
            left[n] -= times * k
        lengths = [n for n in lengths if left[n] > 0]
    return fillings


def packed(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, length) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    ranges, taken, sequence = [], Counter(), 0
    for times, used in plan(counts, size):
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            ranges.append((n, taken[n], taken[n] + times * k, times, sequence, offset))
            taken[n] += times * k
            offset += n * k
        sequence += times
    slots = spark.createDataFrame(ranges, "length long, lo long, hi long, times long, first_sequence long, first_offset long")
    parts = max(1, sum(counts.values()) // PART)
    p = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    per = p.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = p.withColumn("rank", rank).join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = numbered.join(small(slots), (numbered.length == slots.length) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(slots.length)
    k = F.col("rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("first_sequence") + F.pmod(k, F.col("times"))).withColumn("offset", F.col("first_offset") + F.floor(k / F.col("times")) * F.col("length"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(documents: DataFrame, size: int = 2048, end: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Tokenize, cut and pack; the tokenizer's file defaults to the public word BPE of 49,408 ids."""
    import public_tokenizers

    p = written(pieces(documents, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end, size), "pieces")
    return packed(p, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
