"""Bounded samples of labelled documents, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(labelled: DataFrame, most: int, max_bytes: int, classes: int = 200, total_bytes: int = 256 << 20) -> list[tuple]:
    """Up to about ``most`` rows (label, text) of each label, chosen by a hash of the id, of texts up to ``max_bytes``.

    ``labelled`` has doc_id, text and label; at most ``classes`` labels, the most frequent. All together are about
    ``total_bytes``, of which each label may take an equal part.
    """
    ok = labelled.where(F.col("label").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    counts = ok.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("n"), "label").limit(classes).collect()
    share = F.lit(0)
    for r in counts:
        part = min(1.0, most / r["n"], total_bytes / len(counts) / max(1, r["bytes"]))
        share = F.when(F.col("label") == F.lit(r["label"]), F.lit(int(1_000_000 * part))).otherwise(share)
    taken = ok.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share).select("label", "text")
    return [(r["label"], r["text"].encode()) for r in taken.limit(most * max(1, len(counts)) * 11 // 10).collect()]
