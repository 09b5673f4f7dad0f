"""Corpus pipeline: toxicity, line dedup, Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents, whatever else these
are called. Empty tables pass as such; null and empty texts stay up to packing; texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, jaccard, lines, packing, toxicity
from loomgraph.llm.common import small, table, written


OWN = ("doc_id", "text", "n_chars")


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that no stage reads under names that none uses."""
    return docs.withColumnsRenamed({c: f"_carried_{k}" for k, c in enumerate(docs.columns) if c not in OWN})


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, by their names, of what was made of ``_apart(docs)``."""
    return out.select(*[F.col(c if c in OWN else f"_carried_{k}").alias(c) for k, c in enumerate(docs.columns)])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 stay; repeated rows and rows without an id are scored as any others."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    rows = _apart(docs)
    return _back(toxicity.scored(rows, model, rows.columns, least=0.7), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing but white space is left by that.

    Rows without an id keep their lines; rows that share an id lose the same lines.
    """
    out = lines.deduplicated(_apart(docs), near="pairs").where(F.col("removed_lines").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("n_chars", F.when(F.col("removed_lines").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return _back(out, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; of rows that share an id and have words, the one of the smallest text.

    A row without an id goes by a hash of its text, above all ids, so that it yields to a copy with an id.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))
    rows = docs.select(key.alias("_key"), F.struct(*docs.columns).alias("_row"))
    c = written(jaccard.joined(rows.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text")), n=5, percent=80), "groups").withColumnRenamed("doc_id", "_key")
    gone = written(c.where("_key <> component_id").select("_key").distinct(), "gone")
    out = rows.join(small(gone), "_key", "left_anti")
    several = written(c.where("_key = component_id and n_shingles > 0").groupBy("_key").count().where("count > 1").select("_key"), "several")
    if not several.isEmpty():
        one = out.join(small(several), "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", F.struct(F.col("_row.text").isNull(), "_row.text")).alias("_row"))
        out = out.join(small(several), "_key", "left_anti").unionByName(one)
    return out.select("_row.*")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark passage stay, each judged by its own text."""
    h = decontaminate.hits(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0)
    gone = written(h.select(F.col("doc_id").alias("_gone"), F.xxhash64("text").alias("_mark")).distinct(), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_gone")) & (F.xxhash64("_row.text") == F.col("_mark"))
    return rows.join(small(gone), same, "left_anti").select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

ORACLE_SQL = None  # a fitted chain, fuzzy lines and a tokenizer have no SQL; tests/llm/test_pipeline.py has the stages' tests


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
