"""The pipeline's stages on small tables: each against its rule, with nulls, repeated rows and clashing names."""

import random

import pytest
from pyspark.sql import functions as F
from test_jaccard import brute

import corpus_pipeline as cp

CLASH = "score string, spans int, _text string, removed_lines string, kept_in int, words string, c0 int, _key int, component_id int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def words(r, n):
    return " ".join(r.choice("bcdfghklmnp") + r.choice("aeiou") + str(r.randrange(500)) for _ in range(n))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "s", 1, "t", "r", 2, "w", 3, 4, 5) for i, t in docs], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    r = random.Random(1)
    item = words(r, 30)
    spark.createDataFrame([("i1", item), ("i2", words(r, 25)), (None, None)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    passage, copy = words(r, 60), words(r, 80)
    bad = [(i, f"{words(r, 20)} scum{i % 3} {words(r, 20)} scum{i % 2}") for i in range(60)]
    clean = [(i, words(r, 45)) for i in range(100, 220)]
    docs = bad + clean + [(300, f"{passage}\n{words(r, 30)}"), (301, f"{words(r, 30)}\n{passage}"), (302, passage)]
    docs += [(310, copy), (311, copy), (312, f"{copy} end"), (320, f"{words(r, 30)} {item} {words(r, 9)}"), (321, f"{words(r, 9)} {' '.join(item.split()[5:20])}")]
    docs += [(330, None), (331, ""), (332, " \n\t"), (None, None), (None, "a row without id " + words(r, 30)), (101, clean[1][1])]
    frame(spark, docs).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i, _ in clean] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_one_after_another(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, tables), name)
        if name != "packing":
            assert docs.columns == columns
            seen[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
            assert docs.where("score <> 's' or removed_lines <> 'r' or kept_in <> 2 or _key <> 4").isEmpty()
    kept = {k: {i for i, _ in v} for k, v in seen.items()}
    assert not kept["toxicity"] & set(range(60)) and kept["toxicity"] >= {*range(100, 220), 300, 331, 332, 330, None}
    text = dict(seen["line_dedup"])
    assert 302 not in text and len(text[301].split("\n")) == 1 and len(text[300].split("\n")) == 2
    # the lines' stage leaves one of the two equal texts; of 101's two rows, one has to go here
    assert kept["jaccard_join"] >= {310, 330, 331, 332, None, *range(100, 220)}
    assert [i for i, _ in seen["jaccard_join"]].count(101) == 1
    assert kept["decontamination"] == kept["jaccard_join"] - {320, 321}
    out = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in out) <= 2048 and {r[0] for r in docs.select("doc_id").distinct().collect()} == kept["decontamination"]


def test_near_duplicates_equal_brute_force(spark, tables):
    r = random.Random(3)
    texts = []
    for _ in range(12):
        base = words(r, 60).split()
        for _ in range(4):
            w = list(base)
            for k in r.sample(range(60), r.randrange(4)):
                w[k] = "z"
            texts.append(" ".join(w))
    got = {r["doc_id"] for r in cp.near_duplicates(spark, frame(spark, list(enumerate(texts))), tables).collect()}
    assert got == {c for _, _, c in brute(texts, 5, 80)}


def test_benchmark_free_judges_rows(spark, tables):
    item = spark.read.parquet(f"{tables}/benchmark.parquet").where("item_id = 'i1'").first()["text"]
    rows = [(1, f"x {item}"), (1, "clean one"), (None, f"{item} y"), (None, "clean two"), (None, None), (2, None)]
    got = cp.benchmark_free(spark, frame(spark, rows), tables).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(1, "clean one"), (None, "clean two"), (None, None), (2, None)], key=str)


def test_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, tables).count() == 0
