"""What op9 must not leave out: short lines, scripts without spaces, near copies by edit similarity alone."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_lines import distance

import corpus_pipeline
from loomgraph.llm import lines


def removed(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r["doc_id"], n) for r in lines.duplicates(df, **more).collect() for n in r["removed"]}


def test_short_exact_copies_go_by_default(spark):
    five, seven = "Released under the MIT License.", "one two three four five six seven"
    assert removed(spark, [(1, f"{five}\nown"), (2, f"{five}\n{seven}"), (3, seven)]) == {(2, 0), (3, 0)}


def test_scripts_without_spaces_count_characters(spark):
    han, thai = "版权所有未经许可不得转载", "สงวนลิขสิทธิ์ทั้งหมด"
    assert removed(spark, [(1, f"{han}\n{thai}\n版权"), (2, f"{thai}\n{han}\n版权")]) == {(2, 0), (2, 1)}


def test_pieces():
    w = lines.Lines(["ab 版权c所é ไม 𠀀x".encode()], 1).words
    start, end = lines._pieces(w)
    assert [w.symbols[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == ["ab", "版", "权", "c", "所", "é", *"ไม", "𠀀", "x"]


def replaced(r, words, vocabulary, share):
    out = list(words)
    for i in r.sample(range(len(out)), max(1, int(len(out) * share))):
        out[i] = r.choice(vocabulary)
    return out


def test_recall_of_one_word_in_eight():
    # against edit similarity alone, whether or not values agree
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(2000)]
    for size in (5, 8, 12, 20, 30, 50):
        made = [[r.choice(vocabulary) for _ in range(size)] for _ in range(150)]
        both = [(" ".join(a), " ".join(replaced(r, a, vocabulary, 1 / 8))) for a in made]
        both = [(a, b) for a, b in both if distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)]
        met = 0
        for a, b in both:
            values, n = lines.Lines([a.encode(), b.encode()], 5).pairs()
            met += bool(set(values[: n[0]].tolist()) & set(values[n[0] :].tolist()))
        assert len(both) > 60 and met >= (1 if size <= lines.SHORT else 0.95) * len(both), (size, met, len(both))


def test_near_copies_go(spark):
    text = "every one of these words stands in both of the lines but for a single one".split()
    docs = [(i, " ".join([*text[:i], f"w{'xyz'[i % 3]}", *text[i + 1 :]])) for i in range(1, len(text))]
    han = [(50, "版权所有未经许可不得转载本站内容"), (51, "版权所有未经许可不得转载本站文容")]
    assert removed(spark, docs + han, near="pairs") == {(i, 0) for i, _ in docs[1:]} | {(51, 0)}


def test_production_takes_pairs(spark, tmp_path):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon omega eta theta"
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_removed"] for r in lines.op9_lines(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}
    docs = df.withColumn("n_chars", F.char_length("text").cast("long"))
    assert [r["doc_id"] for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()] == [1]


def test_size_is_that_of_the_text():
    x = lines.Lines(["a Bé, 版权 𠀀\n\nx--y 12 z ü".encode(), b"one two three"], 1)
    assert x.size().tolist() == [len(x.text(i)) for i in range(3)]


def words_of(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n)]


def meeting(texts):
    values, n = lines.Lines([t.encode() for t in texts], 5).pairs()
    ends = np.cumsum(n)
    return [set(values[b - k : b].tolist()) for b, k in zip(ends, n, strict=True)]


def test_a_shared_passage_alone_does_not_meet():
    # else candidates grow with the square of the lines that hold a passage
    r = random.Random(4)
    passage = words_of(r, 12)
    sets = meeting([" ".join(passage + words_of(r, 30)) for _ in range(60)])
    assert sum(bool(a & b) for i, a in enumerate(sets) for b in sets[:i]) <= 5


def test_recall_of_letter_errors():
    r = random.Random(5)
    some = [" ".join(words_of(r, r.randrange(13, 60))) for _ in range(600)]
    met = {}
    for share in (0.03, 0.08):
        both = [(a, "".join(r.choice("abcdefghijklmnop") if c != " " and r.random() < share else c for c in a)) for a in some]
        a, b = meeting([x for x, _ in both]), meeting([y for _, y in both])
        met[share] = sum(bool(x & y) for x, y in zip(a, b, strict=True)) / len(both)
    assert met[0.03] > 0.9 and met[0.08] > 0.5, met
