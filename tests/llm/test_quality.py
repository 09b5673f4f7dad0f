import re
from collections import Counter

import pytest

from loomgraph.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t ", "a b c d", "a b c d e", "one two three four five one two three four five", "x\n x\nx\nx \nx", "  \u0085 #$%&|<>*\n\n" * 3, "a " * 500, "A\x0bB\x0cC\rD\nE " * 9, "\n same\nsame\n same"]


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(wins)
    hit = {i + j for i, w in enumerate(wins) if many[w] > 1 for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_statistics_of_odd_texts(spark):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, votes int")
    rows = {r["doc_id"]: r for r in quality.judged(d).collect()}
    for i, t in enumerate(ODD):
        assert tuple(rows[i][c] for c in COLUMNS) == brute(t), t


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = quality.op5_quality(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_empty(spark):
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_em_finds_accuracies(spark):
    # 900 good and 100 bad documents; rule 2 votes at random on both
    rows = [([1, 1, 1 if i % 2 else -1],) for i in range(900)] + [([-1, -1 if i % 4 else 0, 1 if i % 2 else -1],) for i in range(100)]
    m = quality.fitted(spark.createDataFrame(rows, "votes array<int>"), 3).first()["m"]
    assert m["pi"] == pytest.approx(0.9, abs=0.03)
    assert m["a"][0] > 0.98 and m["b"][0] > 0.9


def test_kept_follows_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality.op5_quality(spark, "/root/testdata/sf0.01").collect() if labels.get(r["doc_id"]) is not None]
    good = [r["kept"] for r in rows if labels[r["doc_id"]] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    assert sum(good) > 0.98 * len(good)
    assert sum(bad) < 0.3 * len(bad)
