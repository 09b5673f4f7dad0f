import itertools
import zlib

import numpy as np
import pytest

from loomgraph.llm import language, toxicity
from loomgraph.llm.words import ALNUM, Words

SF = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    step = r.normal(size=(2, 2))
    sizes = [5, 0, 1, 7, 3]
    first = np.concatenate([[0], np.cumsum(sizes)])
    u = r.normal(size=first[-1]) * 2
    got = toxicity.marginals(u, first, step)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi == lo:
            continue
        total, on = 0.0, np.zeros(hi - lo)
        for y in itertools.product((0, 1), repeat=hi - lo):
            weight = np.exp(sum(u[lo + i] * v for i, v in enumerate(y)) + sum(step[a, b] for a, b in itertools.pairwise(y)))
            total += weight
            on += weight * np.array(y)
        assert got[lo:hi] == pytest.approx(on / total)


def test_spans_are_code_points(spark):
    m = toxicity.fit([(1, f"ça é scum{i} word{i} x".encode()) for i in range(40)] + [(0, f"ça é nice{i} word{i} x".encode()) for i in range(80)])
    text = "É\n(scumbag) été, SCUM9!"
    d = spark.createDataFrame([(1, text, "s"), (2, None, "s"), (3, "", "s"), (None, "nice1", "s")], "doc_id long, text string, score string")
    rows = {r["doc_id"]: r for r in toxicity.scored(d, m, ["doc_id"]).collect()}
    assert [text[s["start"] : s["end"]] for s in rows[1]["spans"]] == ["scumbag", "SCUM9"]
    assert rows[1]["score"] > 0.7 > rows[2]["score"] and rows[2]["spans"] == rows[3]["spans"] == [] and len(rows) == 4
    assert toxicity.scored(d.limit(0), m, ["doc_id"]).count() == 0
    assert all(r["score"] < 1e-9 for r in toxicity.scored(d, toxicity.fit([]), ["doc_id"]).collect())


def test_scores_do_not_depend_on_the_group():
    m = toxicity.fit([(1, f"a scum{i}".encode()) for i in range(40)] + [(0, f"b nice{i}".encode()) for i in range(80)])
    texts = [b"x scum1 y", b"a b c d", b"", b"scum2", b"q " * 500]
    together = m.scores(Words(texts, ALNUM))[0]
    assert together.tolist() == pytest.approx([m.scores(Words([t], ALNUM))[0][0] for t in texts])


def test_held_out_toxicity(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in toxicity.op1_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    hit = [(labels[r["doc_id"]], r["predicted"]) for r in rows]
    recall = sum(p for y, p in hit if y) / sum(y for y, _ in hit)
    precision = sum(y for y, p in hit if p) / max(1, sum(p for _, p in hit))
    assert recall > 0.85 and precision > 0.93


def test_held_out_language(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in language.op3_language(spark, SF).collect() if r["held_out"]]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in rows) > 0.995 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_backoff_and_und(spark):
    m = language.fit([("aa", b"bababa bababa kokoko kokoko"), ("zz", b"xyxyxy xyxyxy qvqvqv qvqvqv")])
    d = spark.createDataFrame([(1, "Bababa"), (2, "babaxx baba babako"), (3, "xyx yxyq"), (4, "123 !?"), (5, None), (6, ""), (None, "qvqvqv")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in language.identified(d, m).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 3, 4, 5, 6, None)] == ["aa", "aa", "zz", "und", "und", "und", "zz"]
    assert rows[4]["score"] == 0
    assert {r["lang_pred"] for r in language.identified(d, language.fit([])).collect()} == {"und"}
