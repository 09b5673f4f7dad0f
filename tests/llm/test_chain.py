"""The chain itself: exact pair marginals, tokens outside the lexicon, transitions, sampling, clashing names."""

import copy
import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import toxicity
from loomgraph.llm.words import ALNUM, Words


def test_pair_marginals_equal_enumeration():
    r = np.random.default_rng(2)
    step = r.normal(size=(2, 2))
    first = np.array([0, 4, 4, 5, 10])
    u = r.normal(size=10) * 2
    p, pairs = toxicity.pair_marginals(u, first, step)
    assert p == pytest.approx(toxicity.marginals(u, first, step))
    at = 0
    for lo, hi in itertools.pairwise(first):
        total, both = 0.0, np.zeros((max(0, hi - lo - 1), 2, 2))
        for y in itertools.product((0, 1), repeat=hi - lo):
            weight = np.exp(sum(u[lo + i] * v for i, v in enumerate(y)) + sum(step[a, b] for a, b in itertools.pairwise(y)))
            total += weight
            for i, (a, b) in enumerate(itertools.pairwise(y)):
                both[i, a, b] += weight
        assert pairs[at : at + len(both)] == pytest.approx(both / total)
        at += len(both)
    assert at == len(pairs)


def sample():
    r = random.Random(5)
    some = lambda n: [r.choice("abcdefghijkl") + str(r.randrange(60)) for _ in range(n)]
    out = []
    for _ in range(300):
        w = some(30)
        for k in (5, 15):  # always two in a row, between words that clean texts have too
            w[k : k + 4] = ["vile", f"scum{r.randrange(9)}", f"filth{r.randrange(9)}", "creature"]
        out.append((1, " ".join(w).encode()))
    for _ in range(600):
        w = some(30)
        w[4], w[9], w[20] = "vile", "creature", r.choice(["vile", "creature"])
        out.append((0, " ".join(w).encode()))
    return out


def tagged(m, text):
    w = Words([text], ALNUM)
    _, own, p = m.scores(w)
    return {w.symbols[w.start[t] : w.end[t]].tobytes().decode() for t, q in zip(own.tolist(), p.tolist(), strict=True) if q >= 0.5}


def test_tokens_outside_the_lexicon():
    m = toxicity.fit(sample())
    # neither word was seen: neighbours and the chain tell
    assert "zorg" in tagged(m, b"a1 b2 vile zorg filth3 creature c3")
    assert tagged(m, b"a1 vile b2 c3 creature d4 zorg e5") == set()
    without = copy.deepcopy(m)
    without.step[:] = 0
    w = Words([b"a1 b2 vile zorg filth3 creature c3"], ALNUM)
    assert m.scores(w)[2] != pytest.approx(without.scores(w)[2], abs=1e-3)


def test_fit_takes_labels_of_its_folds_only(spark):
    texts = [(i, t.decode(), y) for i, (y, t) in enumerate(sample())]
    d = spark.createDataFrame([x[:2] for x in texts] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in texts] + [(None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.fitted(d, labels, toxic=100)
    assert len(m.weights) and "scum1" in tagged(m, b"a1 scum1 b2")
    held = labels.where(toxicity.fold("doc_id", 3) == 1)
    assert not len(toxicity.fitted(d, held).weights)


def test_clashing_names_and_repeated_rows(spark):
    m = toxicity.fit(sample())
    d = spark.createDataFrame([(1, "vile scum1 filth2 creature", "x", 7), (1, "vile scum1 filth2 creature", "x", 7), (2, None, "y", 8)], "doc_id long, text string, score string, words int")
    rows = toxicity.scored(d.withColumn("c0", F.lit(3)), m, ["doc_id", "words", "c0", "score"]).collect()
    assert sorted((r["doc_id"], r["words"], r["c0"], r["score"] > 0.5) for r in rows) == [(1, 7, 3, True), (1, 7, 3, True), (2, 8, 3, False)]


def test_fit_holds_a_part_of_the_texts_at_a_time(monkeypatch):
    # the executors of the pipeline have little room left: not much more than the chain's own numbers for each token
    r = random.Random(6)
    clean = [f"w{i}" for i in range(3000)]
    docs = []
    for i in range(2400):
        w = [r.choice(clean) for _ in range(150)]
        if i % 3 == 0:
            w[20:24] = ["vile", f"scum{r.randrange(9)}", f"filth{r.randrange(9)}", "creature"]
        docs.append((int(i % 3 == 0), " ".join(w).encode()))
    whole = toxicity.fit(docs, rounds=3)
    monkeypatch.setattr(toxicity, "PART", 1 << 16, raising=False)
    monkeypatch.setattr(toxicity, "PAIRS", 1 << 12, raising=False)
    tracemalloc.start()
    parts = toxicity.fit(docs, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110 * 240_000, peak
    assert (whole.table.keys == parts.table.keys).all() and len(whole.weights)
    assert parts.weights == pytest.approx(whole.weights) and parts.step == pytest.approx(whole.step) and parts.curve == pytest.approx(whole.curve)
