"""Long lists divided by centres: families of near copies around the threshold, against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from test_jaccard import brute, shingles

from loomgraph.llm import jaccard


def family(r, size, members, edits):
    """A text and copies of it with a few words replaced, dropped or doubled; some copies are copies of copies."""
    base = [f"b{r.randrange(10**9)}" for _ in range(size)]
    made = [base]
    for _ in range(members):
        w = list(r.choice(made) if r.random() < 0.3 else base)
        for _ in range(r.choice(edits)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], [r.choice("xyz")], [f"n{r.randrange(10**9)}"], [w[k], "x"]])
        made.append(w)
    r.shuffle(made)
    return [" ".join(w) for w in made]


def joined(spark, texts, n, percent):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    return sorted(tuple(x) for x in jaccard.joined(d, n, percent).collect())


@pytest.mark.parametrize(("seed", "n", "percent", "limit"), [(1, 4, 85, 3), (2, 5, 80, 8)])
def test_near_misses_equal_brute_force(spark, monkeypatch, seed, n, percent, limit):
    monkeypatch.setattr(jaccard, "LIST", limit)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)  # else pivots link nearly all before lists are divided
    r = random.Random(seed)
    two = family(r, 100, 1, [9])  # two texts that are far apart, each with copies
    texts = family(r, 150, 90, [0, 1, 2, 3, 4, 5]) + family(r, 80, 60, [1, 2, 3]) + family(r, 30, 40, [0, 1, 2]) + family(r, 9, 20, [0, 1])
    for t in two:
        w = t.split()
        texts += [" ".join([*w[:k], f"m{r.randrange(10**6)}", *w[k + 1 : j], f"m{r.randrange(10**6)}", *w[j + 1 :]]) for k, j in (sorted(r.sample(range(len(w)), 2)) for _ in range(25))]
    calls = []
    anew = jaccard._anew
    monkeypatch.setattr(jaccard, "_anew", lambda *a: calls.append(1) or anew(*a))
    assert joined(spark, texts, n, percent) == brute(texts, n, percent)
    assert calls


def test_near_misses_make_few_rows(spark, monkeypatch):
    # all pairs of a list of 400 are some 80,000; only those whose differences could be alike enough are met
    r = random.Random(7)
    base = [f"b{k}" for k in range(147)]
    texts = []
    for i in range(400):
        w = list(base)
        for k in r.sample(range(4, 143, 5), 3):
            w[k] = f"n{i}_{k}"
        texts.append(" ".join(w))
    met = []
    across = jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda *a: met.append(across(*a)) or met[-1])
    assert joined(spark, texts, 4, 85) == brute(texts, 4, 85)
    assert met[0].count() < 100


def test_signatures_bound_differences(spark):
    r = random.Random(9)
    texts = family(r, 150, 8, [1, 3, 9]) + family(r, 400, 3, [30]) + ["", "one"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signs = {x[0]: x[1:] for x in jaccard.signatures(d.select("doc_id"), d, jaccard.Rule(4, 85)).collect()}
    sets = [shingles(t, 4) for t in texts]
    exact = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            bits = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(signs[i], signs[j], strict=True))
            assert bits <= len(x ^ y)
            exact += bits > 0.8 * len(x ^ y)
    assert exact > 20


def test_ids_of_several_sets(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, f"{b} z"), (3, a.upper()), (4, c), (5, f"{c} z"), (5, f"{c} z"), (6, "w")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.joined(d, 4, 85).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}


def test_difference_bound_holds():
    for n, percent in ((4, 85), (5, 80)):
        rule = jaccard.Rule(n, percent)
        for a in range(1, 60):
            for b in range(rule.least(a), rule.most(a) + 1):
                assert a + b - 2 * rule.overlap(a, b) <= (100 - percent) * (a + b) // (100 + percent)


def test_extra_columns_and_other_names(spark):
    d = spark.createDataFrame([(1, "a b c d e", 5, "t"), (2, "a b c d e", 6, "t")], "id long, body string, root long, token string")
    assert sorted(tuple(r) for r in jaccard.joined(d.withColumn("doc_id", F.lit("x")), key="id", text="body").collect()) == [(1, 1, 1), (2, 1, 1)]
