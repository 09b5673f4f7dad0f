import random
import re

import pytest

from loomgraph.llm import jaccard
from loomgraph.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near(r, words, edits):
    w = list(words)
    for _ in range(edits):
        k = r.randrange(len(w))
        w[k : k + 1] = r.choice([[], [f"n{r.randrange(10**6)}"], [w[k], "x"]])
    return w


def corpus(seed):
    r = random.Random(seed)
    texts = ["", None, "one", "One", "a b c", "a b c d", " \n"]
    passage = [f"p{i}" for i in range(40)]
    for size in [*range(4, 34), 60, 60, 200]:
        base = [r.choice("abcdefghij") + str(r.randrange(8)) for _ in range(size)]
        now = base
        for _ in range(r.randrange(1, 7)):
            now = near(r, now if r.random() < 0.5 else base, r.randrange(3)) or ["z"]  # copies of copies make chains
            texts.append(" ".join(now))
        texts.append(" ".join([*passage, *base]))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 50)])
def test_equals_brute_force(spark, monkeypatch, seed, n, percent):
    monkeypatch.setattr(jaccard, "COUNTERS", 1 << 12)
    monkeypatch.setattr(jaccard, "ROW", 1 << 10)
    texts = corpus(seed)
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, token string")
    if percent == 50:  # subsets at half overlap are many: all sets are heavy
        monkeypatch.setattr(jaccard, "LIGHTEST", 0)
    got = sorted(tuple(r) for r in jaccard.joined(d.repartition(6), n, percent).collect())
    assert got == brute(texts, n, percent)


@pytest.mark.parametrize("light", [0, 7, 16])
def test_any_boundary_gives_the_same(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard, "boundary", lambda *_: light)
    texts = [t for t in corpus(5) if len((t or "").split()) < 30]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.joined(d, 4, 85).collect()) == brute(texts, 4, 85)


def test_boundary_by_cost():
    rule = jaccard.Rule(4, 85)
    assert jaccard.boundary(rule, dict.fromkeys(range(1, 41), 100), 0.0) < jaccard.boundary(rule, dict.fromkeys(range(1, 41), 100), 50.0)
    assert rule.overlaps(6) == [6] and rule.subsets(7) == 8


def test_null_ids_and_repeated_rows(spark):
    d = spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (5, "A b c d e"), (4, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.joined(d).collect()), key=str)
    assert got == sorted([(3, 1, 3), (3, 1, 3), (None, 1, None), (5, 1, 3), (4, 0, 4)], key=str)
    assert jaccard.joined(d.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(60).selectExpr("id * 7 % 61 as a", "(id + 1) * 7 % 61 as b")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert len(roots) == 61 and set(roots.values()) == {0}
