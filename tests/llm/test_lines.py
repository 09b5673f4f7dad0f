import random
import re

import numpy as np
import pytest

from loomgraph.llm import lines

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def norm(line):
    return WORD.findall(line.encode().lower().translate(lines._DIGITS))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, least, similarity):
    """Groups by the definition: equal block and edit similarity, closed under links; first occurrence stays."""
    occur = {}
    for d, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            w = norm(line)
            if d is not None and len(w) >= least:
                occur.setdefault(b" ".join(w), []).append((d, n))
    keys = list(occur)
    blocks = [lines.Lines([k], least).simhash()[0] for k in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for j in range(i):
            x, y = a.decode(), keys[j].decode()
            if (blocks[i] == blocks[j]).any() and distance(x, y) <= int((1 - similarity + 1e-9) * max(len(x), len(y))):
                root[find(i)] = find(j)
    firsts = {}
    for i, k in enumerate(keys):
        firsts[find(i)] = min(firsts.get(find(i), (1 << 60, 0)), min(occur[k]))
    return {(d, n) for i, k in enumerate(keys) for d, n in occur[k] if (d, n) != firsts[find(i)]}


def corpus(seed):
    r = random.Random(seed)
    base = [[f"{r.choice('abcdefgh')}{r.randrange(50)}é" for _ in range(n)] for n in (3, 5, 8, 30, 60, 60, 120, 400)]
    docs = [(0, None), (1, ""), (2, "\n\n"), (None, " ".join(base[3])), (3, "a b c\na b c")]
    for d in range(4, 40):
        own = []
        for _ in range(r.randrange(1, 6)):
            w = list(r.choice(base))
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = f"x{r.choice('abc')}"
            own.append(r.choice([" ".join(w), " ".join(w).upper() + "!", "- " + ", ".join(w)]))
        docs.append((d, "\n".join([*own, "", "own words of document " + "xyzuvw"[d % 6] * d])))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, key string").repartition(4)
    gone = {(r["doc_id"], n) for r in lines.duplicates(df, 5).collect() for n in r["removed"]}
    assert gone == brute(docs, 5, 0.8) and len(gone) > 20
    out = {r["doc_id"]: r["text"] for r in lines.deduplicated(df, 5).collect()}
    for d, text in docs:
        want = text if text is None or d is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (d, n) not in gone)
        assert out[d] == want


def test_simhash_is_the_majority():
    text = b" ".join(b"w%d" % (i % 300) for i in range(700)) + b"\nfive more words of these\nshort one"
    x = lines.Lines([b"", text], 5)
    assert x.number.tolist() == [0, 1] and x.doc.tolist() == [1, 1]
    for i in range(2):
        h = np.unique(x.words.hash[x.first[i] : x.end[i]])
        bits = np.concatenate([np.unpackbits(lines.mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1) for k in range(lines.BLOCKS // 2)], axis=1)
        assert (np.packbits(2 * bits.sum(axis=0) > len(h)).view("<i4") == x.simhash()[i]).all()


def test_pigeonhole_guarantee():
    # fewer differing bits than blocks leave a block alike
    r = np.random.default_rng(0)
    for _ in range(200):
        bits = r.integers(0, 2, 32 * lines.BLOCKS)
        other = bits.copy()
        other[r.choice(len(bits), lines.BLOCKS - 1, replace=False)] ^= 1
        assert (bits.reshape(lines.BLOCKS, 32) == other.reshape(lines.BLOCKS, 32)).all(axis=1).any()


def test_empty(spark):
    assert lines.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
