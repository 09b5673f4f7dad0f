"""Bounded edit distance against the full table; parts of hot keys."""

import random

from pyspark.sql import functions as F
from test_lines import distance

from loomgraph.llm import lines
from loomgraph.llm.common import dealt, fits, written
from loomgraph.llm.lines import distances, within


def test_within_equals_the_table():
    r = random.Random(4)
    for _ in range(1500):
        a = "".join(r.choice("abé ") for _ in range(r.randrange(0, 90)))
        b = list(a)
        for _ in range(r.randrange(0, 30)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = r.choice(["", "x", "a"])
        b = "".join(b) if r.random() < 0.9 else "".join(r.choice("abé ") for _ in range(40))
        n = distance(a, b)
        for most in {0, n - 1, n, n + 1, 10} - {-1}:
            assert within(a, b, most) == within(b, a, most) == (n <= most), (a, b, most)


def test_within_of_long_lines():
    a = "".join(random.Random(5).choice("abcdefgh ") for _ in range(30_000))
    assert within(a, f"x{a[1:15_000]}yy{a[15_003:]}", 4) and not within(a, f"x{a[1:15_000]}yy{a[15_003:]}", 3)


def test_hot_keys_are_dealt_out(spark):
    left = written(spark.range(2500).select(F.col("id").alias("a"), F.when(F.col("id") < 2400, 1).otherwise(F.col("id")).alias("b")), "left")
    right = left.select("b").distinct().withColumn("text", F.concat(F.lit("t"), "b"))
    out = dealt(left, right, left, "b", most=100)
    assert sorted(out.columns) == ["a", "b", "text"]
    assert out.count() == 2500 and out.where(F.col("text") != F.concat(F.lit("t"), "b")).isEmpty()


def test_sizes_are_measured(spark):
    wide = written(spark.range(70).select("id", F.repeat(F.lit("x"), 1_000_000).alias("t"), F.array("id").alias("l"), F.array(F.struct("id")).alias("s")), "wide")
    assert not fits(wide) and fits(wide.drop("t")) and fits(wide.limit(0))


def test_distances_within_a_band_are_those_of_the_table():
    r, a, b, most, want = random.Random(6), [], [], [], []
    for _ in range(800):
        x = [r.choice(["abcdé ", "ab"][len(a) % 2]) for _ in range(r.choice([1, 5, 40, 70, 140]))]
        y = list(x)
        for _ in range(r.randrange(len(x) // 2 + 1)):
            k = r.randrange(len(y) + 1)
            y[k : k + r.randrange(2)] = r.choice(["", "x", "a", "zz"])
        a.append("".join(x))
        b.append("".join(y))
        want.append(distance(a[-1], b[-1]))
        most.append(r.choice([0, want[-1], max(0, want[-1] - 1), max(len(a[-1]), len(b[-1])) // 5, 200]))
    got = distances(a, b, most)
    assert all(g == w if w <= m else g > m for g, w, m in zip(got.tolist(), want, most, strict=True))


def test_a_batch_of_many_letters_is_halved(monkeypatch):
    # masks grow with letters times pairs
    monkeypatch.setattr(lines, "TOGETHER", 1 << 10)
    texts = [chr(0x4E00 + 7 * i) + "".join(chr(0x4E00 + i * k % 5000) for k in range(30)) for i in range(1, 60)]
    assert distances(texts, [t[:9] + "x" + t[10:-1] + "yz" for t in texts], [6] * len(texts)).tolist() == [3] * len(texts)
