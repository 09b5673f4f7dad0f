"""Edit distances of many pairs at a time against one at a time."""

import random

import numpy as np

from loomgraph.llm.lines import LANES, all_within, within


def test_all_within_equals_within():
    r = random.Random(5)
    a, b, most = [], [], []
    for _ in range(1500):
        letters = r.choice(["ab", "abcdefgh ", "aé漢😀字 xyz"])
        x = [r.choice(letters) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 128, 130, 300, LANES, LANES + 1]))]
        y = list(x)
        for _ in range(r.randint(0, len(x) // 3)):
            k = r.randrange(len(y) + 1)
            y[k : k + r.randrange(2)] = r.choice(["", r.choice(letters)])
        if r.random() < 0.2:
            y = [r.choice(letters) for _ in range(r.randrange(600))]
        a.append("".join(x))
        b.append("".join(y))
        most.append(len(y) // 5 if r.random() < 0.7 else r.randrange(80))
    want = np.array([within(*t) for t in zip(a, b, most, strict=True)])
    assert 100 < want.sum() < 1400 and (all_within(a, b, most) == want).all()
    assert len(all_within([], [], [])) == 0 and all_within(["", ""], ["", "ab"], [0, 1]).tolist() == [True, False]
