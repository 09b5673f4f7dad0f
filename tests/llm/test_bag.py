"""The bound before the edit distances never rules out a pair that is near enough."""

import random

from loomgraph.llm.lines import possible, within


def test_bound_keeps_all_near_pairs():
    r = random.Random(5)
    letters = "abcdefg héß漢𝒳"
    a, b, most = [], [], []
    for _ in range(3000):
        x = "".join(r.choice(letters) for _ in range(r.randrange(0, 60)))
        y = list(x)
        for _ in range(r.randrange(0, 12)):
            at = r.randrange(0, len(y) + 1)
            y[at : at + r.randrange(0, 2)] = r.choice(["", r.choice(letters)])
        a.append(x)
        b.append("".join(y) if r.random() < 0.8 else "".join(r.choice(letters) for _ in range(len(x))))
        most.append(max(len(a[-1]), len(b[-1])) // 5)
    may = possible(a, b, most)
    near = [within(x, y, m) for x, y, m in zip(a, b, most, strict=True)]
    assert not any(n and not k for n, k in zip(near, may, strict=True))
    assert sum(near) > 300 and (~may).sum() > 300


def test_bound_of_empty_and_single_texts():
    assert possible([], [], []).tolist() == []
    assert possible(["", "a", "ab"], ["", "b", "cd"], [0, 1, 0]).tolist() == [True, True, False]
