"""The words that the training marks, against all beginnings counted at once."""

import math
import random
from collections import Counter

from ledgerloom.llm import toxicity


def marks_by_brute_force(toxic, ordinary):
    starts = lambda ws: {w[:k] for w in ws for k in range(5, len(w) + 1)}
    there = Counter(x for ws in toxic for x in starts(ws))
    other = Counter(x for ws in ordinary for x in starts(ws))
    least = max(3, 0.02 * len(toxic))
    far = {x for x, n in there.items() if n >= least and math.log(n / len(toxic)) - math.log((other[x] + 0.5) / len(ordinary)) > 3}
    return {w for ws in toxic for w in ws if starts([w]) & far}


def test_marks_against_brute_force():
    rng = random.Random(3)
    plain = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode() for _ in range(300)]
    bad = [b"xyzzyx" + w[:3] for w in plain[:20]] + [b"abcabcabc"]
    for n in (4, 60, 200):
        ordinary = [[rng.choice(plain) for _ in range(rng.randint(0, 20))] for _ in range(3 * n)]
        toxic = [[rng.choice(plain) for _ in range(10)] + [rng.choice(bad) for _ in range(rng.randint(0, 3))] for _ in range(n)]
        assert toxicity._marks(toxic, ordinary) == marks_by_brute_force(toxic, ordinary)
    assert toxicity._marks(toxic, ordinary)
    assert toxicity._marks([[], []], [[]]) == set()
