"""Likeness of items in blocks against plain Python."""

import random
from collections import defaultdict
from itertools import combinations

from millrace.operators import collaborative


def test_item_adjusted_cosine(spark, monkeypatch):
    """Pairs by many tasks, each of some items; no pair of a basket is shuffled."""
    monkeypatch.setattr(collaborative, "PAIRS_A_TASK", 60)
    monkeypatch.setattr(collaborative, "USERS_A_ROW", 3)
    rng = random.Random(4)
    r = {(u, i): float(rng.randrange(1, 11)) for u in range(30) for i in rng.sample(range(-6, 6), rng.randrange(1, 7))}
    users = defaultdict(dict)
    for (u, i), x in r.items():
        users[u][i] = x
    sums = defaultdict(lambda: [0, 0.0, 0.0, 0.0])
    for own in users.values():
        m = sum(own.values()) / len(own)
        for a, b in combinations(sorted(own), 2):
            x, y = own[a] - m, own[b] - m
            sums[a, b] = [p + q for p, q in zip(sums[a, b], (1, x * y, x * x, y * y), strict=True)]
    expected = {(a, b, n, round(ab / (aa * bb) ** 0.5 if aa > 1e-12 and bb > 1e-12 else 0.0, 6)) for (a, b), (n, ab, aa, bb) in sums.items() if n >= 3}
    got = collaborative.item_adjusted_cosine(spark.createDataFrame([(u, i, x) for (u, i), x in r.items()], "u long, i long, r double"))
    assert {(x["a"], x["b"], x["n"], round(x["sim"], 6)) for x in got.collect()} == expected and expected
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
