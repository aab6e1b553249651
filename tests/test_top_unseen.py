"""Recommendations in blocks against plain Python."""

import random
from collections import defaultdict

import pytest

from millrace.operators import recommend


@pytest.mark.parametrize("basis", [1000, 0])
def test_top_unseen(spark, monkeypatch, basis):
    """Items read as the basis of the scores, or terms; many block pairs; items that are equal."""
    for name, value in (("BASIS", basis), ("PERSONS", 4), ("ITEMS", 15), ("AT_ONCE", 2)):
        monkeypatch.setattr(recommend, name, value)
    rng = random.Random(3)
    items = {c: {t: rng.random() for t in rng.sample(range(8), 3)} for c in range(40)}
    items |= {c + 40: items[c] for c in range(40)}
    reads = [(p, c, rng.choice([1.0, 2.0, 5.0])) for p in range(9) for c in [*rng.sample(range(80), 4), 99]]  # 99 has no terms
    train = spark.createDataFrame(reads, "person_id long, content_id long, strength double")
    vectors = spark.createDataFrame([(c, list(v), list(v.values())) for c, v in items.items()], "content_id long, at array<int>, w array<double>")
    expected = set()
    for p in range(9):
        profile = defaultdict(float)
        for _, c, s in (r for r in reads if r[0] == p):
            for t, w in items.get(c, {}).items():
                profile[t] += s * w
        norm = sum(w * w for w in profile.values()) ** 0.5
        seen = {c for q, c, _ in reads if q == p}
        scores = sorted((-round(sum(profile[t] * w for t, w in v.items()) / norm, 9), c) for c, v in items.items() if c not in seen)
        expected |= {(p, c, k + 1) for k, (s, c) in enumerate(scores[:3]) if s < 0}
    got = recommend.top_unseen(train, vectors, 8, n=3)
    assert {(r["person_id"], r["content_id"], r["rank"]) for r in got.collect()} == expected
