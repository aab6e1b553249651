"""What the singular vectors of many rows hold and multiply."""

import tracemalloc

import numpy as np
from pyspark.ml.linalg import Vectors

from millrace.operators import axes


def test_basis_lies_in_a_file():
    values = 0.9 ** np.arange(20_000)
    tracemalloc.start()
    try:
        found, v = axes.largest(lambda q: values[:, None] * q, 20_000, 256)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.allclose(found[:50], values[:50]) and np.allclose(np.abs(v[range(50), range(50)]), 1)
    assert most < 20_000 * 400 * 8  # the least basis


def test_alike_in_a_group_stands_once(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(20, 40)) * (rng.random((20, 40)) < 0.5), 4, axis=0)
    x[:, 30:] = rng.normal(size=(80, 10)) * (rng.random((80, 10)) < 0.5)
    x[7, :], x[12, 3] = 0, 5
    rows = [(Vectors.sparse(40, {int(k): float(r[k]) for k in np.flatnonzero(r)}) if i % 9 else Vectors.dense(r), str(i // 4)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ["_x", "id"]).coalesce(1)
    pieces = df.mapInArrow(axes._pack, "n binary, live binary, at binary, w binary, by binary, of binary").collect()
    assert sum(len(p["w"]) // 8 for p in pieces) < 0.6 * np.count_nonzero(x)
    q = rng.normal(size=(40, 3))
    with axes.exchange(spark) as folder:
        (got,) = axes._products(map(tuple, pieces), axes.put(folder, q), 40, 3)
    assert np.allclose(got, x.T @ (x @ q))
