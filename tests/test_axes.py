"""Singular vectors of many blocks against those of numpy."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from millrace.operators import axes


@pytest.mark.parametrize("narrow", [10, 1024])
def test_right_vectors(spark, monkeypatch, narrow):
    for name, value in (("PIECE", 7), ("AT_ONCE", 4), ("NARROW", narrow)):
        monkeypatch.setattr(axes, name, value)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 60)) * (rng.random((90, 60)) < 0.2)
    x[5] = 0
    df = spark.createDataFrame([(Vectors.sparse(60, {int(k): float(r[k]) for k in np.flatnonzero(r)}),) for r in x], ["_x"])
    got, right = axes.right_vectors(df.repartition(3), 6, 60), np.linalg.svd(x)[2][:6].T
    assert got.shape == (60, 6)
    assert np.allclose(np.abs(np.sum(got * right, axis=0)), 1, atol=1e-8)
    m = axes.jvm_matrix(spark.sparkContext, got)
    assert (m.numRows(), m.numCols(), m.apply(7, 2)) == (60, 6, got[7, 2])
