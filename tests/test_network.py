"""The network over blocks against that of MLlib, and its gradient against differences."""

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from millrace.operators import network


def test_gradient():
    rng = np.random.default_rng(1)
    layers = [3, 4, 5, 2]
    w = rng.normal(size=sum(a * b + b for a, b in zip(layers, layers[1:])))
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 2, 7)
    _, grad = network._block_loss(x, y, w, layers)
    for k in range(len(w)):
        e = np.zeros(len(w))
        e[k] = 1e-6
        near = (network._block_loss(x, y, w + e, layers)[0] - network._block_loss(x, y, w - e, layers)[0]) / 2e-6
        assert abs(near - grad[k]) < 1e-5


def test_as_mllib(spark, monkeypatch):
    """After a few rounds the weights are MLlib's, when its blocks have equal numbers of rows."""
    monkeypatch.setattr(network, "BLOCK", 5)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(64, 4))
    df = spark.createDataFrame([(Vectors.dense(r), float(r[0] * r[1] > 0)) for r in x], ["f", "label"])
    df = df.coalesce(1).cache()
    layers = [4, 6, 5, 2]
    for rounds in (1, 8):
        theirs = MultilayerPerceptronClassifier(featuresCol="f", layers=layers, maxIter=rounds, seed=42, blockSize=64).fit(df)
        ours = network.fit(df, "f", "label", layers, rounds)
        assert np.allclose(ours.weights.toArray(), theirs.weights.toArray(), rtol=1e-4, atol=1e-5)
        a, b = (m.transform(df).select("probability").collect() for m in (ours, theirs))
        assert np.allclose([r[0].toArray() for r in a], [r[0].toArray() for r in b], atol=1e-4)
