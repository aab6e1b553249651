"""Networks of sigmoid layers under a softmax, learnt by L-BFGS over blocks of rows; the models are those of MLlib."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.common import _java2py, _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block and of a task, and tasks whose sums go to the driver straight.
BLOCK, TASK, STRAIGHT = 2048, 50_000, 32

#: Corrections that L-BFGS keeps, its tolerance and the last values that are compared, as in MLlib.
CORRECTIONS, TOLERANCE, VALUES = 10, 1e-6, 20


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows as bytes."""
    for b in batches:
        for k in range(0, b.num_rows, BLOCK):
            part = b.slice(k, BLOCK)
            x = pc.list_flatten(part.column(0)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([part.column(1).to_numpy(zero_copy_only=False).astype("int64").tobytes()], pa.binary())], names=["x", "y"])


def _parts(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of each layer's matrix and bias, in the order of MLlib."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:], strict=False):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _block_loss(x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: list[int]) -> tuple[float, np.ndarray]:
    """Summed cross entropy of the rows and its gradient."""
    parts, seen = _parts(weights, layers), [x]
    for m, b in parts[:-1]:
        z = seen[-1] @ m
        z += b
        np.negative(z, out=z)
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z += 1
        seen.append(np.reciprocal(z, out=z))
    z = seen[-1] @ parts[-1][0] + parts[-1][1]
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    total, rows = e.sum(axis=1), np.arange(len(y))
    loss = float((np.log(total) - z[rows, y]).sum())
    d = e / total[:, None]
    d[rows, y] -= 1
    grad = np.empty_like(weights)
    own = _parts(grad, layers)
    for k in range(len(parts) - 1, -1, -1):
        np.matmul(seen[k].T, d, out=own[k][0])
        own[k][1][:] = d.sum(axis=0)
        if k:
            d = d @ parts[k][0].T
            d *= seen[k] * (1 - seen[k])
    return loss, grad


def _task_loss(blocks: Iterable, weights, layers: list[int]) -> Iterator[tuple[float, np.ndarray]]:
    loss, grad = 0.0, np.zeros(len(weights.value))
    for x, y in blocks:
        y = np.frombuffer(y, dtype="int64")
        part = _block_loss(np.frombuffer(x).reshape(len(y), layers[0]), y, weights.value, layers)
        loss, grad = loss + part[0], grad + part[1]
    yield loss, grad


def _between(left: tuple, right: tuple) -> float:
    """Least point of the cubic through values and slopes of two steps, a tenth of the way off either."""
    d1 = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0])
    d2 = math.sqrt(max(d1 * d1 - left[2] * right[2], 0.0))
    under = right[2] - left[2] + 2 * d2
    step = right[0] - (right[0] - left[0]) * (right[2] + d2 - d1) / under if under else (left[0] + right[0]) / 2
    low, high = min(left[0], right[0]), max(left[0], right[0])
    return min(max(step, low + 0.1 * (high - low)), high - 0.1 * (high - low))


def _step(at: Callable[[float], tuple], first: float) -> tuple | None:
    """A step that meets the strong Wolfe conditions, as (step, value, slope, ...); None where none is found."""
    start = at(0.0)
    if start[2] > 0:
        return None

    def zoom(low: tuple, high: tuple) -> tuple | None:
        for _ in range(10):
            c = at(_between(low, high))
            if c[1] > start[1] + 1e-4 * c[0] * start[2] or c[1] >= low[1]:
                high = c
            elif abs(c[2]) <= 0.9 * abs(start[2]):
                return c
            else:
                low, high = c, low if c[2] * (high[0] - low[0]) >= 0 else high
        return None

    low, t = start, first
    for k in range(10):
        c = at(t)
        if not math.isfinite(c[1]):
            t /= 2
        elif c[1] > start[1] + 1e-4 * t * start[2] or (c[1] >= low[1] and k):
            return zoom(low, c)
        elif abs(c[2]) <= 0.9 * abs(start[2]):
            return c
        elif c[2] >= 0:
            return zoom(c, low)
        else:
            low, t = c, t * 1.5
    return None


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int) -> np.ndarray:
    """L-BFGS with the line search and the ends of MLlib's."""
    value, grad = f(w)
    begun, last, pairs, failed = value, [math.inf], [], False
    for done in range(rounds):
        if np.linalg.norm(grad) <= max(TOLERANCE * abs(value), 1e-8):
            break
        way, kept = -grad, []
        for s, y, r in reversed(pairs):
            a = r * (s @ way)
            kept.append(a)
            way = way - a * y
        if pairs:
            way = way * (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y, r), a in zip(pairs, reversed(kept), strict=True):
            way = way + (a - r * (y @ way)) * s

        def along(t: float, way=way, value=value, grad=grad) -> tuple:
            v, g = f(w + t * way) if t else (value, grad)
            return t, v, float(g @ way), g

        found = _step(along, 1.0 if done else 1 / np.linalg.norm(way))
        if found is None:
            if failed or not pairs:
                break
            failed, pairs = True, []
            continue
        s, y = found[0] * way, found[3] - grad
        if s @ y > 0:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-CORRECTIONS:]
        w, value, grad, failed = w + s, found[1], found[3], False
        last = [*last, value][-VALUES:]
        if abs(value - max(last)) <= TOLERANCE * begun:
            break
    return w


def fit(df: DataFrame, features: str, label: str, layers: list[int], rounds: int, seed: int = 42) -> MultilayerPerceptronClassificationModel:
    """The network of MLlib from its own first weights; a sum a task and round reaches the driver, the weights go back."""
    context = df.sparkSession.sparkContext
    n = df.count()
    tasks = max(context.defaultParallelism, math.ceil(n / TASK))
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y")).repartition(tasks)
    blocks = rows.mapInArrow(_pack, "x binary, y binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = context._gateway.new_array(context._jvm.int, len(layers))
    for k, size in enumerate(layers):
        sizes[k] = size
    first = _java2py(context, context._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(sizes, True).model(seed).weights()).toArray()

    def mean_loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(w)
        sums = blocks.mapPartitions(partial(_task_loss, weights=sent, layers=layers))
        add = lambda a, b: (a[0] + b[0], a[1] + b[1])
        loss, grad = sums.reduce(add) if tasks <= STRAIGHT else sums.treeReduce(add)
        sent.destroy()
        return loss / n, grad / n

    w = minimise(mean_loss, np.array(first), rounds)
    blocks.unpersist()
    made = context._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(f"network_{features}", _py2java(context, DenseVector(w)))
    model = MultilayerPerceptronClassificationModel(made)._set(layers=layers, featuresCol=features, labelCol=label, maxIter=rounds, seed=seed)
    model._transfer_params_to_java()
    return model
