"""Right singular vectors of sparse rows by block Lanczos with restarts: few passes over the rows, many vectors a pass."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from millrace.session import exchange, forget, put, take

#: Rows of a packed piece, vectors of a pass, width up to which all products are made, rounds and tolerance of ARPACK in MLlib, least share of the largest value.
PIECE, AT_ONCE, NARROW, ROUNDS, TOLERANCE, LEAST = 512, 16, 1024, 768, 1e-10, 1e-9


def _entries(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the vectors, and the places and numbers of all."""
    at, w = column.field("indices"), column.field("values")
    n = pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False).astype("int64")
    if at.null_count > column.null_count:  # a dense vector
        places = np.concatenate([np.asarray(p if p is not None else range(k), dtype="int32") for p, k in zip(at.to_pylist(), n, strict=True)])
    else:
        places = pc.list_flatten(at).to_numpy(zero_copy_only=False)
    return n, places, pc.list_flatten(w).to_numpy(zero_copy_only=False)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of rows as bytes: what all rows of a group have alike stands once, in a row before those of the piece.

    Lengths and numbers of the rows that have any entries, places, values and the order of the places, and the group of each row.
    """
    for b in batches:
        for k in range(0, b.num_rows, PIECE):
            piece = b.slice(k, PIECE)
            n, at, w = _entries(piece.column(0))
            if not len(at):
                continue
            new = np.ones(len(n), dtype=bool)
            if piece.num_columns > 1:
                keys = piece.column(1).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] = keys[1:] != keys[:-1]
            group = np.cumsum(new) - 1
            size, row, wide = np.bincount(group), np.repeat(np.arange(len(n)), n), int(at.max()) + 1
            key = group[row] * wide + at
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.diff(key[order], prepend=-1))
            times, of = np.diff(start, append=len(key)), key[order[start]] // wide
            sorted_w = w[order]
            alike = (times == size[of]) & (size[of] > 1) & (np.minimum.reduceat(sorted_w, start) == np.maximum.reduceat(sorted_w, start))
            own = np.empty(len(at), dtype=bool)
            own[order] = np.repeat(~alike, times)
            first = order[start[alike]]
            rows = np.concatenate([of[alike], len(size) + row[own]])
            at, w = np.concatenate([at[first], at[own]]).astype("int32"), np.concatenate([w[first], w[own]])
            n = np.bincount(rows)
            live = np.flatnonzero(n)
            parts = [n[live].astype("int32"), live.astype("int32"), at, w, np.argsort(at, kind="stable").astype("int32"), group.astype("int32")]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["n", "live", "at", "w", "by", "of"])


def _products(pieces: Iterable, vectors: str, width: int, wide: int) -> Iterator[np.ndarray]:
    """The transposed rows times the rows times the ``wide`` vectors of a file, summed over a task's pieces."""
    q = take(vectors, wide)
    out = np.zeros((width, q.shape[1]))
    for n, live, at, w, by, of in pieces:
        n, live, at, w, by, of = np.frombuffer(n, "int32"), np.frombuffer(live, "int32"), np.frombuffer(at, "int32"), np.frombuffer(w), np.frombuffer(by, "int32"), np.frombuffer(of, "int32")
        x = q[at]
        x *= w[:, None]
        groups = of[-1] + 1
        y = np.zeros((groups + len(of), q.shape[1]))
        y[live] = np.add.reduceat(x, np.cumsum(n) - n)
        y[groups:] += y[of]
        y[:groups] = np.add.reduceat(y[groups:], np.flatnonzero(np.diff(of, prepend=-1)))
        x = y[np.repeat(live, n)[by]]
        x *= w[by][:, None]
        column = at[by]
        first = np.flatnonzero(np.diff(column, prepend=-1))
        out[column[first]] += np.add.reduceat(x, first)
    yield out


def largest(times: Callable[[np.ndarray], np.ndarray], width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix given by its products, and their vectors."""
    k = min(k, width)
    if width <= max(NARROW, 2 * k + 3 * AT_ONCE):
        values, vectors = np.linalg.eigh(np.hstack([times(np.eye(width)[:, s : s + AT_ONCE]) for s in range(0, width, AT_ONCE)]))
        return values[::-1][:k], vectors[:, ::-1][:, :k]
    kept = k + AT_ONCE
    most = kept + AT_ONCE * max(2, k // AT_ONCE)  # all of these lie in a file of the driver, by columns, so that none is copied at the end
    with tempfile.TemporaryFile() as f:
        v, h = np.memmap(f, np.float64, "w+", shape=(width, most + AT_ONCE), order="F"), np.zeros((most, most))
    v[:, :AT_ONCE] = np.linalg.qr(np.random.default_rng(42).normal(size=(width, AT_ONCE)))[0]
    m = 0
    for _ in range(ROUNDS):
        while m + AT_ONCE <= most:
            end = m + AT_ONCE
            w, basis = times(v[:, m:end]), np.asarray(v[:, :end])
            c = basis.T @ w
            w = w - basis @ c
            more = basis.T @ w
            w -= basis @ more
            c += more
            h[:end, m:end], h[m:end, :end] = c, c.T
            q, r = np.linalg.qr(w)
            q -= basis @ (basis.T @ q)  # of a rest near zero the directions are any
            v[:, end : end + AT_ONCE], m = np.linalg.qr(q)[0], end
        values, s = np.linalg.eigh((h[:m, :m] + h[:m, :m].T) / 2)
        values, s = values[::-1], s[:, ::-1]
        off = np.linalg.norm(r @ s[m - AT_ONCE :, :k], axis=0)
        for start in range(0, width, 4096):
            v[start : start + 4096, :kept] = v[start : start + 4096, :m] @ s[:, :kept]
        if (off <= np.maximum(TOLERANCE * values[:k], 1e-14 * values[0])).all():
            return values[:k], v[:, :k]
        v[:, kept : kept + AT_ONCE] = v[:, m : m + AT_ONCE]
        h[:] = 0
        h[range(kept), range(kept)] = values[:kept]
        m = kept
    raise RuntimeError(f"the singular vectors were not found in {ROUNDS} rounds")


def right_vectors(df: DataFrame, k: int, width: int, straight: int = 32) -> np.ndarray:
    """The first ``k`` right singular vectors of the rows in the first column of ``df``, without those of values near zero.

    What neighbours of one value in a second column have alike is multiplied once.
    """
    pieces = df.mapInArrow(_pack, "n binary, live binary, at binary, w binary, by binary, of binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
    with exchange(df.sparkSession) as folder:

        def times(q: np.ndarray) -> np.ndarray:
            sent = put(folder, q)
            sums = pieces.mapPartitions(partial(_products, vectors=sent, width=width, wide=q.shape[1]))
            if pieces.getNumPartitions() > straight:
                out, names = sums.treeReduce(lambda a, b: a + b), []
            else:  # one after another: through the driver's JVM they would fill it with buffers
                names, out = sums.map(partial(put, folder)).collect(), np.zeros(q.shape)
                for name in names:
                    out += take(name, q.shape[1])
            forget([sent, *names])
            return out

        values, vectors = largest(times, width, k)
    pieces.unpersist()
    return vectors[:, : np.count_nonzero(np.sqrt(np.maximum(values, 0)) > LEAST * np.sqrt(max(values[0], 0)))]


def jvm_matrix(context, m: np.ndarray):
    """``m`` as a dense matrix of the JVM, sent a piece at a time."""
    flat = np.ravel(m, order="F")
    to, nio = context._gateway.new_array(context._jvm.double, len(flat)), context._jvm.java.nio
    for start in range(0, len(flat), 1 << 19):
        part = flat[start : start + (1 << 19)]
        nio.ByteBuffer.wrap(bytearray(part.tobytes())).order(nio.ByteOrder.LITTLE_ENDIAN).asDoubleBuffer().get(to, start, len(part))
    return context._jvm.org.apache.spark.ml.linalg.DenseMatrix(m.shape[0], m.shape[1], to)
