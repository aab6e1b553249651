"""Short rows unpacked to dense ones."""

import numpy as np
import pyarrow as pa

from millrace.operators import recommend


def test_dense_in_parts(monkeypatch):
    """Rows unpacked a few at a time lie in their places."""
    monkeypatch.setattr(recommend, "UNPACKED", 2)
    t = pa.table({"at": pa.array([[0], [], [2, 1], [1], [0, 2]], pa.list_(pa.int32())), "w": pa.array([[1.0], [], [2.0, 3.0], [4.0], [5.0, 6.0]])})
    whole = [[1, 0, 0], [0, 0, 0], [0, 3, 2], [0, 4, 0], [5, 0, 6]]
    assert recommend._dense(t, 3).tolist() == whole
    place = np.array([4, 3, 2, 1, 0])
    assert recommend._dense(t, 3, place).tolist() == whole[::-1]
