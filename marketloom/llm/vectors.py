"""Rows of vectors: which take part, and their components as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components from here on are refused: their squared distances and inner products over 64 components would not fit in 64 bits.
LIMIT = 1 << 27


def finite(vector: str) -> Column:
    """Not null, and no component null, NaN or infinite."""
    inf = float("inf")
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x > -inf) & (x < inf))


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * component), the component as double, of a list column: all components in one array, and the lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    whole = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(whole) and np.abs(whole).max() >= LIMIT:
        raise ArithmeticError(f"a component times {scale} reaches {LIMIT}; its products do not fit in 64 bits")
    return whole.astype(np.int64), lengths


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of an array as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array, dtype: np.dtype | str, width: int) -> np.ndarray:
    """The array whose rows packed made, or joined binary values of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, width), dtype=dtype)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(column.buffers()[2])[offsets[0] : offsets[-1]]
    return np.frombuffer(raw, dtype=dtype).reshape(len(column), width)
