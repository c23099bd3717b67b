"""Conversions between Arrow list columns and NumPy arrays, used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def one_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``width`` elements."""
    flat = one_array(column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def ragged(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column without nulls; offsets start at zero."""
    array = one_array(column)
    if len(array) == 0:
        return np.zeros(1, dtype=np.int32), array.flatten().to_numpy(zero_copy_only=False)
    offsets = array.offsets.to_numpy()
    return offsets - offsets[0], array.flatten().to_numpy(zero_copy_only=False)


def list_column(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array as one list per row."""
    count, width = rows.shape
    offsets = np.arange(count + 1, dtype=np.int64) * width
    return pa.LargeListArray.from_arrays(offsets, rows.reshape(-1)).cast(pa.list_(pa.float64()))
