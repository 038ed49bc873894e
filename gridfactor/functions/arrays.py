"""Arrow list columns as NumPy matrices and back, without a Python object for each value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def dense(column) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), len(flat) // len(column)) if len(column) else flat.reshape(0, 0)


def dense_complex(batch, re: str = "re", im: str = "im") -> np.ndarray:
    return dense(batch[re]) + 1j * dense(batch[im])


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel()))
