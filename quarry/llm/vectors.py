"""What the operators on embeddings share: the rows that take part, vectors as matrices, and a grid of two tables that meet block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import string_bytes


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))


def matrix(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column without nulls as one float64 matrix, shorter vectors filled with zeros, and the vectors' lengths."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(col.offsets.to_numpy()).astype(np.int64)
    wide = int(lengths.max(initial=0))
    if (lengths == wide).all():
        return flat.reshape(len(lengths), wide), lengths
    out = np.zeros((len(lengths), wide))
    out[np.arange(wide) < lengths[:, None]] = flat
    return out, lengths


def binary_rows(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize if x.ndim == 2 else x.itemsize
    offsets = (np.arange(len(x) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def from_binary(col: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """The matrix that `binary_rows` stored, all rows of one width."""
    return string_bytes(col)[0].view(kind).reshape(len(col), -1)


def meet(left: DataFrame, right: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """Runs work(left rows, right rows) for the rows of each key, which is a cell of a grid whose sides the caller has bounded."""

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        return work(a, b)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(both, schema)


def slices(n: Column, most: int) -> Column:
    """How many parts of about `most` rows n rows make."""
    return F.greatest(F.lit(1), F.ceil(n / F.lit(most))).cast("int")


def spread(key: Column, n: Column) -> Column:
    """The part, of n, that a row with this key belongs to."""
    return F.pmod(F.xxhash64(key, F.lit("part")), n).cast("int")


def each(n: Column) -> Column:
    """A row for every part of n."""
    return F.explode(F.sequence(F.lit(0), n - 1))
