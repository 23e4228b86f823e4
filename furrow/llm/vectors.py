"""Vector columns: which rows count, and their components as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite components; never null."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & plain, F.lit(False))


def matrix(lists: pa.Array | pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    """The rows of a list column as a matrix; a shorter row is followed by zeros."""
    whole = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(whole) * dim:
        return flat.reshape(-1, dim).astype(kind)
    size = whole.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(whole), dim), kind)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def large_pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of at least ``rows`` rows, the last one excepted."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)
