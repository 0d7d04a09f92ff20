"""Arrow batches cut by the size of their texts, and list columns from arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches whose ``column`` (string, binary or a list of ints) holds ``most`` bytes at most, or
    one row."""
    for batch in batches:
        values = batch.column(column)
        lengths = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at, before = 0, 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, upto - at)
            at, before = upto, int(ends[upto - 1])


def list_column(arrays: list[np.ndarray], dtype: str = "int32") -> pa.ListArray:
    """One list per array."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(dtype, copy=False)))
