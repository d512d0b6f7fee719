"""Python functions over Arrow string columns, in memory that the size of a batch does not decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are Python objects at a time; a longer text is alone.
SLICE_BYTES = 1 << 20


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Slices of a string column, none without rows, but one of an empty column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i, n, before = 0, len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield column.slice(i, j - i)
        i, before = j, int(ends[j - 1])
    if not n:
        yield column


def over_slices(f: Callable[[list], pa.Array], column: pa.Array) -> pa.Array:
    """``f`` of the texts of each slice, in one column. Of a batch of 10,000 pages only Arrow's bytes are there at once;
    parsed pages, some ten times as large, are gone when the next slice begins."""
    pa.default_memory_pool().release_unused()  # what the batch before this one left
    parts = [f(x.to_pylist()) for x in slices(column)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def texts(f: Callable[[str], object], column: pa.Array, kind: pa.DataType) -> pa.Array:
    """``f`` of each text; NULL gives NULL."""
    return over_slices(lambda ts: pa.array([None if t is None else f(t) for t in ts], kind), column)
