"""Texts in Python workers: a worker holds the objects of a slice of a batch, however long the texts of the batch are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text, and rows, that are Python objects at once.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1024


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES, most: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of strings, one row at least."""
    ends, at = np.zeros(batch.num_rows, dtype=np.int64), 0
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            ends += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = ends.cumsum()
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        end = max(at + 1, min(end, at + most))
        yield batch.slice(at, end - at)
        at = end


def by_slices(run: Callable[[list[str | None]], pa.Array], kind: str) -> Callable[[Column], Column]:
    """A column function of type ``kind`` from a function over the texts of a slice."""

    def sliced(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["t"])
        out = [run(s.column(0).to_pylist()) for s in slices(batch)]
        return pa.concat_arrays(out) if out else run([])

    return lambda texts: F.arrow_udf(sliced, kind)(texts)
