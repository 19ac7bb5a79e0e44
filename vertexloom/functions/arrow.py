"""Small pieces for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of ``rows`` rows, so that Python objects for only these are alive; at the end unused memory goes back, as workers live on."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def with_columns(batch: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    """A batch of the kept columns and further ones."""
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more.values()], names=[*keep, *more])
