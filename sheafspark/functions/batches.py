"""Arrow batches in bounded runs: Spark's batches are bounded by rows, Python objects of them should be bounded by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 256 * 1024


def slices(values: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The array in runs of at most so many bytes, but one value at least, so that few values are Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield values.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield values.slice(start)
