"""Arrow batches cut by what their rows hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, or words, whose Python objects a task holds at a time.
PIECE = 1 << 19


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes (of a text) or items (of a list) of a column each, or with one row."""
    values = batch.column(batch.schema.get_field_index(column))
    lists = pa.types.is_list(values.type) or pa.types.is_large_list(values.type)
    sizes = (pc.list_value_length if lists else pc.binary_length)(values).fill_null(0).to_numpy(zero_copy_only=False)
    ends, low = np.cumsum(sizes, dtype=np.int64), 0
    while low < len(ends):
        begun = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, begun + most, side="right")))
        yield batch.slice(low, high - low)
        low = high
