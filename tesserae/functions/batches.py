"""Arrow batches in bounded pieces, so that a task's Python memory doesn't follow the number or length of the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pieces(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``sizes`` of rows come to about ``most``: less than that and a row more. Nothing is copied."""
    part = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
        if high > low:
            yield batch.slice(int(low), int(high - low))
